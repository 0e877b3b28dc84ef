"""The query catalogue: importing its modules registers their queries."""

from __future__ import annotations

import importlib

MODULES = ("relational", "reporting", "graphs", "streams", "storage", "analysis")


def load() -> None:
    for name in MODULES:
        importlib.import_module(f"{__name__}.{name}")
