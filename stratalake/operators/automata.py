"""Temporal properties of event traces as automata with registers, and CTL over trees.

A property is a list of transitions. Nondeterminism and registers make a state a set of (vertex, registers); traces are independent, so each
is one group of rows in order of its sequence. Properties that are plain sequences (A, then C without B between) compile to windows.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Transition:
    src: str
    dst: str
    proc: str | None = None  # a regular expression on the whole name; None: any event (a skip)
    guard: Callable[[dict, dict], bool] | None = None  # (event, registers)
    action: Callable[[dict, dict], dict] | None = None  # new registers


@dataclass(frozen=True)
class Property:
    name: str
    transitions: tuple[Transition, ...]
    start: str = "start"
    error: str = "error"
    compiled: dict = field(default_factory=dict, compare=False)

    def is_skip(self, t: Transition) -> bool:
        """Whether a transition stays where it is whatever happens: such loops keep a state and need no work of their own."""
        return t.src == t.dst and t.proc is None and t.guard is None and t.action is None


def run_property(events: DataFrame, prop: Property, trace: str, seq: str, proc: str) -> DataFrame:
    """(trace, seq, property): the first event of each trace at which the property's error vertex is reached.

    A state that no transition takes on stays only if it has a skip loop. Traces are groups: one trace is in one task.
    """
    import pandas as pd

    skips = {t.src for t in prop.transitions if prop.is_skip(t)}
    active = [(t, re.compile(t.proc) if t.proc is not None else None) for t in prop.transitions if not prop.is_skip(t)]
    kind, order = events.schema[trace].dataType.simpleString(), events.schema[seq].dataType.simpleString()

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        states: set[tuple[str, tuple]] = {(prop.start, ())}
        for event in pdf.sort_values(seq).to_dict("records"):
            after = {s for s in states if s[0] in skips}
            for vertex, registers in states:
                for t, pattern in active:
                    if t.src == vertex and (pattern is None or pattern.fullmatch(event[proc])) and (t.guard is None or t.guard(event, dict(registers))):
                        after.add((t.dst, tuple(sorted((t.action(event, dict(registers)) if t.action else dict(registers)).items()))))
            if any(v == prop.error for v, _ in after):
                return pd.DataFrame({trace: [event[trace]], seq: [event[seq]], "property": [prop.name]})
            states = after
        return pd.DataFrame({trace: pd.Series(dtype=pdf[trace].dtype), seq: pd.Series(dtype=pdf[seq].dtype), "property": pd.Series(dtype=str)})

    return events.groupBy(trace).applyInPandas(one, f"`{trace}` {kind}, `{seq}` {order}, property string")


def followed_without(events: DataFrame, first: str, last: str, without: str, trace: str, seq: tuple[str, ...], proc: str) -> DataFrame:
    """Events named last whose nearest earlier event among first, last and without, in their trace, is named first.

    The fixed-length form of an automaton: one window, no group in a task's memory.
    """
    w = Window.partitionBy(trace).orderBy(*seq)
    return events.where(F.col(proc).isin(first, last, without)).withColumn("__before", F.lag(proc).over(w)).where((F.col(proc) == last) & (F.col("__before") == first)).drop("__before")


class Tree:
    """CTL over child edges (parent, child) and labelled nodes: every formula is the table of nodes where it holds."""

    def __init__(self, nodes: DataFrame, edges: DataFrame, max_rounds: int = 1000):
        from stratalake.operators.graph import cut

        self.cut, self.max_rounds = cut, max_rounds
        self.nodes, self.edges = nodes.select("node").distinct(), edges.select("parent", "child").distinct()

    def not_(self, a: DataFrame) -> DataFrame:
        return self.nodes.join(a, "node", "left_anti")

    def and_(self, a: DataFrame, b: DataFrame) -> DataFrame:
        return a.join(b, "node", "left_semi")

    def or_(self, a: DataFrame, b: DataFrame) -> DataFrame:
        return a.union(b).distinct()

    def implies(self, a: DataFrame, b: DataFrame) -> DataFrame:
        return self.or_(self.not_(a), b)

    def ex(self, a: DataFrame) -> DataFrame:
        return self.edges.join(a.withColumnRenamed("node", "child"), "child", "left_semi").select(F.col("parent").alias("node")).distinct()

    def ax(self, a: DataFrame) -> DataFrame:
        """All children; a leaf satisfies it."""
        return self.not_(self.ex(self.not_(a)))

    def _least(self, a: DataFrame, grow: Callable[[DataFrame], DataFrame]) -> DataFrame:
        held = self.cut(a)
        for _ in range(self.max_rounds):
            new = self.cut(grow(held).join(held, "node", "left_anti"))
            if new.isEmpty():
                break
            held = self.cut(held.union(new))
        return held

    def eu(self, a: DataFrame, b: DataFrame) -> DataFrame:
        return self._least(b, lambda h: self.and_(a, self.ex(h)))

    def au(self, a: DataFrame, b: DataFrame) -> DataFrame:
        inner = self.edges.select(F.col("parent").alias("node")).distinct()
        return self._least(b, lambda h: self.and_(self.and_(a, inner), self.ax(h)))

    def ef(self, a: DataFrame) -> DataFrame:
        return self.eu(self.nodes, a)

    def af(self, a: DataFrame) -> DataFrame:
        return self.au(self.nodes, a)

    def ag(self, a: DataFrame) -> DataFrame:
        return self.not_(self.ef(self.not_(a)))

    def eg(self, a: DataFrame) -> DataFrame:
        return self.not_(self.af(self.not_(a)))

    def eh(self, a: DataFrame) -> DataFrame:
        """Some proper ancestor satisfies a."""
        down = self.edges.join(a.withColumnRenamed("node", "parent"), "parent", "left_semi").select(F.col("child").alias("node")).distinct()
        return self._least(down, lambda h: self.edges.join(h.withColumnRenamed("node", "parent"), "parent", "left_semi").select(F.col("child").alias("node")).distinct())

    def et(self, labels: DataFrame, names: list[str], a: DataFrame) -> DataFrame:
        """Some node labelled with one of the names, at or below, satisfies a."""
        return self.ef(self.and_(labels.where(F.col("label").isin(*names)).select("node"), a))
