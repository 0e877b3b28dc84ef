"""Small scalar and array functions that the operators share."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Binary operators by their printed names; the algebra below speaks of the same names.
BINARY = {
    "+": lambda a, b: a + b, "-": lambda a, b: a - b, "*": lambda a, b: a * b, "/": lambda a, b: F.try_divide(a, b), "%": lambda a, b: F.try_mod(a, b),
    "<": lambda a, b: a < b, ">": lambda a, b: a > b, "<=": lambda a, b: a <= b, ">=": lambda a, b: a >= b, "==": lambda a, b: a == b, "!=": lambda a, b: a != b,
    "&": lambda a, b: a.bitwiseAND(b), "|": lambda a, b: a.bitwiseOR(b), "^": lambda a, b: a.bitwiseXOR(b), "&&": lambda a, b: a & b, "||": lambda a, b: a | b,
    "<<": lambda a, b: F.call_function("shiftleft", a, b), ">>": lambda a, b: F.call_function("shiftright", a, b),
}
UNARY = {"-": lambda a: -a, "~": lambda a: F.bitwise_not(a), "!": lambda a: ~a}
SYMMETRIC = frozenset({"+", "*", "==", "!=", "&", "|", "^", "&&", "||"})
NEGATED = {"<": ">=", ">": "<=", "<=": ">", ">=": "<", "==": "!=", "!=": "=="}
INJECTIVE = frozenset({"+", "-"})
ZERO_RIGHT_UNIT = frozenset({"+", "-", "|", "^", "<<", ">>"})

#: What a label of each rank weighs.
WEIGHTS = (1, 2 * 4, 3 * 64, 4 * 256)


def weight_of(label: Column) -> Column:
    """The weight of a label value 1 to 4."""
    return F.element_at(F.array(*(F.lit(w) for w in WEIGHTS)), label)


def normalised(values: Sequence[Column]) -> list[Column]:
    """Each value's share of their sum; null where the sum is 0."""
    total = sum(values[1:], values[0])
    return [F.try_divide(v, total) for v in values]


def arg_max(values: Sequence[Column], names: Sequence[str], undecided: str) -> Column:
    """The name of the first greatest value, or undecided if all are equal."""
    a = F.array(*values)
    same = F.array_max(a) == F.array_min(a)
    return F.when(same, undecided).otherwise(F.element_at(F.array(*(F.lit(n) for n in names)), F.array_position(a, F.array_max(a)).cast("int")))


def member_or(json: Column, path: str, default: Column) -> Column:
    return F.coalesce(F.get_json_object(json, path), default)


def enum_or(value: Column, known: Sequence[str], default: str = "UNKNOWN") -> Column:
    return F.when(F.upper(value).isin(*known), F.upper(value)).otherwise(default)


def polynomial_degree(text: Column) -> Column:
    """The greatest degree of a polynomial written as `3 + 2 ⋅ n + n^2 ⋅ m`: a variable's power, or 1, summed over a term."""
    term = lambda t: F.aggregate(F.regexp_extract_all(t, F.lit(r"[a-zA-Z_]\w*(\^\d+)?"), F.lit(0)), F.lit(0), lambda s, v: s + F.coalesce(F.try_to_number(F.nullif(F.regexp_extract(v, r"\^(\d+)", 1), F.lit("")), F.lit("999")).cast("int"), F.lit(1)))
    return F.array_max(F.transform(F.split(text, r" \+ "), term))


def combine_adjacent(values: Column, same: callable, merged: callable) -> Column:
    """An array in which neighbours that are the same are merged from left to right."""

    def step(done: Column, x: Column) -> Column:
        last = F.element_at(done, -1)
        return F.when((F.size(done) > 0) & same(last, x), F.concat(F.slice(done, 1, F.size(done) - 1), F.array(merged(last, x)))).otherwise(F.concat(done, F.array(x)))

    return F.aggregate(values, F.slice(values, 1, 0), step)


def traverse(values: Column, f: callable) -> Column:
    """f of all values, or null if one of them is null."""
    out = F.transform(values, f)
    return F.when(F.exists(out, lambda x: x.isNull()), None).otherwise(out)
