"""Costs as polynomials, a row for each term, and bounds on how often nodes run.

A cost table has (key, monomial, coefficient): a monomial is the sorted array of its variables, each as often as its power, and
empty for the constant term. A key without rows costs nothing. Null coefficients count as 0.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratalake.operators.graph import components


def _summed(terms: DataFrame) -> DataFrame:
    return terms.groupBy("key", "monomial").agg(F.sum("coefficient").alias("coefficient")).where("coefficient <> 0")


def plus(a: DataFrame, b: DataFrame) -> DataFrame:
    """The sum of two costs by key; terms that cancel go."""
    return _summed(a.select("key", "monomial", "coefficient").unionByName(b.select("key", "monomial", "coefficient")))


def times(a: DataFrame, b: DataFrame) -> DataFrame:
    """The product by key: the cost of a body (a) that runs as often as a bound says (b). A key has few terms, so the join grows little."""
    other = b.select("key", F.col("monomial").alias("more"), F.col("coefficient").alias("factor"))
    both = a.select("key", "monomial", "coefficient").join(other, "key")
    return _summed(both.select("key", F.array_sort(F.concat("monomial", "more")).alias("monomial"), (F.col("coefficient") * F.col("factor")).alias("coefficient")))


def _leading(cost: DataFrame, degree: str, lead: str) -> DataFrame:
    """(key, degree, sum of the coefficients of that degree): the greatest struct of (degree, sum) by degree."""
    by_degree = cost.groupBy("key", F.size("monomial").alias("d")).agg(F.sum("coefficient").alias("c"))
    top = by_degree.groupBy("key").agg(F.max(F.struct("d", "c")).alias("top"))
    return top.select("key", F.col("top.d").alias(degree), F.col("top.c").alias(lead))


def lesser(a: DataFrame, b: DataFrame) -> DataFrame:
    """The cost of lower degree by key, or of lower leading coefficients where degrees are equal; a's on ties. Keys that one side
    lacks cost nothing and have no rows."""
    ranks = _leading(a, "da", "ca").join(_leading(b, "db", "cb"), "key")
    second = (F.col("db") < F.col("da")) | ((F.col("db") == F.col("da")) & (F.col("cb") < F.col("ca")))
    pick = ranks.select("key", second.alias("second"))
    columns = ("key", "monomial", "coefficient")
    first = a.select(*columns).join(pick.where("NOT second").select("key"), "key", "left_semi")
    return first.unionByName(b.select(*columns).join(pick.where("second").select("key"), "key", "left_semi"))


def node_bounds(edges: DataFrame, local: DataFrame) -> DataFrame:
    """(node, bound): the least local bound (node, bound) of all nodes that run equally often.

    Flow is kept on edges (src, dst): where an edge is its source's only way out and its target's only way in, both run equally
    often. Nodes equal to one another are a class, and a class has the least bound that a member has. Null bounds say nothing.
    """
    e = edges.select("src", "dst").where("src <> dst").distinct()
    one_out = e.groupBy("src").agg(F.count(F.lit(1)).alias("n")).where("n = 1").select("src")
    one_in = e.groupBy("dst").agg(F.count(F.lit(1)).alias("n")).where("n = 1").select("dst")
    equal = e.join(one_out, "src", "left_semi").join(one_in, "dst", "left_semi").select("src", "dst")
    known = local.select("node", "bound").join(components(equal), "node", "left")
    least = known.where("component IS NOT NULL").groupBy("component").agg(F.min("bound").alias("least"))
    return known.join(least, "component", "left").select("node", F.least("bound", "least").alias("bound"))
