"""Stand-in views: program facts read out of the driver's tables, as DataFrames and as SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Table = Callable[[str], DataFrame]


def methods(t: Table) -> DataFrame:
    return t("part").select(F.col("p_partkey").alias("index"), F.col("p_brand").alias("class"), F.col("p_type").alias("rtntype"), F.col("p_name").alias("name"), F.col("p_size").cast("string").alias("intype"))


METHODS = "(SELECT p_partkey AS index, p_brand AS class, p_type AS rtntype, p_name AS name, CAST(p_size AS VARCHAR) AS intype FROM part)"


def method_ids(t: Table) -> DataFrame:
    return t("part").select("p_partkey", F.concat("p_type", F.lit(" pkg."), "p_brand", F.lit("."), F.replace("p_name", F.lit(" "), F.lit("_")), F.lit("("), F.when(F.col("p_size") % 5 == 0, F.lit("")).otherwise(F.col("p_size").cast("string")), F.lit(")")).alias("id"))


METHOD_IDS = "(SELECT p_partkey, concat(p_type, ' pkg.', p_brand, '.', replace(p_name, ' ', '_'), '(', CASE WHEN p_size % 5 = 0 THEN '' ELSE CAST(p_size AS VARCHAR) END, ')') AS id FROM part)"


def calls(t: Table) -> DataFrame:
    """Caller and callee: suppliers call parts."""
    return t("lineitem").select(F.col("l_suppkey").alias("src"), F.col("l_partkey").alias("dst")).distinct()


CALLS = "(SELECT DISTINCT l_suppkey AS src, l_partkey AS dst FROM lineitem)"


def sparse(t: Table) -> DataFrame:
    """A sparse directed graph on part keys, with cycles: each part points to its key's image under two maps."""
    k = F.col("p_partkey")
    p = t("part").where("p_partkey % 3 <> 0")
    return p.select(k.alias("src"), ((k * 7 + 1) % 1009).alias("dst")).unionByName(p.where("p_partkey % 5 = 1").select(k.alias("src"), F.floor(k / 2).alias("dst"))).distinct()


SPARSE = "(SELECT p_partkey AS src, (p_partkey * 7 + 1) % 1009 AS dst FROM part WHERE p_partkey % 3 <> 0 UNION SELECT p_partkey, p_partkey // 2 FROM part WHERE p_partkey % 3 <> 0 AND p_partkey % 5 = 1)"


def dag(t: Table) -> DataFrame:
    """Edges from larger to smaller part keys."""
    k = F.col("p_partkey")
    p = t("part").where("p_partkey > 0")
    return p.select(k.alias("src"), F.floor(k / 2).cast("long").alias("dst")).unionByName(p.where("p_partkey % 4 = 1 AND p_partkey > 3").select(k.alias("src"), (k - 3).alias("dst"))).distinct()


DAG = "(SELECT p_partkey AS src, p_partkey // 2 AS dst FROM part WHERE p_partkey > 0 UNION SELECT p_partkey, p_partkey - 3 FROM part WHERE p_partkey % 4 = 1 AND p_partkey > 3)"


def tree(t: Table) -> DataFrame:
    """A heap-shaped tree on part keys: three children each."""
    return t("part").where("p_partkey > 0").select(F.floor((F.col("p_partkey") - 1) / 3).alias("parent"), F.col("p_partkey").alias("child"))


TREE = "(SELECT (p_partkey - 1) // 3 AS parent, p_partkey AS child FROM part WHERE p_partkey > 0)"


def procedures(t: Table) -> DataFrame:
    """Nodes of many small graphs: 64 parts each, numbered from 1."""
    k = F.col("p_partkey")
    return t("part").select(F.concat(F.lit("g"), F.floor(k / 64).cast("string")).alias("graph"), (k % 64 + 1).alias("node"))


PROCEDURES = "(SELECT concat('g', p_partkey // 64) AS graph, p_partkey % 64 + 1 AS node FROM part)"


def forest(t: Table) -> DataFrame:
    """The tree's edges to parts of more than half the greatest size: many small trees."""
    big = t("part").where("p_size > 25").select(F.col("p_partkey").alias("dst"))
    return tree(t).select(F.col("parent").alias("src"), F.col("child").alias("dst")).join(big, "dst").select("src", "dst")


FOREST = "(SELECT parent AS src, child AS dst FROM (SELECT (p_partkey - 1) // 3 AS parent, p_partkey AS child FROM part WHERE p_partkey > 0 AND p_size > 25))"


def reports(t: Table) -> tuple[DataFrame, DataFrame]:
    """(current, previous): events after and before the month's middle as issues."""
    e = t("events").select(F.concat_ws("_", F.col("user_id"), F.col("event_type"), F.floor(F.col("value") / 5).cast("string")).alias("hash"), F.col("event_type").alias("bug_type"), F.concat(F.lit("src/f"), F.col("user_id").cast("string"), F.lit(".java")).alias("file"), F.col("event_id").alias("line"), "ts")
    cut = F.lit("2024-01-16").cast("timestamp_ntz")
    return e.where(F.col("ts") >= cut).drop("ts"), e.where(F.col("ts") < cut).drop("ts")


def _issues(sign: str) -> str:
    return f"(SELECT concat_ws('_', user_id, event_type, CAST(CAST(floor(value / 5) AS BIGINT) AS VARCHAR)) AS hash, event_type AS bug_type, concat('src/f', user_id, '.java') AS file, event_id AS line FROM events WHERE ts {sign} TIMESTAMP '2024-01-16')"


CURRENT, PREVIOUS = _issues(">="), _issues("<")
