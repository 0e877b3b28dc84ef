"""Table maintenance on immutable files: upserts, merges, deletions and checks as plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def latest(rows: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """One row for each key: the last in the order. The order should be total, else ties go either way."""
    w = Window.partitionBy(*key).orderBy(*order)
    return rows.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def guarded_upsert(stored: DataFrame, incoming: DataFrame, key: str, rank: str, seq: str) -> DataFrame:
    """stored with incoming rows put in unless a row of their key is strictly more defined (of a greater rank); ties: the newest wins.

    Both have key, rank and seq (when a row came).
    """
    return latest(stored.unionByName(incoming), [key], [F.col(rank).desc(), F.col(seq).desc()])


def replaced(stored: DataFrame, incoming: DataFrame, key: list[str]) -> DataFrame:
    """stored with the rows of incoming's keys replaced."""
    return stored.join(incoming.select(*key).distinct(), key, "left_anti").select(*stored.columns).unionByName(incoming)


def deleted(stored: DataFrame, keys: DataFrame, key: list[str]) -> DataFrame:
    return stored.join(keys.select(*key).distinct(), key, "left_anti").select(*stored.columns)


def merged_left(a: DataFrame, b: DataFrame, key: str, value: str) -> DataFrame:
    """The union of two maps (key, value); a's value where both have one."""
    return a.select(key, F.col(value).alias("__a")).join(b.select(key, F.col(value).alias("__b")), key, "full_outer").select(key, F.coalesce("__a", "__b").alias(value))


def exactly(rows: DataFrame, most: int, what: str) -> DataFrame:
    """rows, after a check that there are at most so many; looks at one more row than allowed, no more."""
    if len(rows.take(most + 1)) > most:
        raise ValueError(f"{what}: more than {most} rows")
    return rows


def violations(child: DataFrame, column: str, parent: DataFrame, key: str) -> DataFrame:
    """child's rows whose column, if not null, isn't a key of parent."""
    return child.where(F.col(column).isNotNull()).join(parent.select(F.col(key).alias(column)).distinct(), column, "left_anti")


def repeated_keys(rows: DataFrame, key: list[str]) -> DataFrame:
    return rows.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def prepared(spark: SparkSession, text: str, **args: object) -> DataFrame:
    """A statement with named parameters; equal texts share their parsed plan in Spark's own caches."""
    return spark.sql(text, args=args)


def compensated_sum(column: str, digits: int = 12) -> Column:
    """A sum that doesn't depend on the order of rows: in decimals, so no low bits are lost on the way."""
    return F.sum(F.col(column).cast(f"decimal(38,{digits})")).cast("double")


def multimap_add(bindings: DataFrame, more: DataFrame) -> DataFrame:
    """A multimap (key, value) as a long table with more bindings: all are kept, equal ones too, so no key's values meet in one row."""
    return bindings.select("key", "value").unionByName(more.select("key", "value"))
