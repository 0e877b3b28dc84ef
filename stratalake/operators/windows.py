"""Order-sensitive operators on rows, batch forms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def consecutive(rows: DataFrame, part: str, order: list[str], value: str) -> DataFrame:
    """(part, first, second) for each two neighbours in the order."""
    w = Window.partitionBy(part).orderBy(*order)
    return rows.select(part, F.col(value).alias("first"), F.lead(value).over(w).alias("second")).where("second IS NOT NULL")


def without_repeats(rows: DataFrame, part: str, order: list[str], value: str, irrelevant: Column) -> DataFrame:
    """rows less those that are irrelevant and equal in value to the row right before."""
    w = Window.partitionBy(part).orderBy(*order)
    return rows.withColumn("__same", F.lag(value).over(w) == F.col(value)).where(~(F.coalesce("__same", F.lit(False)) & irrelevant)).drop("__same")


def recent(accesses: DataFrame, part: str, key: str, order: list[str], most: int) -> DataFrame:
    """The most recently accessed keys of each part, at most so many, each with its last access."""
    last = accesses.groupBy(part, key).agg(F.max(F.struct(*order)).alias("__last"))
    w = Window.partitionBy(part).orderBy(F.col("__last").desc(), F.col(key))
    return last.withColumn("recency", F.row_number().over(w)).where(F.col("recency") <= most).select(part, key, "recency", *(F.col(f"__last.{c}").alias(c) for c in order))


def length_window(rows: DataFrame, part: str, order: list[str], length: int) -> Window:
    return Window.partitionBy(part).orderBy(*order).rowsBetween(-(length - 1), 0)


def take_until(rows: DataFrame, part: str, order: list[str], size: Column, most: int) -> DataFrame:
    """Rows in order until their sizes reach most, the row that reaches it included."""
    w = Window.partitionBy(part).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("__before", F.coalesce(F.sum(size).over(w), F.lit(0))).where(F.col("__before") < most).drop("__before")


def marked_groups(rows: DataFrame, part: str, order: list[str], is_heading: Column) -> DataFrame:
    """rows with group_no: how many headings stand at or before a row."""
    w = Window.partitionBy(part).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("group_no", F.sum(F.when(is_heading, 1).otherwise(0)).over(w))


def sessions(rows: DataFrame, part: str, time: str, gap_seconds: int) -> DataFrame:
    """(part, start, n): runs of rows whose steps in time are under the gap."""
    w = Window.partitionBy(part).orderBy(time)
    seconds = F.unix_micros(F.col(time).cast("timestamp"))
    new = F.when(seconds - F.lag(seconds).over(w) < gap_seconds * 1_000_000, 0).otherwise(1)
    return rows.withColumn("__new", new).withColumn("__no", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0))).groupBy(part, "__no").agg(F.min(time).alias("start"), F.count(F.lit(1)).alias("n")).drop("__no")


def dense_index(rows: DataFrame, order: list[str], name: str = "index") -> DataFrame:
    """rows with their 0-based places in a total order, dense, without gathering all rows in one task.

    A range sort gives each partition a stretch of the order; the stretches' sizes, one number a partition, are summed before the
    places inside them are added.
    """
    from stratalake.operators.graph import cut

    at = cut(rows.orderBy(*order).withColumn("__p", F.spark_partition_id()).withColumn("__m", F.monotonically_increasing_id()))
    sizes = at.groupBy("__p").agg(F.count(F.lit(1)).alias("__n"), F.min("__m").alias("__first"))
    before = sizes.select("__p", "__first", (F.sum("__n").over(Window.orderBy("__p")) - F.col("__n")).alias("__before"))
    return at.join(F.broadcast(before), "__p").select(*rows.columns, (F.col("__before") + F.col("__m") - F.col("__first")).alias(name))
