"""Writers of results: text reports, JSON, partitioned issue stores, graph and literal renderings, batched foreach sinks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: How many rows each kind of sink takes at a time.
BATCH = {"cassandra": 50, "mongo": 1000, "elasticsearch": 1000}


def csv(df: DataFrame, path: str, header: bool = True) -> None:
    df.write.mode("overwrite").csv(path, header=header)


def lines(df: DataFrame, column: str, path: str) -> None:
    df.select(F.col(column).cast("string").alias("value")).write.mode("overwrite").text(path)


def json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def pretty_json(df: DataFrame) -> DataFrame:
    """(value) one indented JSON object for each row."""
    return df.select(F.to_json(F.struct("*"), {"pretty": "true"}).alias("value"))


def json_arrays(df: DataFrame, path: str) -> None:
    """Indented JSON arrays of the rows' objects, a file for each partition: the form of a report, for tables of a report's size."""
    rows = pretty_json(df).groupBy(F.spark_partition_id()).agg(F.concat(F.lit("[\n"), F.array_join(F.collect_list("value"), ",\n"), F.lit("\n]")).alias("value"))
    # an array each file, as a reader takes one value of it
    rows.select("value").write.mode("overwrite").option("maxRecordsPerFile", 1).text(path)


def numbered_batches(df: DataFrame, order: list[str], size: int) -> DataFrame:
    """df with batch, so that a sink takes at most size rows at a time: the rows' place in the order, in steps of size."""
    from stratalake.operators.windows import dense_index

    return dense_index(df, order, "__at").withColumn("batch", F.floor(F.col("__at") / size)).drop("__at")


def result_map(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def diff_files(diff: DataFrame, path: str) -> None:
    """A folder for each status with its issues as JSON lines."""
    diff.write.mode("overwrite").partitionBy("status").json(path)


def report_lines(df: DataFrame, fields: list[str]) -> DataFrame:
    """(value) the chosen fields of each row, comma-separated."""
    return df.select(F.concat_ws(", ", *(F.coalesce(F.col(f).cast("string"), F.lit("")) for f in fields)).alias("value"))


def issue_store(df: DataFrame, path: str, by: str = "file") -> None:
    df.write.mode("overwrite").partitionBy(by).json(path)


def dot(edges: DataFrame) -> DataFrame:
    """(value) an edge statement for each edge; a caller puts the braces around."""
    label = F.col("kind") if "kind" in edges.columns else F.lit("")
    return edges.select(F.format_string('"%s" -> "%s" [label="%s"]', F.col("src").cast("string"), F.col("dst").cast("string"), label).alias("value"))


def literal_list(values: Column) -> Column:
    """An array of strings as `["a"; "b"]`."""
    return F.concat(F.lit("["), F.array_join(F.transform(values, lambda v: F.concat(F.lit('"'), v, F.lit('"'))), "; "), F.lit("]"))


def in_batches(write: Callable[[list], None], size: int) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that hands rows to write at most size at a time, on the executors."""

    def each(df: DataFrame, _: int) -> None:
        def part(rows) -> None:
            held = []
            for r in rows:
                held.append(r)
                if len(held) == size:
                    write(held)
                    held = []
            if held:
                write(held)

        df.foreachPartition(part)

    return each
