"""Readers of fact files: declared schemas, missing files as empty tables, no driver-side parsing."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TRACE = "array<struct<level:int,filename:string,line_number:int,column_number:int,description:string>>"
ISSUE = f"hash string, bug_type string, severity string, file string, procedure string, line int, column int, key string, node_key string, bug_trace {TRACE}"
COST_ITEM = "hash string, loc struct<file:string,lnum:int,cnum:int,enum:int>, procedure_name string, procedure_id string, is_on_ui_thread boolean, exec_cost struct<polynomial:string,degree:int,hum:struct<hum_polynomial:string,hum_degree:string,big_o:string>>"
TAINT_SPEC = "procedure string, kind string, kinds array<string>, index string"
SAMPLES = "test string, methods array<struct<class:string,method:string,signature:string>>"
MATCHER = "class_prefix string, class_regex string, method string, super boolean"


def or_empty(spark: SparkSession, schema: str, read) -> DataFrame:
    """read(), or an empty table if its path doesn't exist."""
    try:
        return read()
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return spark.createDataFrame([], schema)
        raise


def csv(spark: SparkSession, path: str, schema: str, index: bool = True) -> DataFrame:
    """A CSV file with a header, without its index column."""
    full = f"__index long, {schema}" if index else schema
    df = spark.read.schema(full).csv(path, header=True)
    return df.drop("__index")


def csvs(spark: SparkSession, paths: list[str], schema: str) -> DataFrame:
    """The union of CSV files by name; paths that don't exist are empty."""
    out = spark.createDataFrame([], schema)
    for p in paths:
        out = out.unionByName(or_empty(spark, schema, lambda p=p: spark.read.schema(schema).csv(p, header=True)), allowMissingColumns=True)
    return out


def first_field(spark: SparkSession, path: str, separator: str = "\t") -> DataFrame:
    return spark.read.text(path).select(F.split("value", separator)[0].alias("value"))


def lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines without white space at their ends."""
    return spark.read.text(path).select(F.rtrim("value").alias("value"))


def call_edges(spark: SparkSession, path: str) -> DataFrame:
    """(src, dst) of lines `id -> id`."""
    parts = F.split("value", " -> ")
    return lines(spark, path).where(F.col("value").contains(" -> ")).select(parts[0].alias("src"), parts[1].alias("dst"))


def datalog_facts(spark: SparkSession, path: str) -> DataFrame:
    """(relation, first, second) of lines `Relation("first","second").`"""
    pattern = r'^\s*(\w+)\("?([^"]*)"?\s*,\s*"?(.*?)"?\)\.\s*$'
    part = lambda k: F.regexp_extract("value", pattern, k)
    return spark.read.text(path).select(part(1).alias("relation"), part(2).alias("first"), part(3).alias("second")).where("relation <> ''")


def report(spark: SparkSession, path: str | None) -> DataFrame:
    """Issues of a JSON report (one array); no path and a missing file are an empty report."""
    if path is None:
        return spark.createDataFrame([], ISSUE)
    return or_empty(spark, ISSUE, lambda: spark.read.schema(ISSUE).json(path, multiLine=True))


def costs(spark: SparkSession, path: str | None) -> DataFrame:
    if path is None:
        return spark.createDataFrame([], COST_ITEM)
    return or_empty(spark, COST_ITEM, lambda: spark.read.schema(COST_ITEM).json(path, multiLine=True))


def profiler_samples(spark: SparkSession, path: str) -> DataFrame:
    """(test, class, method, signature), one row for each method of a test."""
    s = spark.read.schema(SAMPLES).json(path, multiLine=True)
    return s.select("test", F.explode("methods").alias("m")).select("test", "m.*").distinct()


def taint_specs(spark: SparkSession, path: str) -> DataFrame:
    """(procedure, kind, index): kind and kinds are joined, a spec without either is of kind Other, an index is -1 if not given."""
    s = spark.read.schema(TAINT_SPEC).json(path, multiLine=True)
    kinds = F.array_compact(F.array_union(F.array("kind"), F.coalesce("kinds", F.array().cast("array<string>"))))
    kinds = F.when(F.size(kinds) == 0, F.array(F.lit("Other"))).otherwise(kinds)
    return s.select("procedure", F.explode(kinds).alias("kind"), F.coalesce("index", F.lit("-1")).alias("index"))


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Objects of files that hold one a line."""
    return spark.read.schema(schema).json(path)


def json_object(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Objects of files that hold one object or one array of them, over any number of lines; a file is read by one task."""
    return spark.read.schema(schema).json(path, multiLine=True)


def method_matchers(spark: SparkSession, path: str) -> DataFrame:
    """(matcher, class_prefix, class_regex, method, super) of an array of matchers; a field that isn't given matches everything."""
    return spark.read.schema(f"matcher string, {MATCHER}").json(path, multiLine=True)


def matching_methods(methods: DataFrame, matchers: DataFrame) -> DataFrame:
    """(matcher, class, method): methods (class, method) that a matcher names: the class begins with its prefix and has its
    pattern, and the method's name is its own. Matchers are a specification of bounded size, so they are sent to the methods."""
    m = F.broadcast(matchers.select("matcher", "class_prefix", "class_regex", F.col("method").alias("name")))
    fits = (F.col("class_prefix").isNull() | F.col("class").startswith(F.col("class_prefix"))) & (F.col("class_regex").isNull() | F.expr("class RLIKE class_regex")) & (F.col("name").isNull() | (F.col("name") == F.col("method")))
    return methods.join(m, fits).select("matcher", "class", "method")


def files(spark: SparkSession, folder: str, glob: str = "*", without: str | None = None) -> DataFrame:
    """(path, length) of all files under a folder that match the glob, without those whose path below the folder holds a string."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(folder).select("path", "length")
    if without is None:
        return found
    # what stands behind the folder, whatever store and slashes its name begins with
    below = folder.split(":", 1)[-1].strip("/")
    return found.where(~F.substring_index("path", f"{below}/", -1).contains(without))


def issue_folder(spark: SparkSession, folder: str) -> DataFrame:
    """Issues (JSON lines) of all files of a folder gathered by procedure."""
    found = spark.read.schema(ISSUE).option("recursiveFileLookup", "true").json(folder)
    return found.groupBy("procedure").agg(F.array_sort(F.collect_set("hash")).alias("hashes"), F.count(F.lit(1)).alias("n"))


def graph_tables(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of a graph stored as two Parquet tables."""
    return spark.read.parquet(f"{folder}/nodes"), spark.read.parquet(f"{folder}/edges")


def feather(spark: SparkSession, path: str, columns: list[str] | list[int] | None = None) -> DataFrame:
    """An Arrow IPC file, by column names or numbers; read on the driver, so for files of a size that fits it."""
    import pyarrow.feather as pf

    return spark.createDataFrame(pf.read_table(path, columns=columns))


def anchors(pages: DataFrame, html: str = "html") -> DataFrame:
    """(page columns, title, text) of anchors with a title."""
    pattern = r'<a [^>]*title="([^"]*)"[^>]*>([^<]*)</a>'
    found = F.arrays_zip(F.regexp_extract_all(html, F.lit(pattern), F.lit(1)).alias("title"), F.regexp_extract_all(html, F.lit(pattern), F.lit(2)).alias("text"))
    return pages.withColumn("__a", F.explode(found)).select(*[c for c in pages.columns if c != html], F.col("__a.title").alias("title"), F.col("__a.text").alias("text"))


def kafka(spark: SparkSession, servers: str, topic: str) -> DataFrame:
    """A topic as a stream; needs Spark's Kafka package on the class path."""
    return spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic).load()


def descendants(paths: DataFrame, path: str = "path") -> DataFrame:
    """(path, ancestor) for each folder above a path: a prefix join without comparing all pairs."""
    parts = F.split(path, "/")
    ups = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/"))
    return paths.where(F.col(path).contains("/")).select(path, F.explode(ups).alias("ancestor")).where("ancestor <> ''")
