"""Sources, sinks, catalogue and extension points: each query writes a table in some form to the shared folder and reads it back."""

from __future__ import annotations

import os
import tempfile
import uuid

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from stratalake.functions.methods import jni_arguments
from stratalake.operators import windows
from stratalake.operators.graph import cut
from stratalake.plans.views import SPARSE, sparse
from stratalake.registry import query
from stratalake.sources import readers, writers
from stratalake.streaming import engine


def _folder(spark: SparkSession, name: str) -> str:
    cut(spark.range(1))  # sets the shared folder where it is unset
    return f"{spark.conf.get('spark.checkpoint.dir').rstrip('/')}/{name}-{uuid.uuid4().hex}"


@query("source_csv", ops="S1 K1 K4", sql="SELECT n_nationkey, n_name FROM nation")
def source_csv(spark, t):
    at = _folder(spark, "csv")
    writers.csv(windows.dense_index(t("nation").select("n_nationkey", "n_name"), ["n_nationkey"]).select("index", "n_nationkey", "n_name"), at)
    return readers.csv(spark, at, "n_nationkey int, n_name string")


@query("source_lines", ops="S3 K3", sql="SELECT s_name AS value FROM supplier")
def source_lines(spark, t):
    at = _folder(spark, "lines")
    writers.lines(t("supplier").select(F.concat("s_name", F.lit("   ")).alias("value")), "value", at)
    return readers.lines(spark, at)


@query("source_first_field", ops="S2", sql="SELECT CAST(s_suppkey AS VARCHAR) AS value FROM supplier")
def source_first_field(spark, t):
    at = _folder(spark, "tabs")
    writers.lines(t("supplier").select(F.concat_ws("\t", F.col("s_suppkey").cast("string"), "s_name").alias("value")), "value", at)
    return readers.first_field(spark, at)


@query("source_facts", ops="S4", sql="SELECT CASE WHEN s_suppkey % 2 = 0 THEN 'Source' ELSE 'Sink' END AS relation, CAST(s_nationkey AS VARCHAR) AS first, concat('<A: int ', s_suppkey, '()>') AS second FROM supplier")
def source_facts(spark, t):
    at = _folder(spark, "facts")
    fact = F.format_string('%s("%s","<A: int %s()>").', F.when(F.col("s_suppkey") % 2 == 0, "Source").otherwise("Sink"), F.col("s_nationkey").cast("string"), F.col("s_suppkey").cast("string"))
    writers.lines(t("supplier").select(fact.alias("value")), "value", at)
    return readers.datalog_facts(spark, at)


@query("source_json", ops="S5", sql="SELECT r_regionkey, r_name FROM region")
def source_json(spark, t):
    at = _folder(spark, "json")
    writers.json(t("region"), at)
    return readers.json_lines(spark, at, "r_regionkey int, r_name string")


@query("pretty_json", ops="K2 S5", sql="SELECT n_nationkey, n_name, n_regionkey FROM nation")
def pretty_json(spark, t):
    at = _folder(spark, "pretty")
    writers.json_arrays(t("nation"), at)
    return readers.json_object(spark, at, "n_nationkey int, n_name string, n_regionkey int")


@query("source_report", ops="S6", sql="SELECT concat(event_id, '') AS hash, event_type AS bug_type, concat('f', user_id) AS file, CAST(event_id AS INTEGER) AS line FROM events")
def source_report(spark, t):
    at = _folder(spark, "report")
    e = t("events")
    writers.json_arrays(e.select(F.col("event_id").cast("string").alias("hash"), F.col("event_type").alias("bug_type"), F.concat(F.lit("f"), F.col("user_id").cast("string")).alias("file"), F.col("event_id").cast("int").alias("line")), at)
    # no path, and a file that isn't there, are empty reports
    both = readers.report(spark, at).unionByName(readers.report(spark, None)).unionByName(readers.report(spark, f"{at}-none"))
    return both.select("hash", "bug_type", "file", "line")


@query("source_costs", ops="S6 Q5", sql="SELECT concat(o_orderkey, '') AS hash, concat('p', o_custkey) AS procedure_name, CAST(o_orderkey % 4 AS INTEGER) * 100 AS degree FROM orders")
def source_costs(spark, t):
    at = _folder(spark, "costs")
    cost = F.struct(F.lit("x").alias("polynomial"), (F.col("o_orderkey") % 4 * 100).cast("int").alias("degree"))
    writers.json_arrays(t("orders").select(F.col("o_orderkey").cast("string").alias("hash"), F.concat(F.lit("p"), F.col("o_custkey").cast("string")).alias("procedure_name"), cost.alias("exec_cost")), at)
    return readers.costs(spark, at).unionByName(readers.costs(spark, f"{at}-none")).select("hash", "procedure_name", F.col("exec_cost.degree").alias("degree"))


@query("source_samples", ops="S7", sql="SELECT DISTINCT concat('t', l_suppkey) AS test, concat('C', l_partkey % 10) AS class, concat('m', l_partkey) AS method FROM lineitem")
def source_samples(spark, t):
    at = _folder(spark, "samples")
    method = F.struct(F.concat(F.lit("C"), (F.col("l_partkey") % 10).cast("string")).alias("class"), F.concat(F.lit("m"), F.col("l_partkey").cast("string")).alias("method"), F.lit("()V").alias("signature"))
    writers.json_arrays(t("lineitem").groupBy(F.concat(F.lit("t"), F.col("l_suppkey").cast("string")).alias("test")).agg(F.collect_list(method).alias("methods")), at)
    return readers.profiler_samples(spark, at).select("test", "class", "method")


@query("source_taint_specs", ops="S8", sql="SELECT concat('p', n_nationkey) AS procedure, unnest(CASE n_nationkey % 4 WHEN 0 THEN ['A'] WHEN 1 THEN ['A', 'B'] WHEN 2 THEN ['B', 'C'] ELSE ['Other'] END) AS kind, CASE WHEN n_nationkey % 5 = 0 THEN '1' ELSE '-1' END AS index FROM nation")
def source_taint_specs(spark, t):
    at = _folder(spark, "specs")
    k = F.col("n_nationkey") % 4
    kinds = F.when(k == 1, F.array(F.lit("A"), F.lit("B"))).when(k == 2, F.array(F.lit("B"), F.lit("C")))
    writers.json_arrays(t("nation").select(F.concat(F.lit("p"), F.col("n_nationkey").cast("string")).alias("procedure"), F.when(k < 2, "A").alias("kind"), kinds.alias("kinds"), F.when(F.col("n_nationkey") % 5 == 0, "1").alias("index")), at)
    return readers.taint_specs(spark, at)


@query("method_matchers", ops="S9", sql="SELECT 'brand' AS matcher, p_brand AS class, p_name AS method FROM part WHERE starts_with(p_brand, 'Brand#1') AND regexp_matches(p_brand, '[24]$') UNION ALL SELECT 'bolt', p_brand, p_name FROM part WHERE p_name = 'red bolt'")
def method_matchers(spark, t):
    at = _folder(spark, "matchers")
    writers.json_arrays(spark.createDataFrame([("brand", "Brand#1", "[24]$", None), ("bolt", None, None, "red bolt")], "matcher string, class_prefix string, class_regex string, method string"), at)
    return readers.matching_methods(t("part").select(F.col("p_brand").alias("class"), F.col("p_name").alias("method")), readers.method_matchers(spark, at))


@query("source_csvs", ops="S14", sql="SELECT n_nationkey, n_name FROM nation UNION ALL SELECT r_regionkey, r_name FROM region")
def source_csvs(spark, t):
    at = _folder(spark, "csvs")
    writers.csv(t("nation").select("n_nationkey", "n_name"), f"{at}/a")
    writers.csv(t("region").select(F.col("r_regionkey").alias("n_nationkey"), F.col("r_name").alias("n_name")), f"{at}/b")
    return readers.csvs(spark, [f"{at}/a", f"{at}/missing", f"{at}/b"], "n_nationkey int, n_name string")


@query("source_anchors", ops="S16", sql="SELECT page_id, url AS title, 'see ' || page_id AS text FROM pages UNION ALL SELECT page_id, 'home', 'Home' FROM pages")
def source_anchors(spark, t):
    link = lambda title, text: F.concat(F.lit('<a href="#" title="'), title, F.lit('" class="x">'), text, F.lit("</a>"))
    page = F.concat(F.lit("<p>"), link(F.col("url"), F.concat(F.lit("see "), F.col("page_id").cast("string"))), F.lit('<a href="#">no title</a>'), link(F.lit("home"), F.lit("Home")))
    return readers.anchors(t("pages").select("page_id", page.alias("html")))


@query("diff_files", ops="K6", sql="SELECT o_orderstatus AS status, concat(o_orderkey, '') AS hash FROM orders")
def diff_files(spark, t):
    at = _folder(spark, "diff")
    writers.diff_files(t("orders").select(F.col("o_orderstatus").alias("status"), F.col("o_orderkey").cast("string").alias("hash")), at)
    return spark.read.schema("hash string, status string").json(at).select("status", "hash")


@query("dot_edges", ops="K9", sql=f"SELECT concat('\"', src, '\" -> \"', dst, '\" [label=\"call\"]') AS value FROM {SPARSE}")
def dot_edges(spark, t):
    return writers.dot(sparse(t).withColumn("kind", F.lit("call")))


@query("sink_batches", ops="K11 R12", sql="SELECT (row_number() OVER (ORDER BY event_id) - 1) // 50 AS batch, event_id FROM events")
def sink_batches(spark, t):
    return writers.numbered_batches(t("events").select("event_id"), ["event_id"], writers.BATCH["cassandra"])


@query("stream_catalogue", ops="R1 R2 R4", sql="SELECT n_nationkey AS a, n_name AS b, CAST(NULL AS INTEGER) AS c FROM nation WHERE n_regionkey < 3 UNION ALL SELECT r_regionkey, r_name, 7 FROM region")
def stream_catalogue(spark, t):
    e = engine.Engine(spark, _folder(spark, "streams"))
    e.create("other", "x int")
    e.create("facts", "a int, b string")
    e.insert("facts", t("nation").select(F.col("n_nationkey").alias("a"), F.col("n_name").alias("b"), "n_regionkey").where("n_regionkey < 3").drop("n_regionkey"))
    e.alter("facts", "c int")
    e.insert("facts", t("region").select(F.col("r_regionkey").alias("a"), F.col("r_name").alias("b"), F.lit(7).alias("c")))
    e.create("kept", "a int, b string, c int")
    e.add("copy", "facts", lambda s: s, "kept")
    e.settle()
    e.remove("facts/copy")
    e.drop("other")
    return spark.read.schema(e.streams["kept"]).parquet(e.path("kept"))


@query("source_folder", ops="S13", sql="SELECT CAST(count(DISTINCT r_regionkey) AS BIGINT) AS files FROM region")
def source_folder(spark, t):
    at = _folder(spark, "tree")
    t("region").withColumn("k", F.col("r_regionkey")).repartition(1).write.partitionBy("k").parquet(at)
    return readers.files(spark, at, "*.parquet", "test").agg(F.count(F.lit(1)).alias("files"))


@query("source_graph", ops="S15 K5", sql=f"SELECT src, dst FROM {SPARSE} WHERE dst IN (SELECT p_partkey FROM part)")
def source_graph(spark, t):
    at = _folder(spark, "graph")
    writers.result_map(t("part").select(F.col("p_partkey").alias("node")), f"{at}/nodes")
    writers.result_map(sparse(t), f"{at}/edges")
    nodes, edges = readers.graph_tables(spark, at)
    return edges.join(nodes.withColumnRenamed("node", "dst"), "dst", "left_semi").select("src", "dst")


@query("issue_store", ops="S18 K8", sql="SELECT event_type AS procedure, count(*) AS n, count(DISTINCT concat(user_id, '_', event_type)) AS hashes FROM events GROUP BY event_type")
def issue_store(spark, t):
    at = _folder(spark, "issues")
    issues = t("events").select(F.concat_ws("_", F.col("user_id").cast("string"), "event_type").alias("hash"), F.col("event_type").alias("procedure"), (F.col("user_id") % 3).alias("file"))
    writers.issue_store(issues, at)
    return readers.issue_folder(spark, at).select("procedure", "n", F.size("hashes").cast("long").alias("hashes"))


@query("text_report", ops="K7", sql="SELECT concat_ws(', ', event_type, CAST(user_id AS VARCHAR)) AS value FROM events")
def text_report(spark, t):
    return writers.report_lines(t("events"), ["event_type", "user_id"])


@query("literal_code", ops="K10", sql="SELECT n_regionkey, concat('[', string_agg(concat('\"', n_name, '\"'), '; ' ORDER BY n_name), ']') AS literal FROM nation GROUP BY n_regionkey")
def literal_code(spark, t):
    return t("nation").groupBy("n_regionkey").agg(writers.literal_list(F.sort_array(F.collect_list("n_name"))).alias("literal"))


@query("feather_scan", ops="S19", sql="SELECT n_name, n_regionkey FROM nation")
def feather_scan(spark, t):
    import pyarrow.feather as pf

    # 25 rows: an Arrow file is read on the driver, so it is written there as well
    with tempfile.TemporaryDirectory() as d:
        pf.write_feather(t("nation").toArrow(), os.path.join(d, "nation.feather"))
        return readers.feather(spark, os.path.join(d, "nation.feather"), ["n_name", "n_regionkey"])


@query("path_forest", ops="S21", sql="SELECT page_id, 'site/' || regexp_extract(url, '//([^/?#]+)', 1) AS ancestor FROM pages UNION ALL SELECT page_id, 'site' FROM pages")
def path_forest(spark, t):
    p = t("pages").select("page_id", F.concat(F.lit("site/"), F.regexp_extract("url", r"//([^/?#]+)", 1), F.lit("/"), F.col("page_id").cast("string")).alias("path"))
    return readers.descendants(p).select(F.regexp_extract("path", r"([^/]*)$", 1).cast("long").alias("page_id"), "ancestor")


@query("catalogue_columns", ops="S23", sql="SELECT * FROM (VALUES ('n_nationkey', 'int'), ('n_name', 'string'), ('n_regionkey', 'int')) c(name, kind)")
def catalogue_columns(spark, t):
    name = f"nation_{uuid.uuid4().hex}"
    t("nation").createOrReplaceTempView(name)
    found = [(c.name, c.dataType) for c in spark.catalog.listColumns(name)]
    spark.catalog.dropTempView(name)
    return spark.createDataFrame(found, "name string, kind string")


@query("scan_statistics", ops="S20", sql="SELECT min(l_partkey) AS low, max(l_partkey) AS high, count(*) AS n FROM lineitem")
def scan_statistics(spark, t):
    return t("lineitem").agg(F.min("l_partkey").alias("low"), F.max("l_partkey").alias("high"), F.count(F.lit(1)).alias("n"))


@query("selection_vector", ops="P17", sql="SELECT CAST(k - 1 AS BIGINT) AS at FROM (SELECT row_number() OVER (ORDER BY p_partkey) AS k, p_size FROM part) WHERE p_size BETWEEN 10 AND 20")
def selection_vector(spark, t):
    return windows.dense_index(t("part").select("p_partkey", "p_size"), ["p_partkey"], "at").where("p_size BETWEEN 10 AND 20").select("at")


@query("function_kinds", ops="A21 F33 E7 E3", sql="SELECT p_brand, count(*) AS n, max(p_size) AS scalar_max, max(p_size) AS vector_max FROM part GROUP BY p_brand")
def function_kinds(spark, t):
    # an aggregate, a scalar function over an aggregate, and an aggregate of one's own on whole vectors
    @F.pandas_udf("int")
    def vector_max(v: pd.Series) -> int:
        return int(v.max())

    own = t("part").groupBy("p_brand").agg(vector_max("p_size").alias("vector_max"))
    return t("part").groupBy("p_brand").agg(F.count(F.lit(1)).alias("n"), F.greatest(F.max("p_size"), F.lit(-1)).alias("scalar_max")).join(own, "p_brand")


@query("jni_signatures", ops="F17", sql="SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN 'int,java.lang.String,long[]' WHEN p_size % 3 = 1 THEN '' END AS arguments FROM part")
def jni_signatures(spark, t):
    s = F.when(F.col("p_size") % 3 == 0, "(ILjava/lang/String;[J)V").when(F.col("p_size") % 3 == 1, "()I").otherwise("no signature")
    return t("part").select("p_partkey", jni_arguments()(s).alias("arguments"))


@query("variant_members", ops="N12", sql="SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events")
def variant_members(spark, t):
    return t("events").select("event_id", F.try_variant_get(F.parse_json("props"), "$.k", "int").alias("k"))


@query("cached_guides", ops="L12", sql="SELECT n_regionkey, count(*) AS n FROM nation GROUP BY n_regionkey")
def cached_guides(spark, t):
    held = t("nation").cache()
    out = cut(held.groupBy("n_regionkey").agg(F.count(F.lit(1)).alias("n")))
    held.unpersist()
    return out


@query("table_changes", ops="L1 L9", sql="SELECT r_regionkey AS k, r_name AS name, CASE WHEN r_regionkey < 3 THEN 'old' ELSE 'new' END AS state FROM region")
def table_changes(spark, t):
    name = f"facts_{uuid.uuid4().hex}"
    spark.sql(f"CREATE TABLE {name}_regions (k INT, name STRING) USING parquet")
    t("region").where("r_regionkey < 3").select("r_regionkey", "r_name").write.insertInto(f"{name}_regions")
    spark.sql(f"ALTER TABLE {name}_regions ADD COLUMNS (state STRING)")
    t("region").where("r_regionkey >= 3").select("r_regionkey", "r_name", F.lit("new")).write.insertInto(f"{name}_regions")
    out = cut(spark.table(f"{name}_regions").withColumn("state", F.coalesce("state", F.lit("old"))))
    spark.sql(f"DROP TABLE {name}_regions")
    return out


@query("registered_queries", ops="E1 E2")
def registered_queries(spark, t):
    from stratalake import registry

    return spark.createDataFrame([(name, " ".join(q.ops)) for name, q in registry.all_queries().items()], "name string, ops string")


@query(
    "stream_length_window",
    ops="R5 W9 E6",
    sql="SELECT user_id AS key, event_id AS seq, CAST(count(*) OVER w AS INTEGER) AS n, round(sum(value) OVER w, 4) AS total FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS 9 PRECEDING)",
)
def stream_length_window(spark, t):
    at = _folder(spark, "ring")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rows = t("events").select(F.col("user_id").alias("key"), F.col("event_id").alias("seq"), "value")
    rows.write.parquet(f"{at}/in")
    out = engine.length_windows(spark.readStream.schema(rows.schema).parquet(f"{at}/in"), 10)
    schema = out.schema

    def put(df, n: int) -> None:
        df.write.mode("overwrite").parquet(f"{at}/out/batch={n:06d}")

    out.writeStream.foreachBatch(put).option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(schema).parquet(f"{at}/out").select("key", "seq", "n", F.round("total", 4).alias("total"))
