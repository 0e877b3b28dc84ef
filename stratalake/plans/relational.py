"""Projections, filters, joins and aggregations over program facts."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from stratalake.functions import values
from stratalake.functions.methods import decapitalised, parameter_types, parse_method_fact, parse_method_id
from stratalake.operators import bayes, diff, similarity, tables, windows
from stratalake.plans.views import CALLS, METHOD_IDS, METHODS, calls, method_ids, methods
from stratalake.registry import query

ALIKE = "(contains(a.name, b.name) OR contains(b.name, a.name) OR left(a.name, 2) = left(b.name, 2))"
SCORE = f"(CASE WHEN a.class = b.class THEN 10 ELSE 0 END + CASE WHEN {ALIKE} THEN 10 ELSE 0 END + CASE WHEN a.rtntype = b.rtntype THEN 10 ELSE 0 END + CASE WHEN a.intype = b.intype THEN 10 ELSE 0 END)"


@query("similarity_pairs", ops="J1 W1 P1 F4", sql=f"SELECT a.index AS id1, b.index AS id2, {SCORE} AS score FROM {METHODS} a JOIN {METHODS} b ON a.index < b.index WHERE {SCORE} >= 20")
def similarity_pairs(spark, t):
    return similarity.similar_pairs(methods(t))


@query("similarity_orientation", ops="W1 P7 P8", sql=f"WITH p AS (SELECT DISTINCT least(src, dst) AS a, greatest(src, dst) AS b FROM {CALLS} WHERE src <> dst) SELECT a, b FROM p")
def similarity_orientation(spark, t):
    c = calls(t).withColumn("order", F.col("src") * 1_000_000 + F.col("dst"))
    return similarity.one_orientation(c, "src", "dst", "order").select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"))


@query(
    "node_parse",
    ops="F1 F5 P1",
    sql=rf"SELECT p_partkey, regexp_extract(id, '^([^ ]*) ([^(]*)\.([^.(]*)\((.*)\)', 1) AS rtntype, regexp_extract(id, '^([^ ]*) ([^(]*)\.([^.(]*)\((.*)\)', 2) AS class, regexp_extract(id, '^([^ ]*) ([^(]*)\.([^.(]*)\((.*)\)', 3) AS name, CASE WHEN regexp_extract(id, '\((.*)\)', 1) = '' THEN 'void' ELSE regexp_extract(id, '\((.*)\)', 1) END AS intype FROM {METHOD_IDS}",
)
def node_parse(spark, t):
    return method_ids(t).select("p_partkey", *(c.alias(k) for k, c in parse_method_id(F.col("id")).items()))


@query(
    "fact_parse",
    ops="F2 F6 F3",
    sql="SELECT p_partkey, concat('pkg.', p_brand) AS class, p_type AS rtntype, replace(p_name, ' ', '_') AS name, CASE WHEN p_size % 5 = 0 THEN 'void' ELSE CAST(p_size AS VARCHAR) END AS intype FROM part",
)
def fact_parse(spark, t):
    fact = F.concat(F.lit("<pkg."), "p_brand", F.lit(": "), "p_type", F.lit(" "), F.replace("p_name", F.lit(" "), F.lit("_")), F.lit("("), F.when(F.col("p_size") % 5 == 0, "").otherwise(F.col("p_size").cast("string")), F.lit(")>"))
    return t("part").select("p_partkey", *(c.alias(k) for k, c in parse_method_fact(fact).items()))


@query("dense_index", ops="P2", sql="SELECT p_partkey, p_name, CAST(row_number() OVER (ORDER BY p_name, p_partkey) - 1 AS BIGINT) AS index FROM part")
def dense_index(spark, t):
    return windows.dense_index(t("part").select("p_partkey", "p_name"), ["p_name", "p_partkey"])


@query("token_filter", ops="P3 P5 P9 P11", sql="SELECT page_id, url FROM pages WHERE NOT regexp_matches(url, '\\$|__|spam|cheap|\\?|#') AND contains(url, '/en/')")
def token_filter(spark, t):
    return t("pages").where(~F.col("url").rlike(r"\$|__|spam|cheap|\?|#") & F.col("url").contains("/en/")).select("page_id", "url")


@query("constructor_filter", ops="P4 P6 P18", sql="SELECT event_id, event_type FROM events WHERE event_type NOT IN ('error', 'view') AND user_id IN (1, 2, 3, 5, 8, 13)")
def constructor_filter(spark, t):
    return t("events").where(~F.col("event_type").isin("error", "view") & F.col("user_id").isin(1, 2, 3, 5, 8, 13)).select("event_id", "event_type")


@query("procedure_filter", ops="P10 P9", sql="SELECT doc_id, source, lang FROM documents WHERE regexp_matches(source, '^(?:src1)') AND regexp_matches(lang, '^(?:en|fr)')")
def procedure_filter(spark, t):
    file, proc = "src1:en|fr".split(":", 1)
    return t("documents").where(F.col("source").rlike(f"^(?:{file})") & F.col("lang").rlike(f"^(?:{proc})")).select("doc_id", "source", "lang")


@query("test_edges_excluded", ops="P12 P13", sql=f"SELECT src, dst FROM {CALLS} WHERE src % 10 <> 0 AND dst % 10 <> 0")
def test_edges_excluded(spark, t):
    return calls(t).where((F.col("src") % 10 != 0) & (F.col("dst") % 10 != 0))


@query("prefix_suffix", ops="P15 F3", sql="SELECT o_orderkey, rtrim(o_orderpriority, 'W') AS priority FROM orders WHERE starts_with(o_orderpriority, '5-') OR suffix(o_orderpriority, 'HIGH')")
def prefix_suffix(spark, t):
    p = F.col("o_orderpriority")
    return t("orders").where(p.startswith("5-") | p.endswith("HIGH")).select("o_orderkey", F.expr("rtrim('W', o_orderpriority)").alias("priority"))


@query("page_of_orders", ops="O8 P19 F23", sql="SELECT o_orderkey, strftime(o_orderdate, '%Y/%m/%d') AS published FROM orders WHERE o_orderstatus = 'F' AND o_orderdate < TIMESTAMP '1999-01-01' ORDER BY o_orderdate DESC, o_orderkey LIMIT 20 OFFSET 20")
def page_of_orders(spark, t):
    o = t("orders").where((F.col("o_orderstatus") == "F") & (F.col("o_orderdate") < F.lit("1999-01-01").cast("timestamp_ntz")))
    return o.orderBy(F.col("o_orderdate").desc(), "o_orderkey").offset(20).limit(20).select("o_orderkey", F.date_format("o_orderdate", "yyyy/MM/dd").alias("published"))


@query("orders_by_month", ops="F20 F22 A1 A2", sql="SELECT CAST(year(o_orderdate) AS INTEGER) AS y, CAST(month(o_orderdate) AS INTEGER) AS m, CAST(day(o_orderdate) AS INTEGER) AS d, count(*) AS n FROM orders GROUP BY ALL")
def orders_by_month(spark, t):
    d = F.col("o_orderdate")
    return t("orders").groupBy(F.year(d).alias("y"), F.month(d).alias("m"), F.dayofmonth(d).alias("d")).agg(F.count(F.lit(1)).alias("n"))


@query("local_days", ops="F21", sql="SELECT event_id, CAST(CAST(ts - INTERVAL 1 MINUTE AS DATE) AS VARCHAR) AS day FROM events")
def local_days(spark, t):
    return t("events").select("event_id", F.to_date(F.col("ts") - F.expr("INTERVAL 1 MINUTE")).cast("string").alias("day"))


@query("hide_profiles", ops="P20 L10", sql="SELECT c_custkey, c_nationkey NOT IN (1, 2, 3) OR c_nationkey IS NULL AS hidden FROM customer")
def hide_profiles(spark, t):
    k = F.col("c_nationkey")
    return t("customer").select("c_custkey", (~k.isin(1, 2, 3) | k.isNull()).alias("hidden"))


@query("more_defined_exists", ops="P21", sql="SELECT o.o_orderkey, o.o_custkey FROM orders o WHERE NOT EXISTS (SELECT 1 FROM orders p WHERE p.o_custkey = o.o_custkey AND p.o_totalprice > o.o_totalprice)")
def more_defined_exists(spark, t):
    o = t("orders").select("o_orderkey", "o_custkey", "o_totalprice")
    top = o.groupBy("o_custkey").agg(F.max("o_totalprice").alias("top"))
    return o.join(top, "o_custkey").where("o_totalprice = top").select("o_orderkey", "o_custkey")


@query("array_contains", ops="P22 P23", sql="SELECT doc_id FROM documents WHERE list_contains(string_split(text, ' '), 'the') AND lang IS NOT NULL")
def array_contains(spark, t):
    return t("documents").where(F.array_contains(F.split("text", " "), "the") & F.col("lang").isNotNull()).select("doc_id")


@query("positional_merge", ops="J2", sql="WITH a AS (SELECT s_name, row_number() OVER (ORDER BY s_suppkey) AS k FROM supplier), b AS (SELECT c_name, row_number() OVER (ORDER BY c_custkey DESC) AS k FROM customer) SELECT s_name, c_name FROM a JOIN b USING (k)")
def positional_merge(spark, t):
    a = windows.dense_index(t("supplier").select("s_suppkey", "s_name"), ["s_suppkey"], "k")
    b = windows.dense_index(t("customer").select((-F.col("c_custkey")).alias("o"), "c_name"), ["o"], "k")
    return a.join(b, "k").select("s_name", "c_name")


@query("left_indicator_accuracy", ops="J3 A9 T9 P6", sql="SELECT d.lang, avg(CASE WHEN l.doc_id IS NOT NULL AND l.quality = 1 THEN 1.0 ELSE 0.0 END) AS accuracy, count(*) AS n FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id GROUP BY d.lang")
def left_indicator_accuracy(spark, t):
    l = t("labels").select("doc_id", "quality")
    both = t("documents").select("doc_id", "lang").join(l, "doc_id", "left")
    return both.groupBy("lang").agg(F.avg(F.when(F.col("quality") == 1, 1.0).otherwise(0.0)).alias("accuracy"), F.count(F.lit(1)).alias("n"))


@query("composite_membership", ops="J4 J5 P14", sql="SELECT s_suppkey, s_nationkey FROM supplier s WHERE EXISTS (SELECT 1 FROM customer c WHERE c.c_nationkey = s.s_nationkey AND c.c_mktsegment = 'MACHINERY')")
def composite_membership(spark, t):
    c = t("customer").where("c_mktsegment = 'MACHINERY'").select(F.col("c_nationkey").alias("s_nationkey"))
    return t("supplier").join(c, "s_nationkey", "left_semi").select("s_suppkey", "s_nationkey")


@query("candidates_without_rich", ops="J6 U4", sql="SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000)")
def candidates_without_rich(spark, t):
    return t("customer").select("c_custkey").join(t("orders").where("o_totalprice > 400000").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti")


@query("method_class_substring", ops="J7 X5", sql="SELECT p_partkey, class FROM part JOIN (SELECT DISTINCT string_split(p_name, ' ')[1] AS class FROM part) ON contains(p_name, class)")
def method_class_substring(spark, t):
    classes = t("part").select(F.split("p_name", " ")[0].alias("class")).distinct()
    return similarity.containing(t("part").select("p_partkey", "p_name"), "p_name", classes, "class").select("p_partkey", "class")


@query("unordered_pairs", ops="J8 G16", sql="SELECT a.n_name AS a, b.n_name AS b FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey")
def unordered_pairs(spark, t):
    a = t("nation").select(F.col("n_name").alias("a"), F.col("n_regionkey").alias("r"), F.col("n_nationkey").alias("ka"))
    b = t("nation").select(F.col("n_name").alias("b"), F.col("n_regionkey").alias("r"), F.col("n_nationkey").alias("kb"))
    return a.join(b, "r").where("ka < kb").select("a", "b")


CASES = "(SELECT a.i AS c1, b.i AS c2, c.i AS c3, d.i AS c4 FROM range(1, 5) a(i), range(1, 5) b(i), range(1, 5) c(i), range(1, 5) d(i))"


def _w(c: str) -> str:
    return f"(CASE {c} WHEN 1 THEN 1 WHEN 2 THEN 8 WHEN 3 THEN 192 ELSE 1024 END)"


TOTAL = "(" + " + ".join(_w(f"c{k}") for k in range(1, 5)) + ")"


@query("cpt_table", ops="J9 A4 F11 F12 E8", sql="SELECT " + ", ".join(f"CAST(c{k} AS INTEGER) AS c{k}" for k in range(1, 5)) + ", " + ", ".join(f"round(CAST({_w(f'c{k}')} AS DOUBLE) / {TOTAL}, 9) AS w{k}" for k in range(1, 5)) + f" FROM {CASES}")
def cpt_table(spark, t):
    return bayes.cpt(spark).select("c1", "c2", "c3", "c4", *(F.round(f"w{k}", 9).alias(f"w{k}") for k in range(1, 5)))


@query("summary_lookup", ops="J10 S17", sql="SELECT l.doc_id, l.quality, d.lang FROM labels l JOIN documents d ON d.doc_id = l.doc_id")
def summary_lookup(spark, t):
    return t("labels").join(t("documents").select("doc_id", "lang"), "doc_id").select("doc_id", "quality", "lang")


@query("file_procedures", ops="J11", sql="SELECT o_custkey, l_partkey FROM orders JOIN lineitem ON o_orderkey = l_orderkey")
def file_procedures(spark, t):
    return t("orders").join(t("lineitem"), F.col("o_orderkey") == F.col("l_orderkey")).select("o_custkey", "l_partkey")


@query(
    "report_lines_in_ranges",
    ops="J12 Q8",
    sql="WITH c AS (SELECT conv_id % 7 AS file, turn * 3 + conv_id % 11 AS line, conv_id FROM conversations), r AS (SELECT doc_id % 7 AS file, doc_id % 13 AS start_line, doc_id % 13 + quality * 4 AS end_line, doc_id FROM labels) SELECT DISTINCT c.conv_id, r.doc_id FROM c JOIN r ON c.file = r.file AND c.line BETWEEN r.start_line AND r.end_line",
)
def report_lines_in_ranges(spark, t):
    c = t("conversations").select((F.col("conv_id") % 7).alias("file"), (F.col("turn") * 3 + F.col("conv_id") % 11).alias("line"), "conv_id")
    r = t("labels").select((F.col("doc_id") % 7).alias("file"), (F.col("doc_id") % 13).alias("start_line"), (F.col("doc_id") % 13 + F.col("quality") * 4).alias("end_line"), "doc_id")
    return diff.line_hits(c, r, 8).select("conv_id", "doc_id").distinct()


@query(
    "test_selection",
    ops="J12 J13 Q9",
    sql="WITH m AS (SELECT doc_id, doc_id % 7 AS file, doc_id % 13 AS a, doc_id % 13 + 4 AS b FROM labels), hit AS (SELECT DISTINCT doc_id FROM m JOIN (SELECT DISTINCT conv_id % 7 AS file, turn * 5 AS line FROM conversations) c ON c.file = m.file AND c.line BETWEEN a AND b), s AS (SELECT DISTINCT l_suppkey AS test, l_partkey AS method FROM lineitem) SELECT DISTINCT test FROM s JOIN hit ON method = doc_id",
)
def test_selection(spark, t):
    m = t("labels").select("doc_id", (F.col("doc_id") % 7).alias("file"), (F.col("doc_id") % 13).alias("start_line"), (F.col("doc_id") % 13 + 4).alias("end_line"))
    c = t("conversations").select((F.col("conv_id") % 7).alias("file"), (F.col("turn") * 5).alias("line")).distinct()
    hit = diff.line_hits(c, m, 8).select("doc_id").distinct()
    samples = t("lineitem").select(F.col("l_suppkey").alias("test"), F.col("l_partkey").alias("doc_id"))
    return samples.join(hit, "doc_id", "left_semi").select("test").distinct()


@query(
    "full_outer_merge",
    ops="J16 J17 L11",
    sql="SELECT coalesce(c.k, s.k) AS k, coalesce(c.v, s.v) AS v, CASE WHEN s.k IS NULL THEN 'left' WHEN c.k IS NULL THEN 'right' WHEN c.v = s.v THEN 'same' ELSE 'both' END AS side FROM (SELECT c_custkey AS k, c_nationkey AS v FROM customer WHERE c_acctbal > 0) c FULL JOIN (SELECT s_suppkey AS k, s_nationkey AS v FROM supplier) s ON c.k = s.k",
)
def full_outer_merge(spark, t):
    c = t("customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("k"), F.col("c_nationkey").alias("a"))
    s = t("supplier").select(F.col("s_suppkey").alias("k"), F.col("s_nationkey").alias("b"))
    side = F.when(F.col("b").isNull(), "left").when(F.col("a").isNull(), "right").when(F.col("a") == F.col("b"), "same").otherwise("both")
    return c.join(s, "k", "full_outer").select("k", F.coalesce("a", "b").alias("v"), side.alias("side"))


@query("map_union_left", ops="J17 N8", sql="SELECT coalesce(a.k, b.k) AS k, coalesce(a.v, b.v) AS v FROM (SELECT n_nationkey AS k, n_name AS v FROM nation WHERE n_nationkey < 15) a FULL JOIN (SELECT n_nationkey AS k, lower(n_name) AS v FROM nation WHERE n_nationkey > 9) b ON a.k = b.k")
def map_union_left(spark, t):
    n = t("nation").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("v"))
    return tables.merged_left(n.where("k < 15"), n.where("k > 9").withColumn("v", F.lower("v")), "k", "v")


@query("kind_matching", ops="J18", sql="SELECT s_suppkey AS source, c_custkey AS sink, s_nationkey AS kind FROM supplier JOIN customer ON s_nationkey = c_nationkey")
def kind_matching(spark, t):
    s = t("supplier").select(F.col("s_suppkey").alias("source"), F.col("s_nationkey").alias("kind"))
    return s.join(t("customer").select(F.col("c_custkey").alias("sink"), F.col("c_nationkey").alias("kind")), "kind").select("source", "sink", "kind")


@query("path_extension", ops="J19", sql=f"SELECT a.src, b.dst, count(*) AS n FROM {CALLS} a JOIN {CALLS} b ON a.dst = b.src GROUP BY a.src, b.dst")
def path_extension(spark, t):
    a, b = calls(t).select("src", F.col("dst").alias("mid")), calls(t).select(F.col("src").alias("mid"), "dst")
    return a.join(b, "mid").groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"))


@query("reference_tables", ops="J20 J21", sql="SELECT r_name, n_name, count(*) AS n FROM region JOIN nation ON r_regionkey = n_regionkey JOIN customer ON c_nationkey = n_nationkey WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') GROUP BY ALL")
def reference_tables(spark, t):
    n = t("region").join(t("nation"), F.col("r_regionkey") == F.col("n_regionkey"))
    return n.join(t("customer").where(F.col("c_mktsegment").isin("BUILDING", "MACHINERY")), F.col("c_nationkey") == F.col("n_nationkey")).groupBy("r_name", "n_name").agg(F.count(F.lit(1)).alias("n"))


@query("callee_counts", ops="A2 A3 A23", sql=f"SELECT p_partkey, count(src) AS n FROM part LEFT JOIN {CALLS} ON dst = p_partkey GROUP BY p_partkey")
def callee_counts(spark, t):
    n = calls(t).groupBy(F.col("dst").alias("p_partkey")).agg(F.count("src").alias("n"))
    return t("part").select("p_partkey").join(n, "p_partkey", "left").select("p_partkey", F.coalesce("n", F.lit(0)).alias("n"))


@query("in_degree_cap", ops="A5", sql="SELECT c_nationkey, count(*) AS n FROM (SELECT DISTINCT c_nationkey, c_mktsegment, c_custkey % 3 AS g FROM customer) GROUP BY c_nationkey HAVING count(*) < 15")
def in_degree_cap(spark, t):
    return t("customer").select("c_nationkey", "c_mktsegment", (F.col("c_custkey") % 3).alias("g")).distinct().groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("n")).where("n < 15")


@query("group_sets", ops="A6 A13 K10", sql="SELECT p_brand, array_to_string(list_sort(list(DISTINCT p_type)), '; ') AS types FROM part GROUP BY p_brand")
def group_sets(spark, t):
    return t("part").groupBy("p_brand").agg(F.array_join(F.sort_array(F.collect_set("p_type")), "; ").alias("types"))


@query("marker_groups", ops="A7", sql="SELECT user_id, g AS group_no, count(*) AS n FROM (SELECT user_id, CAST(sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS g FROM events) GROUP BY ALL")
def marker_groups(spark, t):
    return windows.marked_groups(t("events"), "user_id", ["ts", "event_id"], F.col("event_type") == "error").groupBy("user_id", "group_no").agg(F.count(F.lit(1)).alias("n"))


@query(
    "argmax_label",
    ops="A8 F13 T9",
    sql="SELECT vec_id, CASE WHEN a = b AND b = c AND c = d THEN 'unscorable' WHEN a >= b AND a >= c AND a >= d THEN 'src' WHEN b >= c AND b >= d THEN 'sin' WHEN c >= d THEN 'san' ELSE 'non' END AS label FROM (SELECT vec_id, embedding[1] AS a, embedding[2] AS b, embedding[3] AS c, embedding[4] AS d FROM embeddings)",
)
def argmax_label(spark, t):
    e = F.col("embedding")
    return t("embeddings").select("vec_id", values.arg_max([e[0], e[1], e[2], e[3]], ["src", "sin", "san", "non"], "unscorable").alias("label"))


@query("normalise_rows", ops="A4 F12", sql="SELECT p_partkey, round(p_size / nullif(p_size + p_retailprice, 0), 9) AS share FROM part")
def normalise_rows(spark, t):
    return t("part").select("p_partkey", F.round(values.normalised([F.col("p_size").cast("double"), F.col("p_retailprice")])[0], 9).alias("share"))


@query("map_sums", ops="A11 U12 A22", sql="SELECT k, CAST(sum(v) AS BIGINT) AS v FROM (SELECT l_partkey % 50 AS k, l_linenumber AS v FROM lineitem UNION ALL SELECT o_custkey % 50, -1 FROM orders) GROUP BY k HAVING sum(v) <> 0")
def map_sums(spark, t):
    a = t("lineitem").select((F.col("l_partkey") % 50).alias("k"), F.col("l_linenumber").alias("v"))
    return a.unionByName(t("orders").select((F.col("o_custkey") % 50).alias("k"), F.lit(-1).alias("v"))).groupBy("k").agg(F.sum("v").alias("v")).where("v <> 0")


@query("boolean_aggregates", ops="A12 D15", sql="SELECT l_suppkey, bool_or(l_returnflag = 'R') AS some, bool_and(l_quantity > 1) AS every FROM lineitem GROUP BY l_suppkey")
def boolean_aggregates(spark, t):
    return t("lineitem").groupBy("l_suppkey").agg(F.bool_or(F.col("l_returnflag") == "R").alias("some"), F.bool_and(F.col("l_quantity") > 1).alias("every"))


@query("set_intersection_aggregate", ops="A14", sql="WITH p AS (SELECT DISTINCT user_id, event_type FROM events), n AS (SELECT count(DISTINCT user_id) AS n FROM events) SELECT event_type FROM p, n GROUP BY event_type, n.n HAVING count(*) = n.n")
def set_intersection_aggregate(spark, t):
    p = t("events").select("user_id", "event_type").distinct()
    n = p.select(F.countDistinct("user_id").alias("users"))
    return p.groupBy("event_type").agg(F.count(F.lit(1)).alias("c")).join(F.broadcast(n), F.col("c") == F.col("users")).select("event_type")


@query("min_element", ops="A15 A16 O9", sql="SELECT user_id, arg_min(event_id, ts) AS first_event, arg_max(event_id, ts) AS last_event, CASE count(*) WHEN 0 THEN 'zero' WHEN 1 THEN 'one' ELSE 'many' END AS size FROM events GROUP BY user_id")
def min_element(spark, t):
    return t("events").groupBy("user_id").agg(F.min_by("event_id", "ts").alias("first_event"), F.max_by("event_id", "ts").alias("last_event"), F.when(F.count(F.lit(1)) == 1, "one").otherwise("many").alias("size"))


@query("latest_location", ops="A17", sql="SELECT user_id, event_type, max_by(value, event_id) AS value FROM events GROUP BY user_id, event_type")
def latest_location(spark, t):
    return t("events").groupBy("user_id", "event_type").agg(F.max_by("value", "event_id").alias("value"))


@query("compensated_sum", ops="A18", sql="SELECT l_suppkey, CAST(sum(CAST(l_extendedprice AS DECIMAL(38, 12))) AS DOUBLE) AS total FROM lineitem GROUP BY l_suppkey")
def compensated_sum(spark, t):
    return t("lineitem").groupBy("l_suppkey").agg(tables.compensated_sum("l_extendedprice").alias("total"))


@query("metric_events", ops="A19 R9", sql="SELECT event_type AS label, 'count' AS kind, count(*) AS n, round(min(value), 6) AS low, round(max(value), 6) AS high FROM events GROUP BY event_type")
def metric_events(spark, t):
    return t("events").groupBy(F.col("event_type").alias("label"), F.lit("count").alias("kind")).agg(F.count(F.lit(1)).alias("n"), F.round(F.min("value"), 6).alias("low"), F.round(F.max("value"), 6).alias("high"))


@query("string_templates", ops="F9 F8 F10 F32 K9", sql="SELECT n_nationkey, concat(lower(left(n_name, 1)), substring(n_name, 2)) AS legal, concat(n_regionkey, '--in-->', n_nationkey) AS edge, concat('`', n_name, '`') AS mono, regexp_replace(concat('a/b/', n_name, '.java'), '\\.java$', '') AS stem, string_split(concat('a/b/', n_name), '/')[-1] AS leaf FROM nation")
def string_templates(spark, t):
    n = F.col("n_name")
    return t("nation").select("n_nationkey", decapitalised(n).alias("legal"), F.format_string("%d--in-->%d", "n_regionkey", "n_nationkey").alias("edge"), F.concat(F.lit("`"), n, F.lit("`")).alias("mono"), F.regexp_replace(F.concat(F.lit("a/b/"), n, F.lit(".java")), r"\.java$", "").alias("stem"), F.element_at(F.split(F.concat(F.lit("a/b/"), n), "/"), -1).alias("leaf"))


@query("parameter_types", ops="F7", sql="SELECT n_nationkey, concat('int,', n_name) AS types FROM nation")
def parameter_list(spark, t):
    return t("nation").select("n_nationkey", parameter_types(F.concat(F.lit("int a, "), "n_name", F.lit(" b"))).alias("types"))


@query(
    "operator_algebra",
    ops="F14 F15 F16",
    sql="SELECT p_partkey, p_size + 3 AS plus, p_size * 3 AS times, p_size % 3 AS rest, p_size & 6 AS band, p_size | 6 AS bor, xor(p_size, 6) AS bxor, p_size << 2 AS shl, p_size >> 1 AS shr, -p_size AS neg, ~p_size AS inv, NOT (p_size < 3) AS ge FROM part",
)
def operator_algebra(spark, t):
    s = F.col("p_size")
    b, u, k = values.BINARY, values.UNARY, F.lit
    return t("part").select("p_partkey", b["+"](s, k(3)).alias("plus"), b["*"](s, k(3)).alias("times"), b["%"](s, k(3)).alias("rest"), b["&"](s, k(6)).alias("band"), b["|"](s, k(6)).alias("bor"), b["^"](s, k(6)).alias("bxor"), b["<<"](s, k(2)).alias("shl"), b[">>"](s, k(1)).alias("shr"), u["-"](s).alias("neg"), u["~"](s).alias("inv"), b[values.NEGATED["<"]](s, k(3)).alias("ge"))


@query("regex_rewrite", ops="F18 F28", sql="SELECT page_id, length(regexp_replace(html, '<[^>]+>', '', 'g')) AS n, md5(regexp_replace(html, '<title>(.*?)</title>', '[\\1]', 'g')) AS rewritten FROM pages")
def regex_rewrite(spark, t):
    h = F.col("html")
    return t("pages").select("page_id", F.length(F.regexp_replace(h, "<[^>]+>", "")).cast("long").alias("n"), F.md5(F.regexp_replace(h, "<title>(.*?)</title>", "[$1]")).alias("rewritten"))


@query("url_extract", ops="F19", sql="SELECT page_id, coalesce(nullif(regexp_extract(url, 'http[^\\s<\"]*', 0), ''), '#') AS first_url, len(regexp_extract_all(html, '<a href=\"([^\"]*)\"', 1)) AS links, regexp_extract(html, '<a href=\"([^\"]*)\"', 1) AS first_link FROM pages")
def url_extract(spark, t):
    a = r'<a href="([^"]*)"'
    return t("pages").select("page_id", F.coalesce(F.nullif(F.regexp_extract("url", r'http[^\s<"]*', 0), F.lit("")), F.lit("#")).alias("first_url"), F.size(F.regexp_extract_all("html", F.lit(a), F.lit(1))).cast("long").alias("links"), F.regexp_extract("html", a, 1).alias("first_link"))


@query("md5_url", ops="F24 F25", sql="SELECT c_custkey, concat('https://avatars.example.org/', md5(lower(c_name)), '?s=80') AS url, decode(from_base64(to_base64(encode(c_name)))) AS again FROM customer")
def md5_url(spark, t):
    return t("customer").select("c_custkey", F.format_string("https://avatars.example.org/%s?s=80", F.md5(F.lower("c_name"))).alias("url"), F.unbase64(F.base64(F.col("c_name").cast("binary"))).cast("string").alias("again"))


@query("version_parse", ops="F26 F27", sql="SELECT p_partkey, concat(p_size, '.', p_partkey % 10, '.RELEASE') AS version, CAST(p_size AS INTEGER) AS major, CASE WHEN upper(p_type) IN ('ECONOMY', 'PROMO') THEN upper(p_type) ELSE 'UNKNOWN' END AS kind FROM part")
def version_parse(spark, t):
    v = F.concat(F.col("p_size").cast("string"), F.lit("."), (F.col("p_partkey") % 10).cast("string"), F.lit(".RELEASE"))
    return t("part").select("p_partkey", v.alias("version"), F.regexp_extract(v, r"^(\d+)\.", 1).cast("int").alias("major"), values.enum_or(F.col("p_type"), ["ECONOMY", "PROMO"]).alias("kind"))


@query("json_props", ops="F31", sql="SELECT event_id, coalesce(json_extract_string(props, '$.k'), '-1') AS k, coalesce(json_extract_string(props, '$.procedure'), 'none') AS procedure FROM events")
def json_props(spark, t):
    p = F.col("props")
    return t("events").select("event_id", values.member_or(p, "$.k", F.lit("-1")).alias("k"), values.member_or(p, "$.procedure", F.lit("none")).alias("procedure"))


@query("severity_topk", ops="O1 O4 O12", sql="SELECT o_orderkey, o_orderpriority FROM orders ORDER BY CASE o_orderpriority WHEN '1-URGENT' THEN 1 WHEN '2-HIGH' THEN 2 WHEN '3-MEDIUM' THEN 3 ELSE 4 END, o_totalprice DESC, o_orderkey LIMIT 50")
def severity_topk(spark, t):
    known = F.array(F.lit("1-URGENT"), F.lit("2-HIGH"), F.lit("3-MEDIUM"))
    at = F.array_position(known, F.col("o_orderpriority"))
    return t("orders").orderBy(F.when(at == 0, 4).otherwise(at), F.col("o_totalprice").desc(), "o_orderkey").limit(50).select("o_orderkey", "o_orderpriority")


@query("issue_dedup", ops="O3 Q11 U3", sql="SELECT l_orderkey, l_partkey, l_linenumber FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey, l_returnflag ORDER BY l_orderkey, l_linenumber, l_extendedprice) AS n FROM lineitem) WHERE n = 1")
def issue_dedup(spark, t):
    w = Window.partitionBy("l_partkey", "l_returnflag").orderBy("l_orderkey", "l_linenumber", "l_extendedprice")
    return t("lineitem").withColumn("n", F.row_number().over(w)).where("n = 1").select("l_orderkey", "l_partkey", "l_linenumber")


@query("set_lattice_order", ops="O5 D15", sql="WITH s AS (SELECT user_id, list_sort(list(DISTINCT event_type)) AS a FROM events WHERE value > 150 GROUP BY user_id) SELECT x.user_id AS u, y.user_id AS v, CASE WHEN x.a = y.a THEN 'equal' WHEN list_has_all(y.a, x.a) THEN 'less' WHEN list_has_all(x.a, y.a) THEN 'greater' ELSE 'incomparable' END AS o FROM s x JOIN s y ON y.user_id = x.user_id + 1")
def set_lattice_order(spark, t):
    s = t("events").where("value > 150").groupBy("user_id").agg(F.sort_array(F.collect_set("event_type")).alias("a"))
    x, y = s.select(F.col("user_id").alias("u"), "a"), s.select(F.col("user_id").alias("v"), F.col("a").alias("b"))
    less, more = F.size(F.array_except("a", "b")) == 0, F.size(F.array_except("b", "a")) == 0
    return x.join(y, F.col("v") == F.col("u") + 1).select("u", "v", F.when(less & more, "equal").when(less, "less").when(more, "greater").otherwise("incomparable").alias("o"))


@query("seeded_sample", ops="O6", sql="SELECT p_partkey FROM part ORDER BY md5(concat(p_partkey, '-42')), p_partkey LIMIT 75")
def seeded_sample(spark, t):
    return t("part").orderBy(F.md5(F.concat(F.col("p_partkey").cast("string"), F.lit("-42"))), "p_partkey").limit(75).select("p_partkey")


@query("seeded_permutation", ops="O7", sql="SELECT p_partkey, row_number() OVER (ORDER BY md5(concat(p_partkey, '-7')), p_partkey) - 1 AS place FROM part")
def seeded_permutation(spark, t):
    keyed = t("part").select("p_partkey", F.md5(F.concat(F.col("p_partkey").cast("string"), F.lit("-7"))).alias("draw"))
    return windows.dense_index(keyed, ["draw", "p_partkey"], "place").select("p_partkey", "place")


@query("point_lookup", ops="S11", sql="SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderkey = 77")
def point_lookup(spark, t):
    return t("orders").where("o_orderkey = 77").select("o_orderkey", "o_custkey", "o_totalprice")


@query("bounded_disjuncts", ops="O13 D16", sql="SELECT user_id, event_id FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events) WHERE n <= 5")
def bounded_disjuncts(spark, t):
    w = Window.partitionBy("user_id").orderBy("event_id")
    return t("events").withColumn("n", F.row_number().over(w)).where("n <= 5").select("user_id", "event_id")


@query("list_surgery", ops="O10 O11 N6", sql="SELECT p_partkey, array_to_string(list_reverse(a), ' ') AS back, array_to_string(a[2:], ' ') AS rest, array_to_string(list_append(a[2:], a[1]), ' ') AS turned, CAST(coalesce(list_position(a, 'ring'), 0) AS BIGINT) AS at FROM (SELECT p_partkey, string_split(p_name, ' ') AS a FROM part)")
def list_surgery(spark, t):
    a = F.split("p_name", " ")
    rest = F.slice(a, 2, 1 << 20)
    return t("part").select("p_partkey", F.array_join(F.reverse(a), " ").alias("back"), F.array_join(rest, " ").alias("rest"), F.array_join(F.concat(rest, F.slice(a, 1, 1)), " ").alias("turned"), F.array_position(a, "ring").alias("at"))


@query("guarded_upsert", ops="L2 L3 Q10", sql="SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY length(event_type) DESC, event_id DESC) AS n FROM events) WHERE n = 1")
def guarded_upsert(spark, t):
    e = t("events").select("user_id", "event_id", "event_type", F.length("event_type").alias("rank"))
    half = F.col("event_id") % 2 == 0
    return tables.guarded_upsert(e.where(half), e.where(~half), "user_id", "rank", "event_id").select("user_id", "event_id", "event_type")


@query("shard_merge_last_wins", ops="Q10 L2 A22", sql="SELECT o_custkey, arg_max(o_orderkey, o_orderkey) AS o_orderkey FROM orders GROUP BY o_custkey")
def shard_merge_last_wins(spark, t):
    return tables.latest(t("orders").select("o_custkey", "o_orderkey"), ["o_custkey"], [F.col("o_orderkey").desc()])


@query("delete_and_mark", ops="L4", sql="SELECT c_custkey, TRUE AS stale FROM customer WHERE c_custkey NOT IN (SELECT s_suppkey FROM supplier)")
def delete_and_mark(spark, t):
    return tables.deleted(t("customer").select("c_custkey"), t("supplier").select(F.col("s_suppkey").alias("c_custkey")), ["c_custkey"]).withColumn("stale", F.lit(True))


@query("replace_rows", ops="L2", sql="SELECT n_nationkey, CASE WHEN n_nationkey % 4 = 0 THEN lower(n_name) ELSE n_name END AS n_name FROM nation")
def replace_rows(spark, t):
    n = t("nation").select("n_nationkey", "n_name")
    return tables.replaced(n, n.where("n_nationkey % 4 = 0").withColumn("n_name", F.lower("n_name")), ["n_nationkey"])


@query("constraint_checks", ops="L7 L9 L8", sql="SELECT 'orphan' AS what, count(*) AS n FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders) UNION ALL SELECT 'repeated', count(*) FROM (SELECT l_orderkey, l_linenumber FROM lineitem GROUP BY ALL HAVING count(*) > 1)")
def constraint_checks(spark, t):
    orphans = tables.violations(t("lineitem"), "l_orderkey", t("orders"), "o_orderkey").select(F.lit("orphan").alias("what"))
    twice = tables.repeated_keys(t("lineitem"), ["l_orderkey", "l_linenumber"]).select(F.lit("repeated").alias("what"))
    counted = lambda d, what: d.agg(F.count(F.lit(1)).alias("n")).select(F.lit(what).alias("what"), "n")
    return counted(orphans, "orphan").unionByName(counted(twice, "repeated"))


@query("prepared_statement", ops="L6 L5 S10 S12 S20", sql="SELECT DISTINCT l_shipdate < TIMESTAMP '1998-01-01' AS early, l_returnflag FROM lineitem WHERE l_suppkey = 7 ORDER BY 1, 2")
def prepared_statement(spark, t):
    rows = t("lineitem").select("l_shipdate", "l_returnflag", "l_suppkey")
    return spark.sql("SELECT DISTINCT l_shipdate < TIMESTAMP_NTZ '1998-01-01' AS early, l_returnflag FROM {rows} WHERE l_suppkey = :k ORDER BY 1, 2", args={"k": 7}, rows=rows)


@query("resource_balance", ops="J3 A11", sql="SELECT user_id, CAST(sum(CASE event_type WHEN 'view' THEN 1 WHEN 'purchase' THEN -1 ELSE 0 END) AS BIGINT) AS open FROM events GROUP BY user_id HAVING sum(CASE event_type WHEN 'view' THEN 1 WHEN 'purchase' THEN -1 ELSE 0 END) > 0")
def resource_balance(spark, t):
    step = F.when(F.col("event_type") == "view", 1).when(F.col("event_type") == "purchase", -1).otherwise(0)
    return t("events").groupBy("user_id").agg(F.sum(step).alias("open")).where("open > 0")


@query(
    "conflicting_accesses",
    ops="J18 P7",
    sql="WITH a AS (SELECT DISTINCT user_id, event_type, CAST(floor(value * 10) AS BIGINT) AS loc FROM events) SELECT x.user_id AS u, y.user_id AS v, x.loc FROM a x JOIN a y ON x.loc = y.loc AND x.user_id < y.user_id AND x.event_type <> y.event_type WHERE x.event_type = 'purchase' OR y.event_type = 'purchase' GROUP BY ALL",
)
def conflicting_accesses(spark, t):
    # a user's types at a place as two flags, so that each pair is made once, by its first purchase, and needs no removal of repeated ones
    bought = F.col("event_type") == "purchase"
    a = t("events").groupBy("user_id", F.floor(F.col("value") * 10).alias("loc")).agg(F.max(bought).alias("bought"), F.max(~bought).alias("other"))
    x = a.where("bought").select("loc", F.col("user_id").alias("x"), F.coalesce("other", F.lit(False)).alias("both"))
    y = a.where("other").select("loc", F.col("user_id").alias("y"), F.coalesce("bought", F.lit(False)).alias("too"))
    found = x.join(y, "loc").where("x < y OR x > y AND NOT (both AND too)")
    return found.select(F.least("x", "y").alias("u"), F.greatest("x", "y").alias("v"), "loc")
