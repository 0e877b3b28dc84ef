"""Set operations, nested collections, order-sensitive operators, differential reports and costs."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from stratalake.functions import values
from stratalake.operators import diff, windows
from stratalake.plans.views import CURRENT, PREVIOUS, reports
from stratalake.registry import query

A = "(SELECT DISTINCT c_nationkey AS k FROM customer WHERE c_custkey % 3 = 0 AND c_nationkey < 18)"
B = "(SELECT DISTINCT s_nationkey AS k FROM supplier WHERE s_nationkey > 4)"


def _sets(t):
    a = t("customer").where("c_custkey % 3 = 0 AND c_nationkey < 18").select(F.col("c_nationkey").alias("k"))
    return a, t("supplier").where("s_nationkey > 4").select(F.col("s_nationkey").alias("k"))


@query("set_union", ops="U1 U6 U3", sql=f"SELECT k FROM {A} UNION SELECT k FROM {B}")
def set_union(spark, t):
    a, b = _sets(t)
    return a.union(b).distinct()


@query("set_intersection", ops="U5", sql=f"SELECT k FROM {A} INTERSECT SELECT k FROM {B}")
def set_intersection(spark, t):
    a, b = _sets(t)
    return a.intersect(b)


@query("set_difference", ops="U4", sql=f"SELECT k FROM {A} EXCEPT SELECT k FROM {B}")
def set_difference(spark, t):
    a, b = _sets(t)
    return a.subtract(b)


@query("relative_complements", ops="U8 U10 U9", sql=f"SELECT coalesce(a.k, b.k) AS k, CASE WHEN b.k IS NULL THEN 'left' WHEN a.k IS NULL THEN 'right' ELSE 'both' END AS side FROM {A} a FULL JOIN {B} b ON a.k = b.k")
def relative_complements(spark, t):
    a, b = _sets(t)
    a, b = a.distinct().withColumn("l", F.lit(True)), b.distinct().withColumn("r", F.lit(True))
    return a.join(b, "k", "full_outer").select("k", F.when(F.col("r").isNull(), "left").when(F.col("l").isNull(), "right").otherwise("both").alias("side"))


@query("bag_concat", ops="U2 U11 S14", sql="SELECT n_name AS name, count(*) AS n FROM (SELECT n_name FROM nation UNION ALL SELECT n_name FROM nation WHERE n_nationkey > 10) GROUP BY n_name")
def bag_concat(spark, t):
    n = t("nation").select(F.col("n_name").alias("name"))
    return n.unionByName(t("nation").where("n_nationkey > 10").select(F.col("n_name").alias("name")), allowMissingColumns=True).groupBy("name").agg(F.count(F.lit(1)).alias("n"))


@query("append_without_repeats", ops="U7", sql="SELECT p_partkey, array_to_string(list_concat(a, list_filter(['ring', 'blue'], lambda x: NOT list_contains(a, x))), ' ') AS words FROM (SELECT p_partkey, string_split(p_name, ' ') AS a FROM part WHERE len(list_distinct(string_split(p_name, ' '))) = len(string_split(p_name, ' ')))")
def append_without_repeats(spark, t):
    a = F.split("p_name", " ")
    return t("part").where(F.size(F.array_distinct(a)) == F.size(a)).select("p_partkey", F.array_join(F.array_union(a, F.array(F.lit("ring"), F.lit("blue"))), " ").alias("words"))


@query("flatten_lists", ops="U11 N11", sql="SELECT n_regionkey, CAST(sum(length(n_name)) AS BIGINT) AS letters, count(*) AS n FROM nation GROUP BY n_regionkey")
def flatten_lists(spark, t):
    lists = t("nation").groupBy("n_regionkey", (F.col("n_nationkey") % 2).alias("h")).agg(F.collect_list("n_name").alias("names"))
    flat = lists.groupBy("n_regionkey").agg(F.flatten(F.collect_list("names")).alias("names"))
    return flat.select("n_regionkey", F.explode("names").alias("x")).groupBy("n_regionkey").agg(F.sum(F.length("x")).alias("letters"), F.count(F.lit(1)).alias("n"))


W = "(SELECT p_partkey, list_transform(string_split(p_name, ' '), lambda x: length(x)) AS a FROM part)"


@query(
    "array_functions",
    ops="N1 N2 N3 N6 N7 P16 A12",
    sql=f"SELECT p_partkey, CAST(list_sum(list_transform(a, lambda x: x * 2)) AS BIGINT) AS doubled, len(list_filter(a, lambda x: x > 4)) AS longer, len(list_distinct(a)) < len(a) AS repeats, array_to_string(list_transform(a, lambda x: CASE WHEN x > 4 THEN 4 ELSE x END), ',') AS capped, CASE WHEN list_min(a) > 3 THEN array_to_string(list_transform(a, lambda x: x - 3), ',') END AS less FROM {W}",
)
def array_functions(spark, t):
    p = t("part").select("p_partkey", F.transform(F.split("p_name", " "), lambda x: F.length(x)).alias("a"))
    less = values.traverse(F.col("a"), lambda x: F.when(x > 3, x - 3))
    return p.select("p_partkey", F.aggregate("a", F.lit(0).cast("long"), lambda s, x: s + x * 2).alias("doubled"), F.size(F.filter("a", lambda x: x > 4)).cast("long").alias("longer"), (F.size(F.array_distinct("a")) < F.size("a")).alias("repeats"), F.array_join(F.transform("a", lambda x: F.least(x, F.lit(4))), ",").alias("capped"), F.array_join(less, ",").alias("less"))


@query("zip_unzip", ops="N4 N5 N10", sql="SELECT n_regionkey, array_to_string(list_transform(list_zip(k, v), lambda x: concat(x[1], '=', x[2])), ';') AS zipped, array_to_string(k[2:], ',') AS popped FROM (SELECT n_regionkey, list(n_nationkey ORDER BY n_nationkey) AS k, list(n_name ORDER BY n_nationkey) AS v FROM nation GROUP BY n_regionkey)")
def zip_unzip(spark, t):
    s = t("nation").groupBy("n_regionkey").agg(F.sort_array(F.collect_list(F.struct("n_nationkey", "n_name"))).alias("s"))
    pairs = F.zip_with(F.transform("s", lambda x: x["n_nationkey"]), F.transform("s", lambda x: x["n_name"]), lambda a, b: F.concat(a.cast("string"), F.lit("="), b))
    return s.select("n_regionkey", F.array_join(pairs, ";").alias("zipped"), F.array_join(F.slice(F.transform("s", lambda x: x["n_nationkey"]), 2, 1 << 20), ",").alias("popped"))


@query("map_functions", ops="N8", sql="SELECT n_regionkey, CAST(sum(CASE WHEN n_nationkey > 5 THEN n_nationkey ELSE 0 END) AS BIGINT) AS over_five, count(*) FILTER (n_nationkey > 5) AS n FROM nation GROUP BY n_regionkey")
def map_functions(spark, t):
    m = t("nation").groupBy("n_regionkey").agg(F.map_from_entries(F.collect_list(F.struct("n_name", "n_nationkey"))).alias("m"))
    kept = F.map_filter("m", lambda k, v: v > 5)
    return m.select("n_regionkey", F.aggregate(F.map_values(kept), F.lit(0).cast("long"), lambda s, x: s + x).alias("over_five"), F.size(F.map_keys(kept)).cast("long").alias("n"))


@query("alias_strong_update", ops="N13 N14 D11", sql="SELECT user_id, array_to_string(list_sort(list_distinct(list_append(list_filter(a, lambda x: x <> 'view'), 'seen'))), ',') AS aliases FROM (SELECT user_id, list(DISTINCT event_type) AS a FROM events GROUP BY user_id HAVING bool_or(event_type = 'view'))")
def alias_strong_update(spark, t):
    from stratalake.operators.dataflow import strong_update

    a = t("events").groupBy("user_id").agg(F.collect_set("event_type").alias("a")).where(F.array_contains("a", "view"))
    return a.select("user_id", F.array_join(strong_update(F.col("a"), F.lit("view"), F.lit("seen")), ",").alias("aliases"))


@query("access_paths", ops="D12 D13 F30", sql="SELECT p_partkey, CASE WHEN len(a) > 1 THEN concat(a[1], '.*') ELSE a[1] END AS limited, CASE WHEN a[1] = 'red' THEN array_to_string(list_concat(['blue', 'sky'], a[2:]), '.') ELSE array_to_string(a, '.') END AS moved FROM (SELECT p_partkey, string_split(p_name, ' ') AS a FROM part)")
def access_paths(spark, t):
    from stratalake.operators.dataflow import limited_path, replaced_prefix

    a = F.split("p_name", " ")
    return t("part").select("p_partkey", F.array_join(limited_path(a, 1), ".").alias("limited"), F.array_join(replaced_prefix(a, F.array(F.lit("red")), F.array(F.lit("blue"), F.lit("sky"))), ".").alias("moved"))


@query("polynomials", ops="F29", sql="SELECT p_partkey, CAST(CASE WHEN p_size % 3 = 0 THEN 2 WHEN p_size % 3 = 1 THEN 3 ELSE 0 END AS INTEGER) AS degree FROM part")
def polynomials(spark, t):
    text = F.when(F.col("p_size") % 3 == 0, "3 + 2 ⋅ n ⋅ m").when(F.col("p_size") % 3 == 1, "5 ⋅ n^3 + m").otherwise("7")
    return t("part").select("p_partkey", values.polynomial_degree(text).alias("degree"))


@query("combine_adjacent", ops="W7", sql="SELECT conv_id, count(*) AS turns FROM (SELECT conv_id, role, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM conversations) WHERE before IS NULL OR before <> role GROUP BY conv_id")
def combine_adjacent(spark, t):
    c = t("conversations").groupBy("conv_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("turn", "role"))), lambda x: x["role"]).alias("roles"))
    return c.select("conv_id", F.size(values.combine_adjacent(F.col("roles"), lambda a, b: a == b, lambda a, b: a)).cast("long").alias("turns"))


@query("consecutive_pairs", ops="W2 W6", sql="SELECT user_id, event_type AS first, nxt AS second FROM (SELECT user_id, event_type, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nxt FROM events) WHERE nxt IS NOT NULL")
def consecutive_pairs(spark, t):
    return windows.consecutive(t("events"), "user_id", ["ts", "event_id"], "event_type")


@query("dedup_consecutive", ops="W3", sql="SELECT event_id FROM (SELECT event_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b FROM events) WHERE NOT (b IS NOT NULL AND b = event_type AND event_type IN ('view', 'click'))")
def dedup_consecutive(spark, t):
    return windows.without_repeats(t("events"), "user_id", ["ts", "event_id"], "event_type", F.col("event_type").isin("view", "click")).select("event_id")


@query("fold_last", ops="W4", sql="SELECT user_id, CAST(sum(CASE WHEN last THEN 100 ELSE 1 END) AS BIGINT) AS total FROM (SELECT user_id, lead(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) IS NULL AS last FROM events) GROUP BY user_id")
def fold_last(spark, t):
    last = F.lead("event_id").over(Window.partitionBy("user_id").orderBy("ts", "event_id")).isNull()
    return t("events").select("user_id", F.when(last, 100).otherwise(1).alias("x")).groupBy("user_id").agg(F.sum("x").alias("total"))


@query(
    "diff_directives",
    ops="W5",
    sql="WITH d AS (SELECT conv_id AS k, string_agg(CASE role WHEN 'user' THEN CASE WHEN conv_id % 3 = 0 THEN 'O' ELSE 'N' END ELSE CASE WHEN conv_id % 5 = 0 THEN 'O' ELSE 'U' END END, '' ORDER BY turn) AS s FROM conversations GROUP BY conv_id), c AS (SELECT k, generate_subscripts(string_split(s, ''), 1) AS i, unnest(string_split(s, '')) AS c FROM d), h AS (SELECT k, c, count(*) FILTER (c <> 'O') OVER w AS line, c = 'N' OR (c = 'U' AND coalesce(lag(c) OVER (PARTITION BY k ORDER BY i) = 'O', FALSE)) AS hit FROM c WINDOW w AS (PARTITION BY k ORDER BY i)) SELECT k, CASE WHEN bool_and(c = 'O') THEN '1' ELSE coalesce(array_to_string(list_sort(list(DISTINCT line) FILTER (hit)), ','), '') END AS lines FROM h GROUP BY k",
)
def diff_directives(spark, t):
    c = F.when(F.col("role") == "user", F.when(F.col("conv_id") % 3 == 0, "O").otherwise("N")).otherwise(F.when(F.col("conv_id") % 5 == 0, "O").otherwise("U"))
    s = t("conversations").groupBy(F.col("conv_id").alias("k")).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("turn", c.alias("c")))), lambda x: x["c"]), "").alias("s"))
    return diff.affected_lines(s, "k", "s").select("k", F.array_join("lines", ",").alias("lines"))


@query("lru_retention", ops="W8", sql="SELECT user_id, event_type FROM (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY last DESC) AS n FROM (SELECT user_id, event_type, max(event_id) AS last FROM events GROUP BY user_id, event_type)) WHERE n <= 3")
def lru_retention(spark, t):
    return windows.recent(t("events"), "user_id", "event_type", ["event_id"], 3).select("user_id", "event_type")


@query("length_window", ops="W9 R5", sql="SELECT event_id, CAST(sum(CAST(round(value * 100) AS BIGINT)) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS 9 PRECEDING) AS BIGINT) AS cents FROM events")
def length_window(spark, t):
    w = windows.length_window(t("events"), "user_id", ["ts", "event_id"], 10)
    return t("events").select("event_id", F.sum(F.round(F.col("value") * 100).cast("long")).over(w).alias("cents"))


@query("distinct_window", ops="W10 R6", sql="SELECT event_id FROM (SELECT event_id, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS n FROM events) WHERE n = 1")
def distinct_window(spark, t):
    w = Window.partitionBy("user_id", "event_type").orderBy("ts", "event_id")
    return t("events").withColumn("n", F.row_number().over(w)).where("n = 1").select("event_id")


@query("priority_ranking", ops="W11", sql="SELECT dst, preds, row_number() OVER (ORDER BY preds, dst) AS place FROM (SELECT l_partkey % 60 AS dst, count(DISTINCT l_suppkey) AS preds FROM lineitem GROUP BY 1)")
def priority_ranking(spark, t):
    preds = t("lineitem").groupBy((F.col("l_partkey") % 60).alias("dst")).agg(F.countDistinct("l_suppkey").alias("preds"))
    return windows.dense_index(preds, ["preds", "dst"], "place").select("dst", "preds", (F.col("place") + 1).cast("long").alias("place"))


@query("take_until_length", ops="W12", sql="SELECT conv_id, turn FROM (SELECT conv_id, turn, coalesce(sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM conversations) WHERE b < 300")
def take_until_length(spark, t):
    return windows.take_until(t("conversations"), "conv_id", ["turn"], F.length("text"), 300).select("conv_id", "turn")


DIFF = f"(SELECT *, 'introduced' AS status FROM {CURRENT} WHERE hash NOT IN (SELECT hash FROM {PREVIOUS}) UNION ALL SELECT *, 'fixed' FROM {PREVIOUS} WHERE hash NOT IN (SELECT hash FROM {CURRENT}) UNION ALL SELECT *, 'preexisting' FROM {CURRENT} WHERE hash IN (SELECT hash FROM {PREVIOUS}))"


@query("report_diff", ops="J14 Q1 U8", sql=f"SELECT hash, line, status FROM {DIFF}")
def report_diff(spark, t):
    return diff.report_diff(*reports(t)).select("hash", "line", "status")


@query("report_diff_paths", ops="P14 Q3 Q1", sql=f"SELECT hash, line, status FROM {DIFF} WHERE status = 'introduced' OR file IN (SELECT concat('src/f', s_suppkey, '.java') FROM supplier WHERE s_suppkey % 2 = 0)")
def report_diff_paths(spark, t):
    paths = t("supplier").where("s_suppkey % 2 = 0").select(F.concat(F.lit("src/f"), F.col("s_suppkey").cast("string"), F.lit(".java")).alias("file"))
    return diff.only_paths(diff.report_diff(*reports(t)), paths, ("fixed", "preexisting")).select("hash", "line", "status")


RENAMES = "(SELECT concat('src/f', s_suppkey, '.java') AS current, concat('src/f', s_suppkey + 1, '.java') AS previous FROM supplier WHERE s_suppkey % 3 = 0)"
OLD = f"(SELECT d.*, CASE WHEN status = 'introduced' THEN coalesce(r.previous, d.file) ELSE d.file END AS old FROM {DIFF} d LEFT JOIN {RENAMES} r ON d.file = r.current)"


@query("report_diff_renamed", ops="J15 Q2", sql=f"WITH o AS (SELECT * FROM {OLD}) SELECT hash, line, status FROM o WHERE status = 'preexisting' OR (status = 'introduced' AND NOT EXISTS (SELECT 1 FROM o p WHERE p.status = 'fixed' AND p.bug_type = o.bug_type AND p.old = o.old)) OR (status = 'fixed' AND NOT EXISTS (SELECT 1 FROM o p WHERE p.status = 'introduced' AND p.bug_type = o.bug_type AND p.old = o.old))")
def report_diff_renamed(spark, t):
    name = lambda k: F.concat(F.lit("src/f"), k.cast("string"), F.lit(".java"))
    renames = t("supplier").where("s_suppkey % 3 = 0").select(name(F.col("s_suppkey")).alias("current"), name(F.col("s_suppkey") + 1).alias("previous"))
    return diff.skip_duplicated_types(diff.report_diff(*reports(t)), renames).select("hash", "line", "status")


COST = "(SELECT o_custkey AS procedure, max(CASE WHEN o_totalprice > 460000 THEN NULL WHEN o_totalprice < 3000 THEN -1 ELSE CAST(floor(o_totalprice / 100000) AS BIGINT) END) AS degree FROM orders WHERE {} GROUP BY o_custkey)"
EARLY, LATE = COST.format("o_orderdate < TIMESTAMP '1998-06-01'"), COST.format("o_orderdate >= TIMESTAMP '1998-06-01'")


def _costs(t):
    price = F.col("o_totalprice")
    degree = F.max(F.when(price > 460000, None).when(price < 3000, F.lit(-1).cast("long")).otherwise(F.floor(price / 100000))).alias("degree")
    early = F.col("o_orderdate") < F.lit("1998-06-01").cast("timestamp_ntz")
    side = lambda c: t("orders").where(c).groupBy(F.col("o_custkey").alias("procedure")).agg(degree)
    return side(~early), side(early)


@query("cost_degree_histogram", ops="A10 Q5", sql=f"SELECT coalesce(c.degree, p.degree) AS degree, coalesce(c.n, 0) AS current, coalesce(p.n, 0) AS previous FROM (SELECT degree, count(*) AS n FROM {LATE} WHERE degree IS NOT NULL GROUP BY degree) c FULL JOIN (SELECT degree, count(*) AS n FROM {EARLY} WHERE degree IS NOT NULL GROUP BY degree) p ON c.degree = p.degree")
def cost_degree_histogram(spark, t):
    now, before = _costs(t)
    return diff.degree_histogram(now.where("degree IS NOT NULL"), before.where("degree IS NOT NULL"))


@query("cost_degree_change", ops="Q4", sql=f"SELECT c.procedure, p.degree AS before, c.degree AS now, CASE WHEN c.degree IS NULL THEN 'INFINITE_EXECUTION_TIME' WHEN c.degree < 0 THEN 'UNREACHABLE' ELSE 'COMPLEXITY_INCREASE' END AS kind FROM {LATE} c JOIN {EARLY} p ON c.procedure = p.procedure WHERE (c.degree IS NULL AND p.degree IS NOT NULL) OR (c.degree < 0 AND p.degree >= 0) OR c.degree > p.degree")
def cost_degree_change(spark, t):
    return diff.cost_change(*_costs(t))


@query("cost_totals", ops="Q5", sql="SELECT kind, CAST(sum(v) AS BIGINT) AS total FROM (SELECT 'exec' AS kind, l_linenumber AS v FROM lineitem UNION ALL SELECT 'alloc', CAST(l_quantity AS INTEGER) FROM lineitem) GROUP BY kind")
def cost_totals(spark, t):
    l = t("lineitem").select(F.col("l_linenumber").alias("exec"), F.col("l_quantity").cast("int").alias("alloc"), F.lit(1).alias("one"))
    return l.unpivot(["one"], ["exec", "alloc"], "kind", "v").groupBy("kind").agg(F.sum("v").alias("total"))
