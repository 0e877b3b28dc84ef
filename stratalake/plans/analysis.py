"""Costs and their bounds, control dependence, exceptional flow, bindings, and filters of reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from stratalake.operators import costs, dataflow, diff, graph, tables, windows
from stratalake.plans.reporting import EARLY, LATE, _costs
from stratalake.plans.views import CALLS, CURRENT, DAG, FOREST, PROCEDURES, calls, dag, forest, procedures, reports
from stratalake.registry import query

COST_A = "(SELECT p_partkey AS key, ['n'] AS monomial, CAST(p_size AS BIGINT) AS coefficient FROM part UNION ALL SELECT p_partkey, CAST([] AS VARCHAR[]), CAST(p_size % 5 AS BIGINT) FROM part WHERE p_size % 5 <> 0)"
COST_B = "(SELECT p_partkey AS key, CASE WHEN p_size % 2 = 0 THEN ['m', 'n'] ELSE ['n'] END AS monomial, CAST(CASE WHEN p_size % 2 = 0 THEN 3 ELSE 20 END AS BIGINT) AS coefficient FROM part UNION ALL SELECT p_partkey, CAST([] AS VARCHAR[]), CAST(-1 AS BIGINT) FROM part WHERE p_size % 3 = 1)"


def _polynomials(t):
    """Two costs of each part, by its size."""
    p = t("part").select(F.col("p_partkey").alias("key"), F.col("p_size").cast("long").alias("s"))
    none, n = F.array().cast("array<string>"), F.array(F.lit("n"))
    even = F.col("s") % 2 == 0
    a = p.select("key", n.alias("monomial"), F.col("s").alias("coefficient"))
    a = a.unionByName(p.where("s % 5 <> 0").select("key", none.alias("monomial"), (F.col("s") % 5).alias("coefficient")))
    b = p.select("key", F.when(even, F.array(F.lit("m"), F.lit("n"))).otherwise(n).alias("monomial"), F.when(even, 3).otherwise(20).cast("long").alias("coefficient"))
    b = b.unionByName(p.where("s % 3 = 1").select("key", none.alias("monomial"), F.lit(-1).cast("long").alias("coefficient")))
    return a, b


def _terms(cost):
    return cost.select("key", F.array_join("monomial", "*").alias("monomial"), "coefficient")


TERMS = "SELECT key, array_to_string(monomial, '*') AS monomial, CAST(coefficient AS BIGINT) AS coefficient FROM ({})"


@query("cost_plus", ops="Q6", sql=TERMS.format(f"SELECT key, monomial, sum(coefficient) AS coefficient FROM (SELECT * FROM {COST_A} UNION ALL SELECT * FROM {COST_B}) GROUP BY ALL HAVING sum(coefficient) <> 0"))
def cost_plus(spark, t):
    return _terms(costs.plus(*_polynomials(t)))


@query("cost_times", ops="Q6", sql=TERMS.format(f"SELECT key, list_sort(list_concat(a.monomial, b.monomial)) AS monomial, sum(a.coefficient * b.coefficient) AS coefficient FROM {COST_A} a JOIN {COST_B} b USING (key) GROUP BY ALL HAVING sum(a.coefficient * b.coefficient) <> 0"))
def cost_times(spark, t):
    return _terms(costs.times(*_polynomials(t)))


LEAD = "(SELECT key, d, c FROM (SELECT key, len(monomial) AS d, sum(coefficient) AS c, row_number() OVER (PARTITION BY key ORDER BY len(monomial) DESC) AS r FROM {} GROUP BY key, len(monomial)) WHERE r = 1)"


@query("cost_lesser", ops="Q6", sql=TERMS.format(f"WITH k AS (SELECT key, y.d < x.d OR (y.d = x.d AND y.c < x.c) AS second FROM {LEAD.format(COST_A)} x JOIN {LEAD.format(COST_B)} y USING (key)) SELECT a.* FROM {COST_A} a JOIN k USING (key) WHERE NOT second UNION ALL SELECT b.* FROM {COST_B} b JOIN k USING (key) WHERE second"))
def cost_lesser(spark, t):
    return _terms(costs.lesser(*_polynomials(t)))


@query("node_bounds", ops="Q7 G17", sql=f"WITH RECURSIVE e AS (SELECT src, dst FROM {FOREST} WHERE src IN (SELECT src FROM {FOREST} GROUP BY src HAVING count(*) = 1)), b AS (SELECT src, dst FROM e UNION ALL SELECT dst, src FROM e), r(node, other) AS (SELECT p_partkey, p_partkey FROM part UNION SELECT r.node, b.dst FROM r JOIN b ON b.src = r.other) SELECT r.node, CAST(min(p_size) AS BIGINT) AS bound FROM r JOIN part ON p_partkey = other GROUP BY r.node")
def node_bounds(spark, t):
    return costs.node_bounds(forest(t), t("part").select(F.col("p_partkey").alias("node"), F.col("p_size").cast("long").alias("bound")))


FLOW = f"(SELECT graph, node AS src, CASE WHEN (graph, node + 1) IN (SELECT graph, node FROM {PROCEDURES}) THEN node + 1 END AS dst FROM {PROCEDURES} UNION SELECT graph, node, node // 4 FROM {PROCEDURES} WHERE node % 5 = 0 AND node > 4 UNION SELECT graph, node, node + 3 FROM {PROCEDURES} WHERE node % 4 = 1 AND (graph, node + 3) IN (SELECT graph, node FROM {PROCEDURES}))"


@query("control_dependence", ops="D7", sql=f"WITH RECURSIVE n AS (SELECT * FROM {PROCEDURES}), e AS (SELECT * FROM {FLOW}), r(graph, without, node) AS (SELECT e.graph, n.node, e.src FROM e JOIN n ON n.graph = e.graph AND n.node <> e.src WHERE e.dst IS NULL UNION SELECT r.graph, r.without, e.src FROM r JOIN e ON e.graph = r.graph AND e.dst = r.node AND e.src <> r.without) SELECT DISTINCT e.graph, e.src AS branch, n.node FROM e JOIN n ON n.graph = e.graph WHERE e.dst IS NOT NULL AND (e.graph, n.node, e.dst) NOT IN (SELECT graph, without, node FROM r) AND (n.node = e.src OR (e.graph, n.node, e.src) IN (SELECT graph, without, node FROM r))")
def control_dependence(spark, t):
    n = procedures(t)
    there = n.select("graph", F.col("node").alias("dst"))
    on = n.select("graph", F.col("node").alias("src"), (F.col("node") + 1).alias("dst")).join(there.withColumn("known", F.lit(True)), ["graph", "dst"], "left")
    on = on.select("graph", "src", F.when(F.col("known"), F.col("dst")).alias("dst"))
    back = n.where("node % 5 = 0 AND node > 4").select("graph", F.col("node").alias("src"), F.floor(F.col("node") / 4).alias("dst"))
    skip = n.where("node % 4 = 1").select("graph", F.col("node").alias("src"), (F.col("node") + 3).alias("dst")).join(there, ["graph", "dst"], "left_semi")
    return graph.control_dependence(on.unionByName(back).unionByName(skip))


GEN = "(SELECT p_partkey AS node, p_size AS fact FROM part WHERE p_type IN ('ECONOMY', 'LARGE') AND p_size < 8)"
KILL = "(SELECT p_partkey AS node, f.p_size AS fact FROM part JOIN (SELECT DISTINCT p_size FROM part WHERE p_size < 8) f ON part.p_size % 4 = f.p_size % 4)"
THROWS = f"(SELECT src, dst FROM {DAG} WHERE src IN (SELECT p_partkey FROM part WHERE p_type = 'PROMO'))"


@query("exceptional_flow", ops="D2", sql=f"WITH RECURSIVE e AS (SELECT * FROM {DAG}), x AS (SELECT * FROM {THROWS}), k AS (SELECT * FROM {KILL}), r(node, fact, place) AS (SELECT node, fact, 'out' FROM {GEN} UNION (SELECT dst, r.fact, 'in' FROM r JOIN (SELECT src, dst, 'out' AS place FROM e UNION ALL SELECT src, dst, 'in' FROM x) w ON w.src = r.node AND w.place = r.place UNION ALL SELECT r.node, r.fact, 'out' FROM r WHERE r.place = 'in' AND NOT EXISTS (SELECT 1 FROM k WHERE k.node = r.node AND k.fact = r.fact))) SELECT node, fact, place FROM r")
def exceptional_flow(spark, t):
    p = t("part").select(F.col("p_partkey").alias("node"), "p_size", "p_type")
    gen = p.where("p_type IN ('ECONOMY', 'LARGE') AND p_size < 8").select("node", F.col("p_size").alias("fact"))
    facts = p.where("p_size < 8").select(F.col("p_size").alias("fact")).distinct()
    kill = p.join(facts, p["p_size"] % 4 == facts["fact"] % 4).select("node", "fact")
    e = dag(t)
    return dataflow.may_facts_throwing(e, e.join(p.where("p_type = 'PROMO'").select(F.col("node").alias("src")), "src", "left_semi"), gen, kill)


BOUND = "(SELECT conv_id AS scope, role AS variable, coalesce(length(text), 0) AS path, turn AS since, least(lead(turn) OVER (PARTITION BY conv_id, role ORDER BY turn, length(text)), max(turn) OVER (PARTITION BY conv_id)) AS until FROM conversations)"


def _bindings(t):
    """A role is bound to its text's length from its turn on; a conversation's scope ends at its last turn."""
    c = t("conversations").select(F.col("conv_id").alias("scope"), F.col("role").alias("variable"), F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("path"), F.col("turn").alias("since"))
    return c, dataflow.binding_intervals(c, c.groupBy("scope").agg(F.max("since").alias("ends")))


@query("binding_intervals", ops="D14", sql=f"SELECT scope, variable, path, since, until FROM {BOUND} WHERE since < until")
def binding_intervals(spark, t):
    return _bindings(t)[1]


@query("bound_paths", ops="D14", sql=f"SELECT c.conv_id AS scope, 'user' AS variable, c.turn AS place, b.path FROM conversations c LEFT JOIN {BOUND} b ON b.scope = c.conv_id AND b.variable = 'user' AND c.turn >= b.since AND b.since < b.until AND c.turn < b.until")
def bound_paths(spark, t):
    c, intervals = _bindings(t)
    return dataflow.bound_paths(c.select("scope", F.lit("user").alias("variable"), F.col("since").alias("place")), intervals)


COUNT = "(SELECT count(*) FROM {} WHERE {})"


@query("cost_summary", ops="A10", sql=" UNION ALL ".join(f"SELECT '{kind}' AS kind, {COUNT.format(LATE, test)} AS current, {COUNT.format(EARLY, test)} AS previous" for kind, test in (("top", "degree IS NULL"), ("zero", "degree = 0"), ("unreachable", "degree < 0"))))
def cost_summary(spark, t):
    return diff.cost_summary(*_costs(t))


@query("cost_order", ops="O2", sql="SELECT o_orderkey, row_number() OVER (ORDER BY o_orderpriority, o_custkey, CAST(floor(o_totalprice / 100000) AS BIGINT), o_orderkey, o_orderstatus = 'F') - 1 AS place FROM orders")
def cost_order(spark, t):
    o = t("orders").select(F.col("o_orderpriority").alias("file"), F.col("o_custkey").alias("procedure"), F.floor(F.col("o_totalprice") / 100000).alias("polynomial"), "o_orderkey", (F.col("o_orderstatus") == "F").alias("on_ui"))
    return windows.dense_index(o, ["file", "procedure", "polynomial", "o_orderkey", "on_ui"], "place").select("o_orderkey", "place")


@query("linter_scope", ops="X6", sql=f"SELECT hash, line, file, CASE WHEN bug_type = 'error' THEN 'ERROR' ELSE 'WARNING' END AS severity FROM {CURRENT} WHERE regexp_matches(file, 'f[1-4]\\d*\\.java$') AND NOT regexp_matches(file, '/f1') AND bug_type <> 'view'")
def linter_scope(spark, t):
    issues = reports(t)[0].where(diff.in_scope(F.col("file"), [r"f[1-4]\d*\.java$"], ["/f1"]))
    rules = spark.createDataFrame([("view", "WARNING", "OFF"), ("error", "ERROR", "ON")], "bug_type string, severity string, mode string")
    ruled = issues.join(F.broadcast(rules), "bug_type", "left").where("coalesce(mode, 'ON') = 'ON'")
    return ruled.select("hash", "line", "file", F.coalesce("severity", F.lit("WARNING")).alias("severity"))


@query("multimap_add", ops="N9", sql=f"SELECT dst AS key, src AS value FROM {CALLS} UNION ALL SELECT dst, src FROM {DAG}")
def multimap_add(spark, t):
    side = lambda e: e.select(F.col("dst").alias("key"), F.col("src").alias("value"))
    return tables.multimap_add(side(calls(t)), side(dag(t)))


@query("cost_change_on_ui", ops="Q4", sql=f"SELECT c.procedure, p.degree AS before, c.degree AS now, CASE WHEN c.degree IS NULL THEN 'INFINITE_EXECUTION_TIME' WHEN c.degree < 0 THEN 'UNREACHABLE' WHEN c.procedure IN (SELECT o_custkey FROM orders WHERE o_orderpriority LIKE '1%') THEN 'COMPLEXITY_INCREASE_UI_THREAD' ELSE 'COMPLEXITY_INCREASE' END AS kind FROM {LATE} c JOIN {EARLY} p ON c.procedure = p.procedure WHERE (c.degree IS NULL AND p.degree IS NOT NULL) OR (c.degree < 0 AND p.degree >= 0) OR c.degree > p.degree")
def cost_change_on_ui(spark, t):
    now, before = _costs(t)
    ui = t("orders").where("o_orderpriority LIKE '1%'").select(F.col("o_custkey").alias("procedure")).distinct().withColumn("on_ui", F.lit(True))
    return diff.cost_change(now.join(ui, "procedure", "left"), before, on_ui="on_ui")


@query("visit_priorities", ops="W11", sql=f"SELECT node, priority, row_number() OVER (ORDER BY priority, node) AS place FROM (SELECT dst AS node, count(*) - count(s_suppkey) AS priority FROM {CALLS} LEFT JOIN (SELECT s_suppkey FROM supplier WHERE s_acctbal < 5000) ON s_suppkey = src GROUP BY dst HAVING count(s_suppkey) > 0)")
def visit_priorities(spark, t):
    found = dataflow.visit_priorities(calls(t), t("supplier").where("s_acctbal < 5000").select(F.col("s_suppkey").alias("node")))
    return windows.dense_index(found, ["priority", "node"], "place").select("node", "priority", (F.col("place") + 1).cast("long").alias("place"))


ACCESSES = "(SELECT p_partkey, base, CASE WHEN p_size % 2 = 0 THEN [word, field, p_brand] ELSE [word, field] END AS path, CAST(p_size % 3 AS VARCHAR) AS trace FROM (SELECT *, p_type AS base, split_part(p_name, ' ', 1) AS word, CAST(CASE WHEN p_name LIKE 'cold%' OR p_name LIKE 'small%' THEN p_size ELSE p_size % 5 END AS VARCHAR) AS field FROM part))"
TREES = f"a AS (SELECT DISTINCT base, path[:2] AS path, len(path) > 2 AS star, trace FROM {ACCESSES}), s AS (SELECT DISTINCT base, path, star, k, path[:k] AS node FROM (SELECT base, path, star, unnest(range(0, len(path) + 1)) AS k FROM a)), m AS (SELECT base, node FROM s GROUP BY ALL HAVING count(DISTINCT CASE WHEN k < len(path) THEN path[k + 1] END) > 8 OR bool_or(star AND k = len(path))), f AS (SELECT base, path, min(k) AS k FROM s JOIN m USING (base, node) GROUP BY base, path), e AS (SELECT DISTINCT base, CASE WHEN k IS NULL THEN path ELSE path[:k] END AS path, k IS NOT NULL AS star, trace FROM a LEFT JOIN f USING (base, path)), x AS (SELECT *, unnest(range(0, len(path) + 1)) AS k FROM e), tree AS (SELECT base, path[:k] AS path, bool_or(star AND k = len(path)) AS star, coalesce(list_sort(list(DISTINCT trace) FILTER (k = len(path))), []) AS traces FROM x GROUP BY base, path[:k])"


def _accesses(t):
    """A part's type is the base; some words have a field for each size, the others one for each fifth."""
    field = F.when(F.col("p_name").rlike("^(cold|small)"), F.col("p_size")).otherwise(F.col("p_size") % 5).cast("string")
    path = F.array(F.split_part("p_name", F.lit(" "), F.lit(1)), field)
    return t("part").select("p_partkey", F.col("p_type").alias("base"), F.when(F.col("p_size") % 2 == 0, F.concat(path, F.array("p_brand"))).otherwise(path).alias("path"), (F.col("p_size") % 3).cast("string").alias("trace"))


@query("access_tree", ops="D12", sql=f"WITH {TREES} SELECT base, array_to_string(path, '.') AS path, star, array_to_string(traces, ',') AS traces FROM tree")
def access_tree(spark, t):
    return dataflow.access_tree(_accesses(t), 2, 8).select("base", F.array_join("path", ".").alias("path"), "star", F.array_join("traces", ",").alias("traces"))


@query("tree_traces", ops="D12", sql=f"WITH {TREES} SELECT p_partkey, array_to_string(t.traces, ',') AS traces FROM (SELECT p_partkey, 'LARGE' AS base, path FROM {ACCESSES}) q LEFT JOIN tree t ON t.base = q.base AND (t.path = q.path OR (t.star AND t.path = q.path[:len(t.path)]))")
def tree_traces(spark, t):
    asked = _accesses(t).select("p_partkey", F.lit("LARGE").alias("base"), "path")
    return dataflow.tree_traces(dataflow.access_tree(_accesses(t), 2, 8), asked).select("p_partkey", F.array_join("traces", ",").alias("traces"))
