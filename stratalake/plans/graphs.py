"""Graphs, dataflow, taint, beliefs and temporal properties over the stand-in views."""

from __future__ import annotations

from pyspark.sql import functions as F

from stratalake.operators import automata, bayes, dataflow, graph, taint
from stratalake.plans.views import CALLS, DAG, FOREST, PROCEDURES, SPARSE, TREE, calls, dag, forest, procedures, sparse, tree
from stratalake.registry import query


def _reach(edges: str, sources: str) -> str:
    return f"WITH RECURSIVE e AS (SELECT * FROM {edges}), r(node) AS (SELECT node FROM ({sources}) UNION SELECT e.dst FROM r JOIN e ON e.src = r.node)"


@query("call_graph", ops="G1 G2 G14 U1 S2", sql=f"SELECT src, dst FROM {CALLS}")
def call_graph(spark, t):
    return calls(t)


@query("reverse_graph", ops="G3", sql=f"SELECT dst AS src, src AS dst FROM {SPARSE}")
def reverse_graph(spark, t):
    return graph.reversed_edges(sparse(t))


@query("reachable_from", ops="G4 G20 J19", sql=_reach(SPARSE, "SELECT p_partkey AS node FROM part WHERE p_partkey IN (1, 50)") + " SELECT node FROM r")
def reachable_from(spark, t):
    return graph.reachable(sparse(t), t("part").where("p_partkey IN (1, 50)").select(F.col("p_partkey").alias("node"))).select("node")


@query("invalidated", ops="G5", sql=_reach(f"(SELECT dst AS src, src AS dst FROM {SPARSE})", "SELECT doc_id AS node FROM labels WHERE quality = 0") + " SELECT node FROM r")
def invalidated(spark, t):
    changed = t("labels").where("quality = 0").select(F.col("doc_id").alias("node"))
    return graph.reachable(graph.reversed_edges(sparse(t)), changed).select("node")


@query("leaf_levels", ops="G6 G7", sql=f"WITH RECURSIVE e AS (SELECT DISTINCT * FROM {DAG}), r(node, level) AS (SELECT DISTINCT dst, 0 FROM e WHERE dst NOT IN (SELECT src FROM e) UNION SELECT e.src, r.level + 1 FROM r JOIN e ON e.dst = r.node) SELECT node, CAST(max(level) AS INTEGER) AS level FROM r GROUP BY node")
def leaf_levels(spark, t):
    return graph.levels(dag(t))


@query("components", ops="G10 G17 A20 G13", sql=f"WITH RECURSIVE e AS (SELECT src, dst FROM {SPARSE} UNION SELECT dst, src FROM {SPARSE}), r(node, component) AS (SELECT src, src FROM e WHERE src < 400 OR src >= 400 UNION SELECT e.dst, r.component FROM r JOIN e ON e.src = r.node WHERE r.component <= e.dst) SELECT node, min(component) AS component FROM r GROUP BY node")
def components(spark, t):
    return graph.components(sparse(t))


@query("small_components", ops="G13", sql=f"WITH RECURSIVE e AS (SELECT src, dst FROM {FOREST} UNION SELECT dst, src FROM {FOREST}), r(node, component) AS (SELECT src, src FROM e UNION SELECT e.dst, r.component FROM r JOIN e ON e.src = r.node WHERE r.component <= e.dst), c AS (SELECT node, min(component) AS component FROM r GROUP BY node) SELECT component, count(*) AS n FROM c GROUP BY component HAVING count(*) <= 4")
def small_components(spark, t):
    return graph.small_components(forest(t), 4)


@query("acyclic_edges", ops="G12", sql=f"SELECT src, dst FROM {SPARSE} WHERE src < dst AND dst IN (SELECT p_partkey FROM part)")
def acyclic_edges(spark, t):
    order = t("part").select(F.col("p_partkey").alias("node"), F.col("p_partkey").alias("rank"))
    return graph.acyclic(sparse(t), order)


@query(
    "simple_paths",
    ops="G15 G16 W6",
    sql=f"WITH RECURSIVE e AS (SELECT src, dst, '--call-->' AS step FROM {DAG} UNION SELECT dst, src, '<--call--' FROM {DAG}), r(here, path, txt) AS (SELECT CAST(9 AS BIGINT), [CAST(9 AS BIGINT)], '9' UNION ALL SELECT e.dst, list_append(path, e.dst), concat(txt, step, e.dst) FROM r JOIN e ON e.src = r.here WHERE NOT list_contains(path, e.dst) AND len(path) <= 4) SELECT txt FROM r WHERE here = 2 AND len(path) > 1",
)
def simple_paths(spark, t):
    one = lambda k: spark.range(k, k + 1).select(F.col("id").alias("node"))
    found = graph.simple_paths(dag(t).withColumn("kind", F.lit("call")), one(9), one(2), 4)
    return found.select(graph.rendered(F.col("path"), F.col("kinds")).alias("txt"))


@query("hierarchy_closure", ops="G19", sql=f"WITH RECURSIVE r(node, ancestor) AS (SELECT child, parent FROM {TREE} UNION SELECT r.node, t.parent FROM r JOIN {TREE} t ON t.child = r.ancestor) SELECT node, ancestor FROM r")
def hierarchy_closure(spark, t):
    up = tree(t).select(F.col("child").alias("src"), F.col("parent").alias("dst"))
    walked = graph.reachable(up, up.select(F.col("src").alias("start"), F.col("src").alias("node")).distinct(), carry=("start",))
    return walked.where("depth > 0").select(F.col("start").alias("node"), F.col("node").alias("ancestor"))


@query("nodes_in_block", ops="G21", sql=f"WITH RECURSIVE e AS (SELECT * FROM {DAG}), r(node) AS (SELECT CAST(190 AS BIGINT) UNION SELECT e.dst FROM r JOIN e ON e.src = r.node WHERE r.node NOT IN (47, 95, 12)) SELECT node FROM r")
def nodes_in_block(spark, t):
    stop = spark.range(0, 100).where("id IN (47, 95, 12)").select(F.col("id").alias("node"))
    return graph.reachable(dag(t), spark.range(190, 191).select(F.col("id").alias("node")), stop=stop).select("node")


@query("annotation_reach", ops="G20", sql=f"WITH RECURSIVE e AS (SELECT * FROM {DAG}), r(s, w, node, d) AS (SELECT src, dst, dst, 1 FROM e WHERE src IN (SELECT p_partkey FROM part WHERE p_type = 'PROMO') UNION SELECT s, w, e.dst, d + 1 FROM r JOIN e ON e.src = r.node), m AS (SELECT s, node, min(d) AS d FROM r WHERE node IN (SELECT p_partkey FROM part WHERE p_type = 'SMALL') GROUP BY ALL) SELECT r.s AS source, r.node AS sink, CAST(r.d AS INTEGER) AS depth, min(r.w) AS witness FROM r JOIN m ON r.s = m.s AND r.node = m.node AND r.d = m.d GROUP BY ALL")
def annotation_reach(spark, t):
    marked = lambda kind: t("part").where(F.col("p_type") == kind).select(F.col("p_partkey").alias("node"))
    return taint.annotation_reach(dag(t), marked("PROMO"), marked("SMALL"))


@query("weak_topological_order", ops="G8")
def weak_topological_order(spark, t):
    p = procedures(t).where("node > 1")
    n = F.col("node")
    edges = p.select("graph", F.floor(n / 2).alias("src"), n.alias("dst"), n.alias("seq")).unionByName(p.where("node % 5 = 0").select("graph", n.alias("src"), F.floor(n / 4).alias("dst"), (n * 2 + 2).alias("seq")))
    return graph.weak_topological_orders(edges, 1)


@query("dominators", ops="G9", sql=f"WITH n AS (SELECT * FROM {PROCEDURES}), a AS (SELECT graph, node, d FROM n, (SELECT unnest(range(0, 8)) AS d) WHERE node >> CAST(d AS BIGINT) > 0 AND graph IN (SELECT graph FROM n WHERE node = 2)) SELECT graph, node, CAST(node >> CAST(d AS BIGINT) AS BIGINT) AS dominator, d = 1 AS immediate FROM a")
def dominators(spark, t):
    e = procedures(t).where("node > 1").select("graph", F.floor(F.col("node") / 2).alias("src"), F.col("node").alias("dst"))
    return graph.dominators(e, 1)


@query(
    "rich_nodes",
    ops="G11",
    sql="WITH e AS (SELECT DISTINCT l_partkey AS src, l_suppkey + 1000000 AS dst FROM lineitem), d AS (SELECT dst AS node, count(*) AS degree FROM e GROUP BY dst), s AS (SELECT s_suppkey + 1000000 AS node, s_nationkey FROM supplier), m AS (SELECT a.node, b.node AS other FROM s a JOIN s b ON a.s_nationkey = b.s_nationkey AND a.node <> b.node), ranked AS (SELECT src, dst, row_number() OVER (PARTITION BY dst ORDER BY src) AS r FROM e), surplus AS (SELECT src, dst, r - 5 AS r FROM ranked JOIN d ON d.node = dst WHERE degree >= 6 AND r >= 6), room AS (SELECT m.node AS dst, other, row_number() OVER (PARTITION BY m.node ORDER BY coalesce(degree, 0), other) AS r FROM m LEFT JOIN d ON d.node = other WHERE coalesce(degree, 0) < 5) SELECT src, dst FROM ranked WHERE (src, dst) NOT IN (SELECT src, dst FROM surplus) UNION ALL SELECT s.src, coalesce(nullif(room.other, s.src), s.dst) FROM surplus s LEFT JOIN room ON room.dst = s.dst AND room.r = s.r",
)
def rich_nodes(spark, t):
    edges = t("lineitem").select(F.col("l_partkey").alias("src"), (F.col("l_suppkey") + 1_000_000).alias("dst")).distinct()
    s = t("supplier").select((F.col("s_suppkey") + 1_000_000).alias("node"), "s_nationkey")
    similar = s.join(s.select(F.col("node").alias("other"), "s_nationkey"), "s_nationkey").where("node <> other").select("node", "other")
    return graph.relieve_rich_nodes(edges, similar)


# ---- dataflow: a control-flow graph on part keys, one node each; variables by key

DEFS = "(SELECT p_partkey AS node, p_partkey % 7 AS variable FROM part WHERE p_type IN ('ECONOMY', 'LARGE', 'PROMO'))"
USES = "(SELECT p_partkey AS node, p_partkey % 5 AS variable FROM part WHERE p_type IN ('LARGE', 'MEDIUM'))"


def _defs(t):
    return t("part").where("p_type IN ('ECONOMY', 'LARGE', 'PROMO')").select(F.col("p_partkey").alias("node"), (F.col("p_partkey") % 7).alias("variable"))


def _uses(t):
    return t("part").where("p_type IN ('LARGE', 'MEDIUM')").select(F.col("p_partkey").alias("node"), (F.col("p_partkey") % 5).alias("variable"))


TAKEN = "(SELECT p_partkey AS node, p_partkey % 7 AS variable FROM part WHERE p_size = 8)"


@query("reaching_definitions", ops="D1 D3 E3", sql=f"WITH RECURSIVE e AS (SELECT * FROM {DAG}), d AS (SELECT * FROM {DEFS}), r(node, variable, definition) AS (SELECT node, variable, node FROM d UNION SELECT e.dst, r.variable, r.definition FROM r JOIN e ON e.src = r.node WHERE NOT EXISTS (SELECT 1 FROM d WHERE d.node = e.dst AND d.variable = r.variable)) SELECT node, variable, definition FROM r")
def reaching_definitions(spark, t):
    return dataflow.reaching_definitions(dag(t), _defs(t))


@query("liveness", ops="D4 D1", sql=f"WITH RECURSIVE e AS (SELECT * FROM {DAG}), r(node, variable) AS (SELECT node, variable FROM {USES} UNION SELECT e.src, r.variable FROM r JOIN e ON e.dst = r.node WHERE NOT EXISTS (SELECT 1 FROM {DEFS} d WHERE d.node = e.src AND d.variable = r.variable)) SELECT node, variable FROM r")
def liveness(spark, t):
    return dataflow.live_variables(dag(t), _uses(t), _defs(t))


@query("address_taken", ops="D5", sql=f"WITH RECURSIVE e AS (SELECT * FROM {DAG}), r(node, variable) AS (SELECT node, variable FROM {TAKEN} UNION SELECT e.dst, r.variable FROM r JOIN e ON e.src = r.node) SELECT node, variable FROM r")
def address_taken(spark, t):
    return dataflow.address_taken(dag(t), t("part").where("p_size = 8").select(F.col("p_partkey").alias("node"), (F.col("p_partkey") % 7).alias("variable")))


@query("pointer_resolution", ops="D6", sql="SELECT s_suppkey AS site, coalesce(m, s_nationkey) AS callee FROM supplier LEFT JOIN (SELECT c_nationkey, min(c_custkey) AS m FROM customer WHERE c_nationkey < 12 GROUP BY 1) ON c_nationkey = s_nationkey")
def pointer_resolution(spark, t):
    held = t("customer").where("c_nationkey < 12").select(F.col("c_nationkey").cast("long").alias("pointer"), F.col("c_custkey").alias("proc"))
    return dataflow.resolved_pointers(t("supplier").select(F.col("s_suppkey").alias("site"), F.col("s_nationkey").cast("long").alias("pointer")), held)


@query("loop_invariants", ops="D8", sql=f"WITH l AS (SELECT p_partkey // 8 AS loop, p_partkey AS node FROM part) SELECT DISTINCT l.loop, u.variable FROM l JOIN {USES} u ON u.node = l.node WHERE NOT EXISTS (SELECT 1 FROM l m JOIN {DEFS} d ON d.node = m.node WHERE m.loop = l.loop AND d.variable = u.variable)")
def loop_invariants(spark, t):
    loops = t("part").select(F.floor(F.col("p_partkey") / 8).alias("loop"), F.col("p_partkey").alias("node"))
    return dataflow.loop_invariants(loops, _uses(t), _defs(t))


@query("impure_procedures", ops="D9 D10", sql=_reach(f"(SELECT dst AS src, src AS dst FROM {DAG})", "SELECT p_partkey AS node FROM part WHERE p_type = 'PROMO' AND p_size > 45") + " SELECT node AS proc FROM r")
def impure_procedures(spark, t):
    c = dag(t).select(F.col("src").alias("caller"), F.col("dst").alias("callee"))
    return dataflow.impure(c, t("part").where("p_type = 'PROMO' AND p_size > 45").select(F.col("p_partkey").alias("proc")))


@query("definition_chains", ops="D11", sql=f"WITH RECURSIVE e AS (SELECT * FROM {DAG}), r(origin, definition, depth) AS (SELECT p_partkey, p_partkey, 0 FROM part WHERE p_partkey IN (150, 181) UNION SELECT origin, e.dst, depth + 1 FROM r JOIN e ON e.src = r.definition) SELECT origin, definition, CAST(min(depth) AS INTEGER) AS depth FROM r GROUP BY ALL")
def definition_chains(spark, t):
    start = t("part").where("p_partkey IN (150, 181)").select(F.col("p_partkey").alias("node"))
    return dataflow.definition_chains(dag(t), start).select("origin", "definition", "depth")


SOURCES = "(SELECT p_partkey AS node, CASE WHEN p_partkey % 2 = 0 THEN 'A' ELSE 'B' END AS kind FROM part WHERE p_type = 'PROMO')"
SINKS = "(SELECT p_partkey AS node, CASE WHEN p_partkey % 3 = 0 THEN 'A' ELSE 'B' END AS kind FROM part WHERE p_type = 'SMALL')"


def _ends(t):
    p = F.col("p_partkey")
    return t("part").where("p_type = 'PROMO'").select(p.alias("node"), F.when(p % 2 == 0, "A").otherwise("B").alias("kind")), t("part").where("p_type = 'SMALL'").select(p.alias("node"), F.when(p % 3 == 0, "A").otherwise("B").alias("kind"))


@query("taint_flows", ops="T1 T2 T6 T8 J18 E4", sql=f"WITH RECURSIVE e AS (SELECT * FROM {DAG}), r(source, kind, node) AS (SELECT node, kind, node FROM {SOURCES} UNION SELECT r.source, r.kind, e.dst FROM r JOIN e ON e.src = r.node) SELECT r.source, r.node AS sink, r.kind FROM r JOIN {SINKS} k ON k.node = r.node AND k.kind = r.kind")
def taint_flows(spark, t):
    return taint.flows(dag(t), *_ends(t)).select("source", "sink", "kind")


SANITIZERS = "(SELECT p_partkey AS node, CASE WHEN p_partkey % 4 = 0 THEN 'All' ELSE 'A' END AS kind FROM part WHERE p_type = 'STANDARD')"


@query("taint_sanitized", ops="T3 T7", sql=f"WITH RECURSIVE e AS (SELECT * FROM {DAG}), z AS (SELECT * FROM {SANITIZERS}), r(source, kind, node) AS (SELECT node, kind, node FROM {SOURCES} UNION SELECT r.source, r.kind, e.dst FROM r JOIN e ON e.src = r.node WHERE NOT EXISTS (SELECT 1 FROM z WHERE z.node = e.dst AND (z.kind = r.kind OR z.kind = 'All'))) SELECT r.source, r.node AS sink, r.kind FROM r JOIN {SINKS} k ON k.node = r.node AND k.kind = r.kind")
def taint_sanitized(spark, t):
    p = F.col("p_partkey")
    z = t("part").where("p_type = 'STANDARD'").select(p.alias("node"), F.when(p % 4 == 0, "All").otherwise("A").alias("kind"))
    return taint.flows(dag(t), *_ends(t), z).select("source", "sink", "kind")


@query("unknown_call_rules", ops="T4 T5", sql="SELECT p_partkey, CASE WHEN p_size % 7 = 0 THEN 'receiver' WHEN p_type IN ('PROMO', 'ECONOMY') THEN CASE WHEN p_size % 2 = 0 THEN 'none' ELSE 'receiver' END WHEN p_size % 2 = 0 THEN 'return' ELSE 'both' END AS rule FROM part")
def unknown_call_rules(spark, t):
    kind = F.when(F.col("p_type").isin("PROMO", "ECONOMY"), "int").otherwise("java.lang.String")
    return t("part").select("p_partkey", taint.unknown_call(kind, F.col("p_size") % 2 == 0, F.col("p_size") % 7 == 0).alias("rule"))


@query("network_posterior", ops="G18", sql="WITH a AS (SELECT * FROM (VALUES (0, 0.6), (1, 0.4)) x(a, p)), b AS (SELECT * FROM (VALUES (0, 0, 0.9), (0, 1, 0.1), (1, 0, 0.3), (1, 1, 0.7)) x(a, b, p)), j AS (SELECT a.a, a.p * b.p AS p FROM a JOIN b ON a.a = b.a WHERE b.b = 1) SELECT a, round(CAST(p / (SELECT sum(p) FROM j) AS DOUBLE), 9) AS p FROM j")
def network_posterior(spark, t):
    a = spark.createDataFrame([(0, 0.6), (1, 0.4)], "a int, p double")
    b = spark.createDataFrame([(0, 0, 0.9), (0, 1, 0.1), (1, 0, 0.3), (1, 1, 0.7)], "a int, b int, p double")
    return bayes.posterior([a, b], "a", {"b": 1}).select("a", F.round("p", 9).alias("p"))


@query("automaton_window", ops="X1 X7", sql="SELECT event_id FROM (SELECT event_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b FROM events WHERE event_type IN ('view', 'purchase', 'click')) WHERE event_type = 'purchase' AND b = 'view'")
def automaton_window(spark, t):
    return automata.followed_without(t("events"), "view", "purchase", "click", "user_id", ("ts", "event_id"), "event_type").select("event_id")


@query(
    "automaton_registers",
    ops="X1 X2 X3 E5",
    sql="WITH e AS (SELECT user_id, event_id, event_type, CAST(floor(value) AS BIGINT) AS v FROM events) SELECT b.user_id, min(b.event_id) AS event_id, 'echo' AS property FROM e a JOIN e b ON a.user_id = b.user_id AND a.event_id < b.event_id AND a.event_type = 'view' AND b.event_type = 'click' AND a.v = b.v GROUP BY b.user_id",
)
def automaton_registers(spark, t):
    keep = automata.Transition("start", "start")
    seen = automata.Transition("start", "seen", "view", action=lambda e, r: {"v": e["v"]})
    hold = automata.Transition("seen", "seen")
    bad = automata.Transition("seen", "error", "click", guard=lambda e, r: e["v"] == r["v"])
    e = t("events").select("user_id", "event_id", "event_type", F.floor("value").alias("v"))
    return automata.run_property(e, automata.Property("echo", (keep, seen, hold, bad)), "user_id", "event_id", "event_type")


def _ctl(t):
    p = F.col("p_partkey")
    nodes = t("part").select(p.alias("node"), F.col("p_type").alias("label"), (F.col("p_size") > 40).alias("big"))
    return automata.Tree(nodes, tree(t).where("child >= 0")), nodes


LABELS = "(SELECT p_partkey AS node, p_size > 40 AS big, p_size > 8 AS some FROM part)"


@query("ctl_ex_ax", ops="X4", sql=f"WITH n AS (SELECT * FROM {LABELS}), t AS (SELECT * FROM {TREE}) SELECT node, EXISTS (SELECT 1 FROM t JOIN n c ON c.node = t.child WHERE t.parent = n.node AND c.big) AS ex, NOT EXISTS (SELECT 1 FROM t JOIN n c ON c.node = t.child WHERE t.parent = n.node AND NOT c.big) AS ax FROM n")
def ctl_ex_ax(spark, t):
    m, n = _ctl(t)
    big = n.where("big").select("node")
    ex, ax = m.ex(big).withColumn("ex", F.lit(True)), m.ax(big).withColumn("ax", F.lit(True))
    return n.select("node").join(ex, "node", "left").join(ax, "node", "left").select("node", F.coalesce("ex", F.lit(False)).alias("ex"), F.coalesce("ax", F.lit(False)).alias("ax"))


@query("ctl_ef_eg", ops="X4", sql=f"WITH RECURSIVE n AS (SELECT * FROM {LABELS}), t AS (SELECT * FROM {TREE}), ef(node) AS (SELECT node FROM n WHERE big UNION SELECT t.parent FROM ef JOIN t ON t.child = ef.node) SELECT node FROM ef")
def ctl_ef_eg(spark, t):
    m, n = _ctl(t)
    return m.ef(n.where("big").select("node"))


@query("ctl_eu", ops="X4", sql=f"WITH RECURSIVE n AS (SELECT * FROM {LABELS}), t AS (SELECT * FROM {TREE}), eu(node) AS (SELECT node FROM n WHERE big UNION SELECT t.parent FROM eu JOIN t ON t.child = eu.node JOIN n p ON p.node = t.parent AND p.some) SELECT node FROM eu")
def ctl_eu(spark, t):
    m, n = _ctl(t)
    return m.eu(t("part").where("p_size > 8").select(F.col("p_partkey").alias("node")), n.where("big").select("node"))


@query("ctl_ag", ops="X4", sql=f"WITH RECURSIVE n AS (SELECT * FROM {LABELS}), t AS (SELECT * FROM {TREE}), bad(node) AS (SELECT node FROM n WHERE big UNION SELECT t.parent FROM bad JOIN t ON t.child = bad.node) SELECT node FROM n WHERE node NOT IN (SELECT node FROM bad)")
def ctl_ag(spark, t):
    m, n = _ctl(t)
    return m.ag(n.where("NOT big").select("node"))


@query("ctl_eh", ops="X4", sql=f"WITH RECURSIVE n AS (SELECT * FROM {LABELS}), t AS (SELECT * FROM {TREE}), eh(node) AS (SELECT t.child FROM t JOIN n ON n.node = t.parent AND n.big UNION SELECT t.child FROM eh JOIN t ON t.parent = eh.node) SELECT node FROM eh")
def ctl_eh(spark, t):
    m, n = _ctl(t)
    return m.eh(n.where("big").select("node"))
