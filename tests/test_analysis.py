"""Costs, control dependence, exceptional flow and bindings on fixtures small enough to follow by hand: nulls, ties, empty tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from stratalake.operators import costs, dataflow, diff, graph

COST = "key long, monomial array<string>, coefficient long"


def terms(df):
    return sorted((r.key, tuple(r.monomial), r.coefficient) for r in df.collect())


def test_cost_algebra(spark):
    a = spark.createDataFrame([(1, ["n"], 2), (1, [], 3), (2, ["n"], 5), (3, ["n"], 1)], COST)
    b = spark.createDataFrame([(1, ["n"], -2), (1, ["m"], 4), (2, ["n", "n"], 1), (3, ["n"], 1)], COST)
    assert terms(costs.plus(a, b)) == [(1, (), 3), (1, ("m",), 4), (2, ("n",), 5), (2, ("n", "n"), 1), (3, ("n",), 2)]
    assert terms(costs.times(a, b)) == [(1, ("m",), 12), (1, ("m", "n"), 8), (1, ("n",), -6), (1, ("n", "n"), -4), (2, ("n", "n", "n"), 5), (3, ("n", "n"), 1)]
    # the same degree and the same leading coefficients: the first
    assert terms(costs.lesser(a, b)) == [(1, (), 3), (1, ("n",), 2), (2, ("n",), 5), (3, ("n",), 1)]
    none = a.limit(0)
    assert terms(costs.plus(a, none)) == terms(a)
    assert terms(costs.times(a, none)) == terms(costs.lesser(none, b)) == []


def test_node_bounds(spark):
    # 1 -> 2 -> 3 run equally often; 3 branches to 4 and 5, which both lead to 6
    edges = spark.createDataFrame([(1, 2), (2, 3), (2, 3), (3, 4), (3, 5), (4, 6), (5, 6)], "src long, dst long")
    local = spark.createDataFrame([(1, 9), (2, None), (3, 7), (4, 2), (5, None), (6, 8)], "node long, bound long")
    assert sorted(map(tuple, costs.node_bounds(edges, local).collect())) == [(1, 7), (2, 7), (3, 7), (4, 2), (5, None), (6, 8)]
    assert sorted(map(tuple, costs.node_bounds(edges.limit(0), local.where("node = 1")).collect())) == [(1, 9)]


def test_control_dependence(spark):
    # 1 branches to 2 and 3, both lead to 4, a loop head with body 5; 4 leaves; 9 never does
    edges = [("f", 1, 2), ("f", 1, 3), ("f", 2, 4), ("f", 3, 4), ("f", 4, 5), ("f", 5, 4), ("f", 4, None), ("f", 9, 9), ("g", 1, None)]
    got = graph.control_dependence(spark.createDataFrame(edges, "graph string, src long, dst long"))
    assert sorted(map(tuple, got.collect())) == [("f", 1, 2), ("f", 1, 3), ("f", 4, 4), ("f", 4, 5)]


def test_exceptional_flow(spark):
    edges, throws = (spark.createDataFrame(e, "src long, dst long") for e in ([(1, 2), (2, 3)], [(2, 4), (1, 4)]))
    gen, kill = (spark.createDataFrame(f, "node long, fact string") for f in ([(1, "a"), (2, "b")], [(2, "a")]))
    got = sorted(map(tuple, dataflow.may_facts_throwing(edges, throws, gen, kill).collect()))
    # a is killed in 2 but reaches 4 by the exception; b, made in 2, does not
    assert got == [(1, "a", "out"), (2, "a", "in"), (2, "b", "out"), (3, "b", "in"), (3, "b", "out"), (4, "a", "in"), (4, "a", "out")]


def test_bindings(spark):
    binds = spark.createDataFrame([(1, "x", "a", 0), (1, "x", "b", 3), (1, "x", "c", 3), (1, "y", "d", 9), (2, "x", "e", 1)], "scope long, variable string, path string, since long")
    scopes = spark.createDataFrame([(1, 5)], "scope long, ends long")
    intervals = dataflow.binding_intervals(binds, scopes)
    assert sorted(map(tuple, intervals.collect())) == [(1, "x", "a", 0, 3), (1, "x", "c", 3, 5)]
    asked = spark.createDataFrame([(1, "x", 2), (1, "x", 3), (1, "x", 5), (1, "y", 9), (None, "x", 1)], "scope long, variable string, place long")
    got = {(r.scope, r.variable, r.place): r.path for r in dataflow.bound_paths(asked, intervals).collect()}
    assert got == {(1, "x", 2): "a", (1, "x", 3): "c", (1, "x", 5): None, (1, "y", 9): None, (None, "x", 1): None}


def test_cost_summary_and_scope(spark):
    now, before = spark.createDataFrame([(None,), (0,), (-1,), (2,)], "degree long"), spark.createDataFrame([], "degree long")
    assert sorted(map(tuple, diff.cost_summary(now, before).collect())) == [("top", 1, 0), ("unreachable", 1, 0), ("zero", 1, 0)]
    paths = spark.createDataFrame([("a/x",), ("b/x",), (None,)], "p string")
    keep = lambda *a: [r.p for r in paths.where(diff.in_scope(F.col("p"), *a)).collect()]
    assert (keep(), keep(["^a"]), keep([], ["^a"]), keep(["x"], ["x"])) == (["a/x", "b/x"], ["a/x"], ["b/x"], [])


def test_access_tree(spark):
    schema = "base string, path array<string>, trace string"
    rows = [("x", ["f"], "a"), ("x", ["f", "g", "h"], "b"), ("x", ["f", "g"], "c"), ("y", ["p"], "a"), ("y", ["q", "r"], "b"), ("y", ["s"], None), ("y", [], "d"), ("z", None, "a"), (None, ["f"], "a"), (None, ["f"], "a")]
    tree = dataflow.access_tree(spark.createDataFrame(rows, schema), 2, 2)
    got = {(r.base, tuple(r.path)): (r.star, r.traces) for r in tree.collect()}
    # x.f.g is cut at depth 2; y has three successors and becomes a starred leaf with all that lay below
    assert got == {("x", ()): (False, []), ("x", ("f",)): (False, ["a"]), ("x", ("f", "g")): (True, ["b", "c"]), ("y", ()): (True, ["a", "b", "d"]), (None, ()): (False, []), (None, ("f",)): (False, ["a"])}
    asked = spark.createDataFrame([("x", ["f", "g", "z"]), ("x", []), ("x", ["k"]), ("y", ["q"]), (None, ["f"])], "base string, path array<string>")
    assert [r.traces for r in sorted(dataflow.tree_traces(tree, asked).collect(), key=lambda r: (r.base or "", r.path))] == [["a"], [], ["b", "c"], None, ["a", "b", "d"]]
    assert dataflow.access_tree(spark.createDataFrame([], schema), 2, 2).count() == 0


def test_visit_priorities_and_ui(spark):
    edges = spark.createDataFrame([(1, 3), (1, 3), (2, 3), (1, 4), (2, 5)], "src long, dst long")
    visited = spark.createDataFrame([(1,), (1,), (None,)], "node long")
    assert sorted(map(tuple, dataflow.visit_priorities(edges, visited).collect())) == [(3, 1), (4, 0)]
    now = spark.createDataFrame([(1, 3, True), (2, 3, False), (3, 3, None), (4, None, True)], "procedure long, degree long, on_ui boolean")
    before = now.select("procedure", F.lit(1).alias("degree"))
    kinds = {r.procedure: r.kind for r in diff.cost_change(now, before, on_ui="on_ui").collect()}
    assert kinds == {1: "COMPLEXITY_INCREASE_UI_THREAD", 2: "COMPLEXITY_INCREASE", 3: "COMPLEXITY_INCREASE", 4: "INFINITE_EXECUTION_TIME"}
