"""Queries read all rows of their tables: fixtures with ids beyond those of the smallest tables."""

from __future__ import annotations

import itertools
import random

from stratalake import registry
from stratalake.operators import graph

QUERIES = registry.all_queries()


def test_weak_topological_order_of_all_parts(spark, tmp_path):
    spark.range(0, 1300).withColumnRenamed("id", "p_partkey").write.parquet(f"{tmp_path}/part.parquet")
    rows = QUERIES["weak_topological_order"].run(spark, str(tmp_path)).collect()
    assert sorted(r.graph for r in rows) == sorted(f"g{k}" for k in range(21))
    for row in rows:
        at, heads, open_heads = {}, {}, []
        for token in row.wto.split():
            node = int(token.strip("()"))
            open_heads += [node] * token.count("(")
            at[node], heads[node] = len(at), set(open_heads)
            for _ in range(token.count(")")):
                open_heads.pop()
        n = min(64, 1300 - 64 * int(row.graph[1:]))
        edges = [(k // 2, k) for k in range(2, n + 1)] + [(k, k // 4) for k in range(5, n + 1, 5)]
        assert sorted(at) == list(range(1, n + 1))
        # an edge leads on, or back to the head of a component that its source lies in
        assert all(at[u] < at[v] or v in heads[u] for u, v in edges)


def test_deep_graphs():
    """Chains of any length: no visit recurses."""
    chain = {k: [k + 1] for k in range(50_000)}
    assert graph.reverse_postorder(chain, 0) == list(range(50_001))
    assert graph.weak_topological_order(chain, 0) == list(range(50_001))
    nested = {k: [k + 1, 0] for k in range(300)}
    assert graph._printed(graph.weak_topological_order(nested, 0)).count("(") == 1
    assert graph.immediate_dominators({1: [2, 3], 2: [4], 3: [4], 4: [5, 2]}, 1) == {1: 1, 2: 1, 3: 1, 4: 1, 5: 4}


def test_rich_nodes_of_all_suppliers(spark, tmp_path):
    lines = [(src, 45) for src in range(1, 9)] + [(1, 46), (1, 46), (2, 47)]
    spark.createDataFrame(lines, "l_partkey long, l_suppkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(45, 1), (46, 1), (50, 1), (47, 2)], "s_suppkey long, s_nationkey int").write.parquet(f"{tmp_path}/supplier.parquet")
    got = sorted((r.src, r.dst - 1_000_000) for r in QUERIES["rich_nodes"].run(spark, str(tmp_path)).collect())
    assert got == sorted([(src, 45) for src in (1, 2, 3, 4, 5, 8)] + [(6, 50), (7, 46), (1, 46), (2, 47)])


def test_conflicts_are_made_once(spark, tmp_path):
    """Each pair comes out of the join once: no rows of the join are dealt out again to remove repeated ones."""
    rng = random.Random(4)
    rows = [(rng.choice([None, *range(12)]), rng.choice([None, "purchase", "purchase", "view", "click"]), rng.choice([None, 0.05, 0.15, 0.151, 3.0])) for _ in range(150)]
    spark.createDataFrame(rows, "user_id long, event_type string, value double").write.parquet(f"{tmp_path}/events.parquet")
    found = QUERIES["conflicting_accesses"].run(spark, str(tmp_path))
    want = set()
    for (u, p, a), (v, q, b) in itertools.product([r for r in rows if None not in r], repeat=2):
        if u < v and int(a * 10) == int(b * 10) and p != q and "purchase" in (p, q):
            want.add((u, v, int(a * 10)))
    assert want and sorted(tuple(r) for r in found.collect()) == sorted(want)
    above = found._jdf.queryExecution().optimizedPlan().toString().split("Join ")[0]
    assert "Aggregate" not in above


def test_similar_pairs_broadcast_no_nodes(spark):
    """Parts are below Spark's own limit for broadcasts here, as they are in a file of a million."""
    plan = QUERIES["similarity_pairs"].run(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    joins = [line for line in plan.splitlines() if "Join" in line and ("[a_" in line or "[b_" in line)]
    assert len(joins) >= 9 and all("SortMergeJoin" in line for line in joins)
