"""Graph operators as semi-naive iteration over edge tables.

Each round joins only the new frontier to the edges and is written to the checkpoint folder, so plans stay short and a lost
executor costs a read. The driver sees one count a round.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Generator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def cut(df: DataFrame) -> DataFrame:
    """The rows written to the shared folder and read again."""
    spark = df.sparkSession
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = "file://" + tempfile.mkdtemp(prefix="stratalake-")
        spark.conf.set("spark.checkpoint.dir", root)
    path = f"{root.rstrip('/')}/round-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def reachable(edges: DataFrame, sources: DataFrame, max_depth: int = 1000, carry: tuple[str, ...] = (), stop: DataFrame | None = None, blocked: tuple[DataFrame, ...] = ()) -> DataFrame:
    """(carry..., node, depth): nodes within max_depth edges (src, dst) of the sources (carry..., node), at their least depth.

    With carry columns each value walks by itself. Paths go into stop nodes but not on from them, and never into rows of a
    blocked table (node and any of the carry columns).
    """
    key = [*carry, "node"]
    seen = cut(sources.select(*key).distinct().withColumn("depth", F.lit(0)))
    frontier, depth = seen, 0
    e = edges.select("src", "dst").distinct()
    parts = [seen]
    while depth < max_depth:
        depth += 1
        start = frontier if stop is None else frontier.join(stop.select(F.col(stop.columns[0]).alias("node")), "node", "left_anti")
        step = start.join(e, start["node"] == e["src"]).select(*carry, F.col("dst").alias("node")).distinct()
        for b in blocked:
            step = step.join(b, [c for c in key if c in b.columns], "left_anti")
        known = parts[0]
        for p in parts[1:]:
            known = known.unionByName(p)
        frontier = cut(step.join(known, key, "left_anti").withColumn("depth", F.lit(depth)))
        if frontier.isEmpty():
            break
        parts.append(frontier)
        if len(parts) > 8:
            whole = parts[0]
            for p in parts[1:]:
                whole = whole.unionByName(p)
            parts = [cut(whole)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def reversed_edges(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))


def components(edges: DataFrame, max_rounds: int = 200) -> DataFrame:
    """(node, component): the least node reachable without regard to direction, by minimum labels with pointer jumping."""
    both = cut(edges.select("src", "dst").unionByName(reversed_edges(edges)).distinct())
    labels = cut(both.groupBy(F.col("src").alias("node")).agg(F.least(F.min("src"), F.min("dst")).alias("component")))
    for _ in range(max_rounds):
        near = both.join(labels, both["dst"] == labels["node"]).groupBy("src").agg(F.min("component").alias("low"))
        step = labels.join(near, labels["node"] == near["src"], "left").select("node", "component", F.least("component", "low").alias("next"))
        # jump: a label's own label
        own = step.select(F.col("node").alias("next"), F.col("next").alias("jump"))
        moved = cut(step.join(own, "next", "left").select("node", "component", F.least("next", F.coalesce("jump", "next")).alias("next")))
        changed = not moved.where("next < component").isEmpty()
        labels = moved.select("node", F.col("next").alias("component"))
        if not changed:
            return labels
    return labels


def levels(edges: DataFrame, max_rounds: int = 10_000) -> DataFrame:
    """(node, level) by peeling leaves: a node's level is the length of the longest path from it to a leaf; nodes on or before a
    cycle have none and are left out."""
    e = cut(edges.select("src", "dst").where("src <> dst").distinct())
    left = cut(e.select(F.col("src").alias("node")).union(e.select("dst")).distinct())
    done = None
    for level in range(max_rounds):
        leaves = cut(left.join(e.select(F.col("src").alias("node")).distinct(), "node", "left_anti").withColumn("level", F.lit(level)))
        if leaves.isEmpty():
            break
        done = leaves if done is None else done.unionByName(leaves)
        gone = leaves.select("node")
        left = cut(left.join(gone, "node", "left_anti"))
        e = cut(e.join(gone.withColumnRenamed("node", "dst"), "dst", "left_anti").select("src", "dst"))
    return done if done is not None else left.withColumn("level", F.lit(0)).limit(0)


def acyclic(edges: DataFrame, order: DataFrame) -> DataFrame:
    """The edges that go up in a total order (node, rank): what is left has no cycle."""
    a, b = order.select(F.col("node").alias("src"), F.col("rank").alias("__a")), order.select(F.col("node").alias("dst"), F.col("rank").alias("__b"))
    return edges.join(a, "src").join(b, "dst").where("__a < __b").select(*edges.columns)


def simple_paths(edges: DataFrame, starts: DataFrame, ends: DataFrame, max_edges: int) -> DataFrame:
    """(path, kinds) of all simple undirected paths of at most max_edges edges (src, dst, kind) from a start to an end node.

    kinds holds --kind--> or <--kind-- for each step. The number of paths grows exponentially with the bound.
    """
    forward = edges.select("src", "dst", F.concat(F.lit("--"), "kind", F.lit("-->")).alias("step"))
    backward = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.concat(F.lit("<--"), "kind", F.lit("--")).alias("step"))
    both = cut(forward.unionByName(backward).distinct())
    goal = ends.select(F.col(ends.columns[0]).alias("at")).distinct()
    walk = cut(starts.select(F.col(starts.columns[0]).alias("at")).distinct().select("at", F.array("at").alias("path"), F.array().cast("array<string>").alias("kinds")))
    found = None
    for _ in range(max_edges):
        nxt = walk.join(both, walk["at"] == both["src"]).where(~F.array_contains("path", F.col("dst"))).select(F.col("dst").alias("at"), F.concat("path", F.array("dst")).alias("path"), F.concat("kinds", F.array("step")).alias("kinds"))
        walk = cut(nxt)
        hit = walk.join(goal, "at", "left_semi").select("path", "kinds")
        found = hit if found is None else found.unionByName(hit)
        if walk.isEmpty():
            break
    return found


def rendered(path, kinds):
    """A path as text: a<--kind--b--kind-->c."""
    return F.concat(F.element_at(path, 1).cast("string"), F.array_join(F.zip_with(kinds, F.slice(path, 2, 1 << 20), lambda k, n: F.concat(k, n.cast("string"))), ""))


def _run(visit: Callable[..., Generator], *start):
    """The result of a recursive visit, written as a generator that yields the arguments of its inner visits, on a stack of one's own."""
    stack, value = [visit(*start)], None
    while stack:
        try:
            inner = stack[-1].send(value)
        except StopIteration as e:
            stack.pop()
            value = e.value
        else:
            stack.append(visit(*inner))
            value = None
    return value


def weak_topological_order(edges: dict[int, list[int]], start: int) -> list:
    """Nested components of one graph: numbers and lists whose first entry is their head. Recursive strategy over depth-first
    numbers; later successors are visited first, as what is visited first ends up last."""
    number: dict[int, float] = {}
    stack: list[int] = []
    clock = 0

    def visit(v: int, out: list) -> Generator:
        nonlocal clock
        stack.append(v)
        clock += 1
        head = number[v] = clock
        loop = False
        for w in reversed(edges.get(v, [])):
            low = (yield w, out) if w not in number else number[w]
            if low <= head:
                head, loop = low, True
        if head == number[v]:
            number[v] = float("inf")
            x = stack.pop()
            if loop:
                while x != v:
                    del number[x]
                    x = stack.pop()
                inner: list = []
                for w in reversed(edges.get(v, [])):
                    if w not in number:
                        yield w, inner
                out.append([v, *inner[::-1]])
            else:
                out.append(v)
        return head

    out: list = []
    _run(visit, start, out)
    return out[::-1]


def _printed(order: list) -> str:
    parts, todo = [], [iter(order)]
    while todo:
        x = next(todo[-1], None)
        if x is None:
            todo.pop()
            if todo:
                parts[-1] += ")"
        elif isinstance(x, list):
            todo.append(iter(x[1:]))
            parts.append(f"({x[0]}")
        else:
            parts.append(str(x))
    return " ".join(parts)


def weak_topological_orders(edges: DataFrame, start: int = 1) -> DataFrame:
    """(graph, wto) of many small graphs (graph, src, dst), each worked on in one group; edges in the order of their rows' seq column."""
    import pandas as pd

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        out: dict[int, list[int]] = {}
        for s, d in pdf.sort_values("seq")[["src", "dst"]].itertuples(index=False):
            out.setdefault(int(s), []).append(int(d))
        return pd.DataFrame({"graph": [pdf["graph"].iloc[0]], "wto": [_printed(weak_topological_order(out, start))]})

    return edges.groupBy("graph").applyInPandas(one, "graph string, wto string")


def reverse_postorder(edges: dict[int, list[int]], start: int) -> list[int]:
    seen, out = {start}, []
    stack = [(start, iter(edges.get(start, [])))]
    while stack:
        v, rest = stack[-1]
        w = next((w for w in rest if w not in seen), None)
        if w is None:
            stack.pop()
            out.append(v)
        else:
            seen.add(w)
            stack.append((w, iter(edges.get(w, []))))
    return out[::-1]


def immediate_dominators(edges: dict[int, list[int]], root: int) -> dict[int, int]:
    """The nearest dominator of each node that the root reaches, the root's being itself; by intersecting upward in reverse postorder."""
    order = reverse_postorder(edges, root)
    place = {n: k for k, n in enumerate(order)}
    before: dict[int, list[int]] = {}
    for n in order:
        for m in edges.get(n, []):
            before.setdefault(m, []).append(n)
    near, changed = {root: root}, True
    while changed:
        changed = False
        for n in order[1:]:
            new = None
            for p in before[n]:
                if p in near:
                    a, b = p, p if new is None else new
                    while a != b:
                        if place[a] > place[b]:
                            a = near[a]
                        else:
                            b = near[b]
                    new = a
            if near.get(n) != new:
                near[n], changed = new, True
    return near


def dominators(edges: DataFrame, root: int) -> DataFrame:
    """(graph, node, dominator, immediate), each node's own included, for nodes reachable from the root; a graph (one procedure's) is
    worked on in one group, by the chains of nearest dominators. immediate marks the nearest one other than the node."""
    import pandas as pd

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        succ: dict[int, set[int]] = {}
        for s, d in pdf[["src", "dst"]].itertuples(index=False):
            succ.setdefault(int(s), set()).add(int(d))
        near = immediate_dominators({k: sorted(v) for k, v in succ.items()}, root)
        rows = []
        for n in near:
            d = n
            rows.append((pdf["graph"].iloc[0], n, n, False))
            while near[d] != d:
                d = near[d]
                rows.append((pdf["graph"].iloc[0], n, d, d == near[n]))
        return pd.DataFrame(rows, columns=["graph", "node", "dominator", "immediate"])

    return edges.groupBy("graph").applyInPandas(one, "graph string, node long, dominator long, immediate boolean")


#: The place outside a graph that its exits lead to.
EXIT = "exit"


def control_dependence(edges: DataFrame) -> DataFrame:
    """(graph, branch, node): the node runs or not as the branch decides. Edges are (graph, src, dst); a null dst leaves the graph.

    A node depends on a branch if it is on all ways from one of the branch's successors to the exit, but not on all from the branch
    itself. Each edge's nodes are walked up the nearest postdominators. Nodes that reach no exit are left out; a graph (one
    procedure's) is worked on in one group.
    """
    import pandas as pd

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        after: dict[object, set] = {}
        before: dict[object, list] = {}
        for s, d in pdf[["src", "dst"]].itertuples(index=False):
            d = EXIT if pd.isna(d) else int(d)
            after.setdefault(int(s), set()).add(d)
        for s in sorted(after):
            for d in after[s]:
                before.setdefault(d, []).append(s)
        near = immediate_dominators(before, EXIT)
        found = set()
        for branch, ways in after.items():
            for node in ways if branch in near else ():
                while node in near and node != near[branch]:
                    found.add((branch, node))
                    node = near[node]
        return pd.DataFrame([(pdf["graph"].iloc[0], b, n) for b, n in sorted(found)], columns=["graph", "branch", "node"])

    return edges.groupBy("graph").applyInPandas(one, "graph string, branch long, node long")


def relieve_rich_nodes(edges: DataFrame, similar: DataFrame, limit: int = 6) -> DataFrame:
    """(src, dst): edges into rich nodes (in-degree of at least limit) moved to a similar node of fewer in-edges.

    In the order of src, the r-th surplus edge of a rich node goes to its r-th similar node (by degree, then id) that isn't rich;
    edges for which none is left stay. One deterministic round; all nodes are worked on at once.
    """
    from pyspark.sql import Window

    degree = edges.groupBy(F.col("dst").alias("node")).agg(F.count(F.lit(1)).alias("degree"))
    rich = degree.where(F.col("degree") >= limit).select("node")
    place = F.row_number().over(Window.partitionBy("dst").orderBy("src"))
    ranked = edges.select("src", "dst").withColumn("r", place)
    surplus = ranked.join(rich.withColumnRenamed("node", "dst"), "dst", "left_semi").where(F.col("r") >= limit).withColumn("r", F.col("r") - limit + 1)
    room = similar.join(degree, similar["other"] == degree["node"], "left").where((F.coalesce("degree", F.lit(0)) < limit - 1)).select(similar["node"].alias("dst"), "other", F.coalesce("degree", F.lit(0)).alias("degree"))
    room = room.withColumn("r", F.row_number().over(Window.partitionBy("dst").orderBy("degree", "other")))
    moved = surplus.join(room, ["dst", "r"], "left").select("src", F.when(F.col("other") != F.col("src"), F.col("other")).alias("other"), "dst")
    kept = ranked.join(surplus.select("src", "dst"), ["src", "dst"], "left_anti").select("src", "dst")
    return kept.unionByName(moved.select("src", F.coalesce("other", "dst").alias("dst")))


def small_components(edges: DataFrame, most: int) -> DataFrame:
    """(component, n): the connected components of at most so many nodes, and their number of nodes."""
    return components(edges).groupBy("component").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") <= most)
