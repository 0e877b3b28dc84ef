"""Dataflow analyses as fixpoints over (node, fact) relations."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stratalake.operators.graph import cut, reachable


def fixpoint(start: DataFrame, step: Callable[[DataFrame], DataFrame], max_rounds: int = 1000) -> DataFrame:
    """The least set of rows that holds start and step of itself; step must be a union of joins of its argument (monotone).

    Each round writes its new rows only; after eight rounds what was written is put together.
    """
    parts = [cut(start.distinct())]
    key = parts[0].columns
    for _ in range(max_rounds):
        frontier = cut(step(parts[-1]).select(*key).distinct().join(_union(parts), key, "left_anti"))
        if frontier.isEmpty():
            break
        if len(parts) > 8:
            # the newest rows stay apart: the next round starts from them
            parts = [cut(_union(parts))]
        parts.append(frontier)
    return _union(parts)


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def may_facts(edges: DataFrame, gen: DataFrame, kill: DataFrame, max_rounds: int = 1000) -> DataFrame:
    """(node, fact) that hold at a node's exit along some path: gen(node, fact) and what enters unkilled (kill(node, fact)).

    Forward on edges (src, dst); a backward analysis takes reversed edges.
    """
    e = edges.select("src", "dst").distinct()
    dead = kill.select("node", "fact").distinct()

    def step(new: DataFrame) -> DataFrame:
        moved = new.join(e, new["node"] == e["src"]).select(F.col("dst").alias("node"), "fact")
        return moved.join(dead, ["node", "fact"], "left_anti")

    return fixpoint(gen.select("node", "fact"), step, max_rounds)


def may_facts_throwing(edges: DataFrame, throws: DataFrame, gen: DataFrame, kill: DataFrame, max_rounds: int = 1000) -> DataFrame:
    """(node, fact, place) as in may_facts, at entries (in) and exits (out), where a node may also be left by an exception.

    Along an edge of throws (src, dst) goes what holds at the source's entry: a node that throws has neither made nor killed facts.
    """
    e, x = cut(edges.select("src", "dst").distinct()), cut(throws.select("src", "dst").distinct())
    dead, made = cut(kill.select("node", "fact").distinct()), gen.select("node", "fact").distinct()

    def along(facts: DataFrame, ways: DataFrame) -> DataFrame:
        return facts.join(ways, facts["node"] == ways["src"]).select(F.col("dst").alias("node"), "fact")

    def through(facts: DataFrame) -> DataFrame:
        return facts.join(dead, ["node", "fact"], "left_anti")

    # entries alone are iterated on; exits follow from them
    entries = fixpoint(along(made, e), lambda new: along(through(new), e).unionByName(along(new, x)), max_rounds)
    exits = made.unionByName(through(entries)).distinct()
    return entries.withColumn("place", F.lit("in")).unionByName(exits.withColumn("place", F.lit("out")))


def binding_intervals(binds: DataFrame, scopes: DataFrame) -> DataFrame:
    """(scope, variable, path, since, until): a binding (scope, variable, path, since) holds until the variable's next one in the scope, or
    the scope's end (scope, ends), whichever comes first. Of bindings at one place the last by path stays; those that never hold go."""
    own = Window.partitionBy("scope", "variable").orderBy("since", "path")
    b = binds.select("scope", "variable", "path", "since").join(scopes.select("scope", "ends"), "scope")
    return b.select("scope", "variable", "path", "since", F.least(F.lead("since").over(own), "ends").alias("until")).where("since < until")


def bound_paths(accesses: DataFrame, intervals: DataFrame) -> DataFrame:
    """accesses (scope, variable, place) with the path bound there; null where the variable is unbound or its scope has ended."""
    i = intervals.select("scope", "variable", "path", "since", "until")
    a = accesses.select("scope", "variable", "place")
    return a.join(i, (a["scope"] == i["scope"]) & (a["variable"] == i["variable"]) & (a["place"] >= i["since"]) & (a["place"] < i["until"]), "left").select(a["scope"], a["variable"], "place", "path")


def entering(edges: DataFrame, exits: DataFrame) -> DataFrame:
    """(node, fact) at a node's entry: the facts at the exits of the nodes before it."""
    return exits.join(edges.select("src", "dst").distinct(), F.col("node") == F.col("src")).select(F.col("dst").alias("node"), "fact").distinct()


def reaching_definitions(edges: DataFrame, defs: DataFrame, strong: DataFrame | None = None) -> DataFrame:
    """(node, variable, definition): definitions that reach a node's exit.

    defs is (node, variable). A definition is named by its node; one of the same variable kills it. strong lists the nodes
    whose definitions kill (all, if it is None); weak ones only add.
    """
    d = defs.select("node", "variable").distinct()
    e = edges.select("src", "dst").distinct()
    # by variable, not by pairs of definitions: a node's own definition is there from the start
    killers = d if strong is None else d.join(strong.select("node").distinct(), "node", "left_semi")

    def step(new: DataFrame) -> DataFrame:
        moved = new.join(e, new["node"] == e["src"]).select(F.col("dst").alias("node"), "variable", "definition")
        return moved.join(killers, ["node", "variable"], "left_anti")

    return fixpoint(d.select("node", "variable", F.col("node").alias("definition")), step)


def live_variables(edges: DataFrame, uses: DataFrame, defs: DataFrame) -> DataFrame:
    """(node, variable) live at a node's entry: used there, or live after it and not defined there."""
    gen = uses.select("node", F.col("variable").alias("fact"))
    kill = defs.select("node", F.col("variable").alias("fact"))
    backward = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return may_facts(backward, gen, kill).select("node", F.col("fact").alias("variable"))


def address_taken(edges: DataFrame, taken: DataFrame) -> DataFrame:
    """(node, variable) whose address is taken on some path to the node's exit; nothing is ever untaken."""
    none = taken.select("node", F.col("variable").alias("fact")).limit(0)
    return may_facts(edges, taken.select("node", F.col("variable").alias("fact")), none).select("node", F.col("fact").alias("variable"))


def impure(calls: DataFrame, writes: DataFrame) -> DataFrame:
    """Procedures that modify something: by themselves (writes.proc) or through a callee (calls caller, callee)."""
    up = calls.select(F.col("callee").alias("src"), F.col("caller").alias("dst"))
    return reachable(up, writes.select(F.col("proc").alias("node"))).select(F.col("node").alias("proc")).distinct()


def loop_invariants(loops: DataFrame, uses: DataFrame, defs: DataFrame) -> DataFrame:
    """(loop, variable) used in a loop (loop, node) in which no node defines it."""
    used = loops.join(uses, "node").select("loop", "variable").distinct()
    return used.join(loops.join(defs, "node").select("loop", "variable").distinct(), ["loop", "variable"], "left_anti")


def resolved_pointers(calls: DataFrame, points_to: DataFrame) -> DataFrame:
    """calls (site, pointer) with the procedure called: the least one where a pointer may hold several, else the pointer itself."""
    least = points_to.groupBy("pointer").agg(F.min("proc").alias("proc"))
    return calls.join(least, "pointer", "left").select("site", F.coalesce("proc", "pointer").alias("callee"))


def definition_chains(aliases: DataFrame, starts: DataFrame, max_depth: int = 50) -> DataFrame:
    """(origin, definition, location, depth): where a value goes from definition to definition through aliases (src, dst)."""
    walked = reachable(aliases, starts.select(F.col("node").alias("origin"), "node"), max_depth, ("origin",))
    return walked.select("origin", F.col("node").alias("definition"), "depth")


def limited_path(path, k: int):
    """An access path of at most k fields; a longer one ends in *."""
    return F.when(F.size(path) > k, F.concat(F.slice(path, 1, k), F.array(F.lit("*")))).otherwise(path)


def replaced_prefix(path, old, new):
    """path with its prefix old replaced by new, if it has it."""
    return F.when(F.slice(path, F.lit(1), F.size(old)) == old, F.concat(new, F.slice(path, F.size(old) + 1, F.lit(1 << 20)))).otherwise(path)


def strong_update(aliases, old, new):
    """An alias set in which one element is replaced by another."""
    return F.array_sort(F.array_union(F.array_remove(aliases, old), F.array(new)))


def _prefixes(path):
    """A path's prefixes, the empty one and the path itself included."""
    return F.transform(F.sequence(F.lit(0), F.size(path)), lambda k: F.slice(path, F.lit(1), k))


def access_tree(rows: DataFrame, depth: int, width: int) -> DataFrame:
    """(base, path, star, traces): the nodes of the trees that rows (base, path, trace) make, joined by base.

    A node keeps the traces of the paths that end in it; inner nodes without any have an empty list. A path of more than depth fields
    ends in a starred leaf at that depth, and a node of more than width different successors becomes a starred leaf; a starred
    leaf takes the traces of all that lay below it. Null traces and repeated rows add nothing, rows with a null path are left out.
    """
    at = rows.where("path IS NOT NULL").select("base", F.slice("path", 1, depth).alias("path"), (F.size("path") > depth).alias("star"), "trace").distinct()
    steps = at.select("base", F.posexplode(_prefixes(F.col("path"))).alias("k", "node"), "path", "star")
    inner = F.col("k") < F.size("path")
    # both ways to become a starred leaf: a path cut there, or too many successors
    marks = steps.groupBy("base", "node").agg(F.countDistinct(F.when(inner, F.struct(F.element_at("path", F.least(F.col("k") + 1, F.size("path")))))).alias("n"), F.max(F.col("star") & ~inner).alias("cut")).where((F.col("n") > width) | F.col("cut"))
    marks = marks.select(F.col("base").alias("__base"), F.col("node").alias("__node"))
    paths = steps.select("base", "path", "k", "node").distinct()
    # null bases make a tree of their own
    leaf = paths.join(marks, F.col("base").eqNullSafe(F.col("__base")) & (F.col("node") == F.col("__node"))).groupBy("base", "path").agg(F.min("k").alias("__k"))
    leaf = leaf.select(F.col("base").alias("__base"), F.col("path").alias("__path"), "__k")
    ends = at.join(leaf, F.col("base").eqNullSafe(F.col("__base")) & (F.col("path") == F.col("__path")), "left")
    ends = ends.select("base", F.when(F.col("__k").isNull(), F.col("path")).otherwise(F.slice("path", F.lit(1), F.col("__k"))).alias("path"), F.col("__k").isNotNull().alias("star"), "trace")
    nodes = ends.distinct().select("base", F.explode(_prefixes(F.col("path"))).alias("node"), "path", "star", "trace")
    own = F.size("node") == F.size("path")
    return nodes.groupBy("base", F.col("node").alias("path")).agg(F.max(F.col("star") & own).alias("star"), F.array_sort(F.collect_set(F.when(own, F.col("trace")))).alias("traces"))


def tree_traces(tree: DataFrame, asked: DataFrame) -> DataFrame:
    """asked (base, path) with traces: those of the path's node or of the starred leaf above it; null where the tree has neither."""
    found = asked.select("base", "path").distinct().select(F.col("base").alias("__base"), F.col("path").alias("__asked"), F.explode(_prefixes(F.col("path"))).alias("__node"))
    found = found.join(tree, F.col("__base").eqNullSafe(F.col("base")) & (F.col("__node") == F.col("path"))).where("star OR __node = __asked").select("__base", "__asked", "traces")
    return asked.join(found, F.col("base").eqNullSafe(F.col("__base")) & (F.col("path") == F.col("__asked")), "left").select(*(asked[c] for c in asked.columns), "traces")


def visit_priorities(edges: DataFrame, visited: DataFrame) -> DataFrame:
    """(node, priority) of each node with a visited predecessor: its different predecessors that aren't visited yet.

    edges (src, dst), visited (node); the node of the least priority, then of the least id, is the next to visit.
    """
    done = visited.select(F.col("node").alias("src")).where("src IS NOT NULL").distinct().withColumn("__done", F.lit(1))
    counted = edges.select("src", "dst").distinct().join(done, "src", "left").groupBy(F.col("dst").alias("node")).agg(F.count("src").alias("n"), F.count("__done").alias("seen"))
    return counted.where("seen > 0").select("node", (F.col("n") - F.col("seen")).alias("priority"))
