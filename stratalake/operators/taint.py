"""Taint flows: sources and sinks of call facts, sanitizers, propagation rules of unknown calls, witnesses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratalake.operators.graph import reachable

#: Types that never carry taint are those outside this list, once a type is known.
TAINTABLE = ("java.lang.String", "java.lang.CharSequence", "java.lang.Object", "java.net.URI")


def endpoints(calls: DataFrame, specs: DataFrame) -> DataFrame:
    """Call sites (site, proc) that a spec (proc, kind or kinds, index) names, one row for each of its kinds."""
    kinds = specs
    if "kinds" in specs.columns:
        own = F.array("kind") if "kind" in specs.columns else F.array().cast("array<string>")
        kinds = specs.withColumn("kind", F.explode(F.array_compact(F.array_union(own, F.coalesce("kinds", F.array().cast("array<string>"))))))
    return calls.join(kinds.select("proc", "kind", *(["index"] if "index" in specs.columns else [])), "proc")


def flows(edges: DataFrame, sources: DataFrame, sinks: DataFrame, sanitizers: DataFrame | None = None, max_depth: int = 1000) -> DataFrame:
    """(source, sink, kind, depth): sinks (node, kind) that a source (node, kind) of the same kind reaches over edges (src, dst).

    A flow of a kind doesn't enter a sanitizer (node, kind; the kind All stops every flow). A source that is itself a sink of its kind counts.
    """
    start = sources.select(F.col("node").alias("source"), "kind", "node")
    blocked = () if sanitizers is None else (sanitizers.where("kind <> 'All'").select("node", "kind"), sanitizers.where("kind = 'All'").select("node"))
    walked = reachable(edges, start, max_depth, ("source", "kind"), blocked=blocked)
    return walked.join(sinks.select("node", "kind").distinct(), ["node", "kind"]).select("source", F.col("node").alias("sink"), "kind", "depth")


def unknown_call(return_type: Column, is_static: Column, is_constructor: Column) -> Column:
    """Where a call without a body passes taint of its arguments: receiver, return, both or none.

    Constructors taint their receiver; calls that return nothing or a primitive taint the receiver if there is one; static
    calls their result; others both.
    """
    plain = return_type.isin("void", "boolean", "byte", "char", "short", "int", "long", "float", "double")
    return F.when(is_constructor, "receiver").when(plain, F.when(is_static, "none").otherwise("receiver")).when(is_static, "return").otherwise("both")


def annotation_reach(calls: DataFrame, sources: DataFrame, sinks: DataFrame, max_depth: int = 1000) -> DataFrame:
    """(source, sink, witness, depth): annotated procedures that reach others through calls, with the least first call on a shortest way."""
    walked = reachable(calls, sources.select(F.col("node").alias("source"), "node"), max_depth, ("source",))
    hit = walked.join(sinks.select("node").distinct(), "node").where("depth > 0").select("source", F.col("node").alias("sink"), "depth")
    first = calls.select(F.col("src").alias("source"), F.col("dst").alias("witness")).distinct().join(hit.select("source").distinct(), "source", "left_semi")
    after = reachable(calls, first.select("witness", F.col("witness").alias("node")).distinct(), max_depth, ("witness",)).select("witness", F.col("node").alias("sink"), (F.col("depth") + 1).alias("depth"))
    return hit.join(first, "source").join(after, ["witness", "sink", "depth"]).groupBy("source", "sink", "depth").agg(F.min("witness").alias("witness"))
