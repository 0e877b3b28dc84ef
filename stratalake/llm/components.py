"""Connected components: union-find inside tasks of bounded size, and star rounds where there are more edges than that."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalake.llm.common import materialise

#: Edges that one task takes at most when it works out whole components.
TASK_EDGES = 1 << 18


def contracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges (u, v) of a partition as stars: (node, least node that it is joined to here), without the least nodes themselves.

    Memory is bounded by TASK_EDGES at a time: a full table of parents is put out and begun anew, which loses no connection.
    """
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        top = x
        while (up := parent.setdefault(top, top)) != top:
            top = up
        while (up := parent[x]) != top:
            parent[x], x = top, up
        return top

    def stars() -> pa.RecordBatch:
        pairs = [(x, r) for x in parent if (r := root(x)) != x]
        return pa.RecordBatch.from_arrays([pa.array([p[k] for p in pairs], pa.int64()) for k in (0, 1)], names=["u", "v"])

    for batch in batches:
        for u, v in np.unique(np.stack([batch.column(0).to_numpy(), batch.column(1).to_numpy()], 1), axis=0).tolist() if batch.num_rows else ():
            a, b = root(u), root(v)
            if a < b:
                parent[b] = a
            elif b < a:
                parent[a] = b
        if len(parent) > 2 * TASK_EDGES:
            yield stars()
            parent.clear()
    if parent:
        yield stars()


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return tuple(row)


def connected_components(spark: SparkSession, edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of the undirected edges (u, v), longs; component is the least node reachable.

    Self-loops and repeated edges are ignored; an empty table gives an empty table. Nodes without edges to others don't appear.
    Every task first contracts its own edges to stars. While more than TASK_EDGES are left, alternating large-star and
    small-star rounds, each written to the shared folder, pull the stars together; a node of high degree is a partial minimum
    there, not a gathered list. What fits into one task is finished there.
    """
    e = edges.select(F.col("u").cast("long").alias("u"), F.col("v").cast("long").alias("v")).where("u <> v")
    e = materialise(spark, e.mapInArrow(contracted, "u long, v long"), "cc")
    before = _state(e)
    for _ in range(max_rounds):
        if before[0] <= TASK_EDGES:
            e = materialise(spark, e.coalesce(1).mapInArrow(contracted, "u long, v long"), "cc") if before[0] else e
            break
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.unionByName(low.select("u", F.col("m").alias("v"))).distinct()
        e = materialise(spark, small, "cc")
        after = _state(e)
        if after == before:
            break
        before = after
    roots = e.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
