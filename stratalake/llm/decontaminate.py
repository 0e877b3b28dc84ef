"""Benchmark decontamination by pigeonhole edit matching.

An item of m characters may differ by k = floor(rate * m) edits. Cut into k + 1 pieces, at least one piece stands unchanged
in any text that holds the item within k edits. An Aho-Corasick automaton finds all pieces in whole texts in one pass; each
hit fixes a window of the text, overlapping windows of one item are joined, and Myers' bit-parallel algorithm gives the
least edit distance of the item to a passage of the window. Letters are lower-cased and white space counts as one blank.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalake.llm.common import materialise, tidy

#: Bytes of items that one automaton holds (near 100 MB of memory): more items are taken in blocks, each against all texts.
ITEM_BYTES = 1 << 20


def normal(text: str | None) -> str:
    return " ".join((text or "").lower().split())


def pieces(item: str, rate: float) -> list[tuple[int, str]]:
    """(place, piece): floor(rate * length) + 1 pieces of nearly equal length that make up the item."""
    n = int(rate * len(item)) + 1
    cuts = [len(item) * i // n for i in range(n + 1)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


def myers(item: str, text: str, limit: int) -> tuple[int, int] | None:
    """(least distance, its first end) of the item to any passage of the text, or None if it is over limit."""
    m = len(item)
    masks: dict[str, int] = {}
    for i, c in enumerate(item):
        masks[c] = masks.get(c, 0) | 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score, best, end = full, 0, m, limit + 1, -1
    for j, c in enumerate(text):
        eq = masks.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | ~(xh | pv) & full
        mh = pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph = ph << 1 & full
        pv = (mh << 1 | ~(xv | ph)) & full
        mv = ph & xv
        if score < best:
            best, end = score, j + 1
            if not best:
                break
    return (best, end) if best <= limit else None


class Matcher:
    """All items of one block against texts. Items of one text are matched once, so items is (ids, text) here."""

    def __init__(self, items: list[tuple[int, str]], rate: float):
        alike: dict[str, list[int]] = {}
        for i, t in items:
            alike.setdefault(t, []).append(i)
        self.items = [(ids, t) for t, ids in alike.items()]
        self.limits = [int(rate * len(t)) for _, t in self.items]
        owners: dict[str, list[tuple[int, int]]] = {}
        for k, (_, t) in enumerate(self.items):
            for at, p in pieces(t, rate):
                owners.setdefault(p, []).append((k, at))
        self.machine = ahocorasick.Automaton()
        for p, own in owners.items():
            self.machine.add_word(p, (len(p), own))
        if owners:
            self.machine.make_automaton()
        self.any = bool(owners)

    def find(self, text: str) -> list[tuple[int, int, int]]:
        """(index of the item's text, distance, end) for each that the text holds within its budget."""
        if not self.any or not text:
            return []
        windows: dict[int, list[tuple[int, int]]] = {}
        for end, (n, own) in self.machine.iter(text):
            for k, at in own:
                start = end - n + 1 - at
                limit = self.limits[k]
                a, b = max(0, start - limit), start + len(self.items[k][1]) + limit
                held = windows.setdefault(k, [])
                # hits come in the order of their ends, so most windows overlap the one before: a frequent piece takes no list
                if held and a <= held[-1][1] and b >= held[-1][0]:
                    held[-1] = (min(a, held[-1][0]), max(b, held[-1][1]))
                else:
                    held.append((a, b))
        out = []
        for k, spans in windows.items():
            spans.sort()
            item, limit, best, at = self.items[k][1], self.limits[k], None, 0
            while at < len(spans):
                a, b = spans[at]
                at += 1
                while at < len(spans) and spans[at][0] <= b:
                    b = max(b, spans[at][1])
                    at += 1
                if item in text[a:b]:
                    got = (0, text.index(item, a) + len(item))
                else:
                    got = myers(item, text[a:b], limit)
                    got = got and (got[0], a + got[1])
                if got and (best is None or got < best):
                    best = got
                if best and not best[0]:
                    break
            if best:
                out.append((k, *best))
        return out


def _blocks(spark: SparkSession, items: DataFrame) -> list:
    """Reads of the items with texts in blocks of near ITEM_BYTES each, by a hash of the text; one empty block if there are none.

    The items are written once to the shared folder; the driver holds one block at a time, and each is sent to the tasks.
    """
    rows = items.select("item_id", "text").where("length(trim(text)) > 0")
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-size // ITEM_BYTES))
    if n == 1:
        return [_sent(spark, rows)]
    written = materialise(spark, rows.withColumn("block", F.pmod(F.xxhash64("text"), F.lit(n)).cast("int")).repartition("block"), "items")
    return [_sent(spark, written.where(F.col("block") == k)) for k in range(n)]


def _sent(spark: SparkSession, rows: DataFrame):
    """A broadcast of one block's normalised items, which the driver doesn't keep."""
    block = sorted(((r["item_id"], t) for r in rows.collect() if (t := normal(r["text"]))), key=str)
    sent = spark.sparkContext.broadcast(block)
    sent.__dict__.pop("_value", None)
    return sent


def contaminated(spark: SparkSession, docs: DataFrame, items: DataFrame, rate: float = 0.05, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(doc_id, item_id, distance, end_char): each row that holds an item within floor(rate * length) edits.

    distance is the least one, end_char the end of the first such passage in the normalised text. Null and empty items match
    nothing, and null and empty texts hold nothing. Items with equal texts match alike; repeated rows repeat their results.
    A null id stays null; other columns are ignored, whatever their names; empty tables give an empty one.
    The items are a query set; they are taken in blocks of ITEM_BYTES, each against all rows.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    blocks = _blocks(spark, items.select(F.col(item_id_col).cast("long").alias("item_id"), F.col(item_text_col).alias("text")))
    schema = "doc_id long, item_id long, distance int, end_char long"
    out = None
    for b in blocks:

        @tidy
        def run(batches: Iterator[pa.RecordBatch], b=b) -> Iterator[pa.RecordBatch]:
            m = Matcher(b.value, rate)
            for batch in batches:
                found = [(i, item, *hit[1:]) for i, t in enumerate(batch.column(1)) for hit in m.find(normal(t.as_py())) for item in m.items[hit[0]][0]]
                columns = [batch.column(0).take(pa.array([f[0] for f in found], pa.int64())), pa.array([f[1] for f in found], pa.int64()), pa.array([f[2] for f in found], pa.int32()), pa.array([f[3] for f in found], pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "item_id", "distance", "end_char"])

        part = docs.mapInArrow(run, schema)
        out = part if out is None else out.unionByName(part)
    return out


def drop_contaminated(spark: SparkSession, docs: DataFrame, items: DataFrame, rate: float = 0.05) -> DataFrame:
    """docs without the rows that hold an item; rows with null ids are judged by their texts as well."""
    at = docs.columns.index("text")
    schema = docs.schema
    for block in _blocks(spark, items):

        @tidy
        def run(batches: Iterator[pa.RecordBatch], block=block) -> Iterator[pa.RecordBatch]:
            m = Matcher(block.value, rate)
            for batch in batches:
                yield batch.filter(pa.array([not m.find(normal(t.as_py())) for t in batch.column(at)], pa.bool_()))

        docs = docs.mapInArrow(run, schema)
    return docs
