"""Shared helpers: materialised tables, Arrow text access and vectorised word hashing.

Nothing here keeps state between calls; the numpy parts work on one Arrow batch at a time.
"""

from __future__ import annotations

import contextlib
import ctypes
import functools
import gc
import posixpath
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WHITE_SPACE = bytes([0x20, *range(0x09, 0x0E)])


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or one of our own where it is unset."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = "file://" + tempfile.mkdtemp(prefix="stratalake-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def materialise(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back: cuts lineage and survives lost executors."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, *tables: DataFrame) -> None:
    """Give back the disk of what is over: materialised tables that no plan will read again, and shuffles that none refers to.

    Spark removes shuffle files only after the driver has collected its garbage, which by itself it may not do during a whole query.
    """
    for table in tables:
        folder = spark._jvm.org.apache.hadoop.fs.Path(posixpath.dirname(table.inputFiles()[0]))
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
    gc.collect()
    spark._jvm.System.gc()


#: Rows that a key may bring into one task; keys of more are hot. At most 1 << HOT_BITS keys can be.
HOT_ROWS, HOT_BITS = 1024, 17


def hot_rows(names: DataFrame, count: str) -> int:
    """The number of rows above which a key is hot, from the names' counts: so great that hot keys fit into a broadcast."""
    total = names.agg(F.sum(count)).first()[0] or 0
    return max(HOT_ROWS, int(total) >> HOT_BITS)


def join_counted(rows: DataFrame, names: DataFrame, on: list[str], spread: list[str], count: str, kind: str = "inner") -> DataFrame:
    """rows joined (inner or left) to names, which has each key once, its number of rows and other columns; no task gathers a hot key.

    Hot keys are broadcast (there are at most 1 << HOT_BITS, as each has more than that share of all rows), and their rows are
    dealt by the spread columns in the shuffle of the others. names should be a written table: it is read three times.
    """
    limit = hot_rows(names, count)
    values = [c for c in names.columns if c not in (*on, count)]
    hot = names.where(F.col(count) > limit)
    if hot.isEmpty():
        return rows.join(names.drop(count), on, kind)
    r = rows.join(F.broadcast(hot.select(*on, F.struct(*values).alias("__hot"))), on, "left")
    r = r.withColumn("__salt", F.when(F.col("__hot").isNull(), 0).otherwise(1 + F.pmod(F.xxhash64(*spread), F.lit(1 << 16))))
    cold = names.where(F.col(count) <= limit).select(*on, F.lit(0).cast("long").alias("__salt"), F.struct(*values).alias("__cold"))
    out = r.withColumn("__salt", F.col("__salt").cast("long")).join(cold, [*on, "__salt"], "left").withColumn("__value", F.coalesce("__hot", "__cold"))
    if kind == "inner":
        out = out.where("__value IS NOT NULL")
    return out.select(*rows.columns, *(F.col("__value")[v].alias(v) for v in values))


def release() -> None:
    """Give freed memory back to the system: workers live on between stages, and an idle one should hold nothing."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function of batches that releases memory when its task ends."""

    @functools.wraps(run)
    def done(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            release()

    return done


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column; nulls count as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    if pa.types.is_string(column.type):
        column = column.cast(pa.large_string())
    elif pa.types.is_binary(column.type):
        column = column.cast(pa.large_binary())
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offs, data = column.buffers()
    offsets = np.frombuffer(offs, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def spans(offsets: np.ndarray, budget: int, rows: int = 1 << 30) -> Iterator[tuple[int, int]]:
    """Ranges of at most so many rows whose bytes stay near budget; a longer row stands alone."""
    n, first = len(offsets) - 1, 0
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + budget, "right")) - 1
        last = min(n, first + rows, max(last, first + 1))
        yield first, last
        first = last


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser."""
    x = x.astype(np.uint64, copy=True)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x ^= x >> np.uint64(shift)
        x *= np.uint64(factor)
    x ^= x >> np.uint64(31)
    return x


BYTE_VALUES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
BASE = np.uint64(0xD1342543DE82EF95)
PLACES = mix(np.arange(1001, 1065, dtype=np.uint64)) | np.uint64(1)


def lower_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    return table


LOWER = lower_table()
#: Bytes that word hashing takes at a time, so that a very long text needs no more memory than its own and its words' hashes.
PORTION = 1 << 18


def word_mask(separators: bytes) -> np.ndarray:
    inside = np.ones(256, bool)
    inside[list(separators)] = False
    return inside


def hash_words(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words (A-Z lowered) of consecutive texts, and each text's first word index (n + 1 entries).

    A word is a longest run of bytes for which inside holds; texts don't run into each other.
    """
    n = len(data)
    hashes, starts = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    at = 0
    while at < n:
        end = min(n, at + PORTION)
        if end < n:
            # a portion ends between words, or, where one word fills it, goes on to that word's end
            stops = np.flatnonzero(~inside[data[at:end]])
            while not len(stops) and end < n:
                end = min(n, end + PORTION)
                stops = np.flatnonzero(~inside[data[at:end]])
            end = at + int(stops[-1]) + 1 if len(stops) and end < n else end
        first = np.searchsorted(offsets, at)
        edges = offsets[first : np.searchsorted(offsets, end)] - at
        h, s = _portion(data[at:end], edges, inside)
        hashes.append(h)
        starts.append(s + at)
        at = end
    return np.concatenate(hashes), np.searchsorted(np.concatenate(starts), offsets)


def _portion(data: np.ndarray, edges: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and places of the words of a stretch of bytes in which texts begin at the edges."""
    n = len(data)
    in_word = inside[data]
    begins = in_word.copy()
    begins[1:] &= ~in_word[:-1]
    begins[edges] = in_word[edges]
    starts = np.flatnonzero(begins)
    if not len(starts):
        return np.zeros(0, np.uint64), starts
    place = np.arange(n)
    last = np.zeros(n, np.int64)
    last[starts] = starts
    np.maximum.accumulate(last, out=last)
    place -= last
    place[~in_word] = 0
    powers = np.full(int(place.max()) + 1, BASE, np.uint64)
    powers[0] = 1
    np.multiply.accumulate(powers, out=powers)
    values = BYTE_VALUES[LOWER[data]]
    values *= powers[place]
    values[~in_word] = 0
    return mix(np.add.reduceat(values, starts)), starts


def shingle_hashes(words: np.ndarray, counts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of size words of each text (not distinct), and offsets; a shorter text with words has one, of all its words."""
    per = np.diff(counts)
    many = np.where(per >= size, per - size + 1, (per > 0).astype(np.int64))
    offsets = np.concatenate([[0], np.cumsum(many)])
    first = np.repeat(counts[:-1] - offsets[:-1], many) + np.arange(offsets[-1])
    total = np.zeros(offsets[-1], np.uint64)
    end = np.repeat(counts[1:], many)
    padded = np.concatenate([words, np.zeros(size, np.uint64)])
    for k in range(size):
        at = first + k
        total += np.where(at < end, padded[at] * PLACES[k], np.uint64(0))
    short = np.repeat(np.where(per < size, per, 0), many).astype(np.uint64)
    return mix(total + short * PLACES[63]), offsets
