"""Token counts of flat token files by a separator scan.

A flat file is nothing but unsigned 16-bit little-endian token ids; every document ends with the end-of-document id, and there is
no index. Files are cut into blocks of a fixed size; each block is searched for the separator by one vectorised comparison,
which gives the lengths of the documents that lie inside, the tokens before the first separator and those after the last one.
A prefix scan over the blocks of a file stitches what runs across their boundaries. A document that a file's end cuts off
(no separator) counts as the last one.
"""

from __future__ import annotations

import functools
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stratalake.llm.bpe import Encoder, encoder
from stratalake.llm.common import shared_dir, tidy

BLOCK_TOKENS = 1 << 20
#: Bytes of documents that a row of the writer holds, and such rows to a file: a file is near 32 MB, more only by one document.
RECORD_BYTES, RECORDS_PER_FILE = 4 << 20, 8
#: Entries, and bytes of ids, of each generation of the writer's table of pieces: larger than the encoder's own, as pieces that come
#: back after they were dropped are costly to make again. Just under the entries at which a dict doubles its slots.
GENERATION, ROOM = 349_000, 11 << 20
#: Ids at the front of each document that spell its doc_id, least digit first, in the base of the separator.
ID_DIGITS = 5


def id_digits(doc_id: int, end: int) -> list[int]:
    """A 64-bit id, raised to be unsigned, as ID_DIGITS token ids, none of them the separator."""
    n, out = doc_id + (1 << 63), []
    for _ in range(ID_DIGITS):
        n, r = divmod(n, end)
        out.append(r)
    return out


def writer_encoder(vocabulary: str) -> Encoder:
    """The encoder of a worker that writes flat files."""
    return encoder(vocabulary, GENERATION, ROOM)


def write_token_files(spark: SparkSession, docs: DataFrame, vocabulary: str, end: int, id_col: str = "doc_id", text_col: str = "text", records_per_file: int = RECORDS_PER_FILE, record_bytes: int = RECORD_BYTES) -> str:
    """Encode whole texts (null: empty) into flat files under the shared folder and return their folder.

    Each document is ID_DIGITS ids for its doc_id (null: the least long), its tokens, and the separator. A token that is
    itself the separator (its string stands in the text) is written as the ordinary tokens of that string. Files are bounded
    in bytes, and only a single longer document makes a longer one. A vocabulary of more than 16 bits is refused.
    """
    if len(encoder(vocabulary).offsets) > 1 << 16 or not 0 < end < 1 << 16:
        raise ValueError("flat files hold 16-bit token ids; this vocabulary or separator has greater ones")
    mark = np.array([end], "<u2").tobytes()

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = writer_encoder(vocabulary)
        plain = functools.lru_cache(8)(lambda s: np.frombuffer(b"".join(np.array(e.piece(p.encode()), "<u4").tobytes() for p in e.pieces.findall(s)), "<u4"))
        names = {i: s for s, i in e.special.items()}
        held, size = [], 0
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = np.frombuffer(e.encode(text.as_py() or ""), "<u4")
                if (ids == end).any():
                    ids = np.concatenate([plain(names[int(i)]) if i == end else np.array([i], "<u4") for i in ids])
                digits = id_digits(-(1 << 63) if doc_id is None else doc_id, end)
                held.append(np.concatenate([np.array(digits, "<u2"), ids.astype("<u2")]).tobytes())
                size += len(held[-1])
                if size >= record_bytes:
                    yield pa.RecordBatch.from_arrays([pa.array([mark.join(held)], pa.binary())], names=["value"])
                    held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([mark.join(held)], pa.binary())], names=["value"])

    path = f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    flat = docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(run, "value binary").select(F.col("value").cast("string").alias("value"))
    # the text writer puts bytes down as they are, each row followed by the separator's two bytes
    separator = int(end).to_bytes(2, "little").decode("latin-1")
    flat.write.option("lineSep", separator).option("encoding", "ISO-8859-1").option("maxRecordsPerFile", records_per_file).text(path)
    return path


def scan_token_files(spark: SparkSession, path: str, end: int, block_tokens: int = BLOCK_TOKENS, prefix: int = 0) -> DataFrame:
    """(file, ordinal, start, n_tokens, head) for each document of the flat files under a folder.

    ordinal counts a file's documents from 0, start is the place of its first token after the prefix, n_tokens counts its
    tokens without prefix and separator, and head holds the first prefix tokens. Empty files have no documents; two
    separators in a row are an empty document. A file with an odd last byte loses that byte. Works on any number of files;
    one file may have less than 2 GB, as a task takes it as a whole before it is cut (Spark refuses greater ones by an error).
    """
    files = spark.read.format("binaryFile").load(path).where("length > 1").select(F.col("path").alias("file"), "content", F.expr("CAST(length DIV 2 AS BIGINT)").alias("n"))
    block = F.explode(F.sequence(F.lit(0), F.expr(f"CAST((n - 1) DIV {block_tokens} AS INT)"))).alias("block")
    # a block carries the first prefix tokens of the next one, for heads that run across the boundary
    cut = files.select("file", "content", "n", block).select("file", "n", "block", F.substring("content", F.col("block") * (2 * block_tokens) + 1, F.lit(2 * (block_tokens + prefix))).alias("data"))

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            first, last, docs, heads = [], [], [], []
            for data, n, k in zip(batch.column(3), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                t = np.frombuffer(data.as_buffer(), "<u2", len(data.as_buffer()) // 2)
                own = min(block_tokens, n - k * block_tokens)
                at = np.flatnonzero(t[:own] == end) + k * block_tokens
                first.append(int(at[0]) if len(at) else None)
                last.append(int(at[-1]) if len(at) else None)
                docs.append(at)
                # heads of the documents that begin here: after each separator, and at the file's start
                begin = np.concatenate([[0] if k == 0 else [], at - k * block_tokens + 1]).astype(np.int64)
                padded = np.concatenate([t, np.zeros(prefix + 1, t.dtype)])
                heads.append(padded[begin[:, None] + np.arange(prefix)].astype(np.int32).reshape(-1) if prefix else np.zeros(0, np.int32))
            lists = lambda xs, t: pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum([len(x) for x in xs])]).astype(np.int32), pa.array(np.concatenate([*xs, np.zeros(0, xs[0].dtype if xs else np.int64)]), t))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(last, pa.int64()), lists(docs, pa.int64()), lists(heads, pa.int32())], names=["file", "n", "block", "last", "ends", "heads"])

    scanned = cut.mapInArrow(run, "file string, n long, block int, last long, ends array<long>, heads array<int>")
    order = Window.partitionBy("file").orderBy("block")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    stitched = scanned.select(
        "*",
        F.coalesce(F.last("last", ignorenulls=True).over(before), F.lit(-1)).alias("carry"),
        F.coalesce(F.sum(F.size("ends")).over(before), F.lit(0)).alias("seen"),
        F.coalesce(F.last(F.when(F.size("heads") > 0, F.slice("heads", -prefix, prefix)), ignorenulls=True).over(before), F.array().cast("array<int>")).alias("open") if prefix else F.array().cast("array<int>").alias("open"),
        F.lead("block").over(order).isNull().alias("final"),
    )
    # begins: the open document, then one after each separator; each ends at a separator or, the last, with the file
    begins = F.concat(F.array(F.col("carry") + 1), F.transform("ends", lambda e: e + 1))
    ends = F.when(F.col("final") & (F.element_at(begins, -1) < F.col("n")), F.concat("ends", F.array("n"))).otherwise(F.col("ends"))
    heads = F.when(F.col("block") == 0, F.col("heads")).otherwise(F.concat("open", "heads")) if prefix else F.col("open")
    docs = stitched.withColumns({"begins": begins, "stops": ends, "all_heads": heads})
    docs = docs.select("file", "seen", "begins", "all_heads", F.posexplode("stops").alias("k", "stop"))
    start = F.col("begins")[F.col("k")]
    head = F.slice("all_heads", F.col("k") * prefix + 1, prefix) if prefix else F.array().cast("array<int>")
    return docs.select("file", (F.col("seen") + F.col("k")).cast("long").alias("ordinal"), (start + prefix).alias("start"), (F.col("stop") - start - prefix).alias("n_tokens"), head.alias("head"))


def id_of(head: Column, end: int) -> Column:
    """The id that a head spells; null for the least long."""
    # in decimals: the digits' sum passes the range of long before the offset is taken off
    value = F.aggregate(F.reverse(head), F.lit(0).cast("decimal(38,0)"), lambda s, d: (s * end + d).cast("decimal(38,0)"))
    signed = value - F.lit(str(1 << 63)).cast("decimal(38,0)")
    return F.when(value > 0, signed.cast("long"))


def token_counts(spark: SparkSession, docs: DataFrame, vocabulary: str, end: int = 50256, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """doc_id and n_tokens for each row: its text's tokens as counted in the flat files that hold the corpus.

    Null and empty texts have 0 tokens. Repeated rows are counted each; null ids come back as null. Other columns are
    ignored, whatever their names; an empty table gives an empty one.
    """
    path = write_token_files(spark, docs, vocabulary, end)
    found = scan_token_files(spark, path, end, block_tokens, ID_DIGITS)
    return found.select(id_of(F.col("head"), end).alias("doc_id"), "n_tokens")
