"""A corpus pipeline of five stages; each works on all rows that the stage before it kept.

Languages that can't be told go; later copies of repeated line runs are cut, and texts that were nothing else go; one
document of each group of near copies stays; documents that hold a benchmark item go; the rest is encoded and decoded.
Every stage's rows are written as Parquet to the shared folder and read again by the next one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalake.llm.bpe import bpe_columns
from stratalake.llm.common import materialise
from stratalake.llm.decontaminate import drop_contaminated
from stratalake.llm.entry import byte_bpe
from stratalake.llm.langid_ecoc import keep_languages
from stratalake.llm.line_dedup import dedup_lines
from stratalake.llm.ngram_jaccard import keep_one_per_component


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, and those of no learned language, go."""
    return keep_languages(spark, docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of line runs go; so do texts of which nothing but blank lines is left. n_chars follows the text."""
    found = dedup_lines(spark, docs).where("n_deleted = 0 OR n_left > 0")
    return found.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five words, 0.8) stays: the one of the least doc_id."""
    return keep_one_per_component(spark, docs, size=5, percent=80)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item within its error budget go."""
    return drop_contaminated(spark, docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """documents' columns with token_ids, n_tokens and the decoded text."""
    return bpe_columns(docs, byte_bpe())


STAGES = [("language_id", language_id), ("line_dedup", line_dedup), ("ngram_jaccard", near_duplicates), ("decontaminate", decontaminate), ("bpe", bpe)]

#: SQL can't express the learned, edit-distance and token stages; tests/llm holds each against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of documents that all stages kept, with their tokens."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = materialise(spark, docs, f"stage-{name}")
    return docs
