"""The registered queries of this subpackage: thin calls of the operators over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_media_jpeg(spark: SparkSession, sf_dir: str) -> DataFrame:
    from stratalake.llm.media_jpeg import media_column, media_digest

    return media_digest(media_column(_table(spark, sf_dir, "documents")))


def op2_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from stratalake.llm.ngram_jaccard import jaccard_components

    return jaccard_components(spark, _table(spark, sf_dir, "documents"), size=4, percent=85)


def byte_bpe() -> str:
    """Where the shared vocabulary lies; a parameter of the operators, never copied."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from stratalake.llm.bpe import bpe_digest

    return bpe_digest(_table(spark, sf_dir, "documents"), byte_bpe())


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from stratalake.llm.decontaminate import contaminated

    return contaminated(spark, _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), rate=0.05)


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from stratalake.llm.langid_ecoc import classify, fit, held_out

    docs = _table(spark, sf_dir, "documents")
    model = fit(spark, docs.where(~held_out("doc_id", 3, 1)))
    return classify(spark, docs.withColumn("held_out", held_out("doc_id", 3, 1)), model).select("doc_id", "held_out", "lang_pred", "score", "ambiguous")


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from stratalake.llm.license_scan import license_scan

    return license_scan(spark, _table(spark, sf_dir, "documents"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from stratalake.llm.token_counts import token_counts

    return token_counts(spark, _table(spark, sf_dir, "documents"), byte_bpe())


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from stratalake.llm.langid_ecoc import held_out
    from stratalake.llm.quality_rff import quality

    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    return quality(spark, docs, labels, held_out("doc_id", 5, 0)).select("doc_id", "held_out", "score", "predicted")


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from stratalake.llm.line_dedup import dedup_lines

    return dedup_lines(spark, _table(spark, sf_dir, "documents")).select("doc_id", "text", "n_lines", "n_deleted", "n_left")


def op8_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    from stratalake.llm.html_extract import extract_text

    return extract_text(spark, _table(spark, sf_dir, "pages"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and name[2:3].isdigit()}


def oracle_sql() -> dict[str, str]:
    from stratalake.llm import line_dedup

    return {"op3_line_dedup": line_dedup.SQL}
