"""The stages on the smallest tables, each against a plain version of what it should keep."""

from __future__ import annotations

import corpus_pipeline
from stratalake.llm import decontaminate
from tests_llm_brute import brute_components, brute_lines, brute_distance

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").cache()
    names = docs.columns
    before = docs
    for name, stage in corpus_pipeline.STAGES:
        after = stage(spark, before, SF).cache()
        a, b = before.collect(), after.collect()
        if name != "bpe":
            assert after.columns == names
        if name == "language_id":
            assert {r.doc_id for r in b} == {r.doc_id for r in a if any(c.isalpha() for c in r.text or "")}
        elif name == "line_dedup":
            lines = {i: (t, gone) for i, t, _, gone in brute_lines([(r.doc_id, r.text) for r in a], 10)}
            want = {i: t for i, (t, gone) in lines.items() if not gone or t.strip(" \n")}
            assert {str(r.doc_id): r.text for r in b} == want and all(r.n_chars == len(r.text) for r in b)
        elif name == "ngram_jaccard":
            first = {i for i, n, c, _ in brute_components([(r.doc_id, r.text) for r in a], 5, 80) if i == c or not n}
            assert {str(r.doc_id) for r in b} == first
        elif name == "decontaminate":
            items = [decontaminate.normal(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
            clean = set()
            for r in a:
                t = decontaminate.normal(r.text)
                # a passage within budget holds a piece; only then the whole table of distances is worked out
                near = [x for x in items if any(p in t for _, p in decontaminate.pieces(x, 0.05))]
                if not any(brute_distance(x, t) <= int(0.05 * len(x)) for x in near):
                    clean.add(r.doc_id)
            assert {r.doc_id for r in b} == clean and len(clean) < len(a)
        else:
            assert [r.decoded == r.text and r.n_tokens == len(r.token_ids) for r in b] == [True] * len(a)
        before = after


def test_run_is_the_stages_in_a_row(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
    key = lambda d: sorted((r.doc_id, r.n_tokens) for r in d.collect())
    assert key(corpus_pipeline.run(spark, SF)) == key(docs)
