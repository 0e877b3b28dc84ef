"""What language ID learns from and what it lets go."""

from __future__ import annotations

from stratalake.llm import langid_ecoc

SF = "/root/testdata/sf0.01"
FOREIGN = [
    "Все люди рождаются свободными и равными в своем достоинстве и правах.",
    "人人生而自由，在尊严和权利上一律平等。他们赋有理性和良心。",
    "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw.",
    "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan.",
]


def test_texts_of_no_learned_language_go(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang")
    foreign = spark.createDataFrame([(-1 - k, t, None) for k, t in enumerate(FOREIGN + [t * 300 for t in FOREIGN])], docs.schema)
    clean = {r.doc_id for r in docs.collect() if any(c.isalpha() for c in r.text or "")}
    kept = {r.doc_id for r in langid_ecoc.keep_languages(spark, docs.unionByName(foreign)).collect()}
    assert kept == clean


def test_likeness_of_unseen_rows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang").where("text IS NOT NULL")
    held = langid_ecoc.held_out("doc_id", 3, 1)
    rows = langid_ecoc.classify(spark, docs.where(held), langid_ecoc.fit(spark, docs.where(~held))).collect()
    assert len(rows) > 200 and all(r.likeness >= 0 for r in rows if any(c.isalpha() for c in r.text))


def test_fit_reads_whole_texts(spark):
    same = "aba cac " * 6_000
    rows = [(f"{same}{x} {k}", lang) for k in range(20) for x, lang in (("kuk kuku " * 6_000, "k"), ("zoz zozo " * 6_000, "z"))]
    model = langid_ecoc.fit(spark, spark.createDataFrame(rows, "text string, lang string"))
    odd = spark.createDataFrame([("kuk kuku kuk",), ("zoz zozo zoz",)], "text string")
    assert {r.text[0]: r.lang_pred for r in langid_ecoc.classify(spark, odd, model).collect()} == {"k": "k", "z": "z"}


def test_fit_gives_heap_back_first(spark, monkeypatch):
    """The driver's JVM has collected its garbage when Python comes to the dense table."""
    beans = spark._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans
    full = lambda: sum(b.getCollectionCount() for b in beans() if "Old" in b.getName() or "MarkSweep" in b.getName())
    seen, weights = [], langid_ecoc._weights
    monkeypatch.setattr(langid_ecoc, "_weights", lambda *a: (seen.append(full()), weights(*a))[1])
    rows = spark.createDataFrame([(f"{x} {x}{k}", x[0]) for k in range(8) for x in ("kuk", "zoz")], "text string, lang string").collect()
    before = full()
    langid_ecoc.fit(spark, spark.createDataFrame(rows, "text string, lang string"), rounds=2)
    assert seen and seen[0] > before
