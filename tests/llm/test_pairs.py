"""Jaccard join, line dedup, decontamination and license scans against brute force."""

from __future__ import annotations

import os
import random
import re

import pyarrow as pa
import pytest

from stratalake.llm import common, components, decontaminate, entry, license_scan, line_dedup, ngram_jaccard
from tests_llm_brute import brute_components, brute_distance, brute_licenses, brute_lines

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, n long, component string, mark string"


def frame(spark, rows):
    """Documents with extra columns whose names clash with the operators' own."""
    return spark.createDataFrame([(i, t, 7, "c", "m") for i, t in rows], SCHEMA)


def near_copies():
    rng = random.Random(5)
    words = [f"w{k}" for k in range(400)]
    base = [rng.choice(words) for _ in range(120)]
    rows = [(1000 + k, " ".join(rng.choice(words) for _ in range(rng.randint(1, 60)))) for k in range(60)]
    for k in range(80):
        t = list(base)
        for _ in range(rng.randint(0, 6)):
            t[rng.randrange(len(t))] = rng.choice(words)
        if k % 3 == 0:
            t = t[: rng.randint(90, 120)]
        rows.append((k, " ".join(t)))
    rows += [(500 + k, "One two\tTHREE  four five") for k in range(5)] + [(500, "one two three four five")]
    rows += [(700, "a b"), (701, "A  b"), (702, "b a"), (703, "é É"), (704, None), (705, ""), (706, " \n "), (None, "a b"), (None, None), (700, "a b"), (700, "a b")]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize(("size", "percent"), [(4, 85), (5, 80), (3, 50)])
def test_components_by_brute_force(spark, size, percent):
    rows = near_copies()
    got = ngram_jaccard.jaccard_components(spark, frame(spark, rows), size=size, percent=percent).collect()
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id), r.n_links) for r in got) == brute_components(rows, size, percent)


def test_blocks_lose_no_link(spark, monkeypatch):
    rows = near_copies()
    monkeypatch.setattr(ngram_jaccard, "BLOCK", 7)
    monkeypatch.setattr(ngram_jaccard, "SHORT", 3)
    got = ngram_jaccard.jaccard_components(spark, frame(spark, rows)).collect()
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id), r.n_links) for r in got) == brute_components(rows, 4, 85)


def test_components_of_repeated_ids(spark):
    """Rows of one id and different texts are rows of different sets."""
    rng = random.Random(8)
    base = [" ".join(rng.choice("abcdefghij") + str(rng.randrange(90)) for _ in range(120)) for _ in range(3)]
    a, b, c = base
    for rows in (
        [(1, b), (1, a), (2, b + " x"), (4, a + " y")],
        [(1, a), (1, b), (2, b + " x")],
        [(1, a), (1, b), (2, b + " x"), (3, c), (0, a + " z"), (0, c + " z")],
    ):
        got = ngram_jaccard.jaccard_components(spark, frame(spark, rows)).collect()
        assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id), r.n_links) for r in got) == brute_components(rows, 4, 85)


def test_hot_keys_lose_no_link(spark, monkeypatch):
    rows = near_copies()
    monkeypatch.setattr(common, "HOT_ROWS", 3)
    monkeypatch.setattr(ngram_jaccard, "BLOCK_SHINGLES", 900)
    monkeypatch.setattr(ngram_jaccard, "HELD", 64)
    got = ngram_jaccard.jaccard_components(spark, frame(spark, rows)).collect()
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id), r.n_links) for r in got) == brute_components(rows, 4, 85)


def test_levels_of_taken_slots(spark, monkeypatch):
    """What one text alone has is known where every slot of levels is taken, and tables that are read no more are given back."""
    rng = random.Random(9)
    rows = near_copies() + [(2000 + k, " ".join(f"v{rng.randrange(10**6)}" for _ in range(300))) for k in range(40)]
    rows += [(3000 + k, t) for k, (_, t) in enumerate(rows[-20:])]
    monkeypatch.setattr(ngram_jaccard, "SLOT_BITS", ngram_jaccard.PART_BITS)
    docs = frame(spark, rows)
    tables = ngram_jaccard._levels(spark, docs, 4)
    assert (tables[0] > 0).mean() > 0.9
    texts = dict(rows)
    _, (alone, copied) = next(ngram_jaccard._sets(pa.array([texts[2000], texts[500]]), 4))
    assert (ngram_jaccard._level(tables, alone) == 0).mean() > 0.99 and (ngram_jaccard._level(tables, copied) > 0).all()
    folder = spark.conf.get("spark.checkpoint.dir").removeprefix("file://")
    before = set(os.listdir(folder))
    got = ngram_jaccard.jaccard_components(spark, docs).collect()
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id), r.n_links) for r in got) == brute_components(rows, 4, 85)
    left = {name.rsplit("-", 1)[0] for name in set(os.listdir(folder)) - before}
    assert "named" in left and not left & {"whole-sig", "numbered", "prefixes", "shared", "members"}


def test_one_worker_a_core(spark, monkeypatch):
    """No stage runs a Python function on another's rows: each would hold a worker of its own in every core."""
    plans, connected = [], ngram_jaccard.connected_components

    def seen(spark, edges):
        plans.append(edges._jdf.queryExecution().executedPlan().toString())
        return connected(spark, edges)

    monkeypatch.setattr(ngram_jaccard, "connected_components", seen)
    ngram_jaccard.jaccard_components(spark, frame(spark, near_copies())).collect()
    assert len(plans) == 2 and not any("MapInArrow" in p for p in plans)


def test_components_of_whole_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = entry.op2_ngram_jaccard(spark, SF).collect()
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id), r.n_links) for r in got) == brute_components(rows, 4, 85)


def test_jaccard_of_nothing(spark):
    assert ngram_jaccard.jaccard_components(spark, frame(spark, [])).count() == 0
    kept = ngram_jaccard.keep_one_per_component(spark, frame(spark, [(1, "a b c d e f"), (2, "a b c d e f"), (3, None), (None, "a b c d e f")]))
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["1", "3", "None"]
    assert kept.columns == ["doc_id", "text", "n", "component", "mark"]


def test_connected_components(spark):
    e = spark.createDataFrame([(k, k + 1) for k in range(40)] + [(100, 99), (100, 100)], "u long, v long")
    got = {r.node: r.component for r in components.connected_components(spark, e).collect()}
    assert got == {**{k: 0 for k in range(41)}, 99: 99, 100: 99}


def test_lines_by_brute_force(spark):
    rng = random.Random(2)
    pool = ["a b c", "one two three four five six seven eight nine ten eleven", "x", "y z", "", "  ", "long line of some six words"]
    rows = [(k, "\n".join(rng.choice(pool) + (f" {k}" if rng.random() < 0.3 else "") for _ in range(rng.randint(0, 12)))) for k in range(60)]
    rows += [(100, "x\n" * 40), (101, None), (102, ""), (None, "a b c\nx\ny z\na b c\nx\ny z"), (59, rows[59][1]), (59, rows[59][1])]
    for words in (10, 4, 1):
        got = line_dedup.dedup_lines(spark, frame(spark, rows), words).collect()
        assert sorted((str(r.doc_id), str(r.text), r.n_lines, r.n_deleted) for r in got) == brute_lines(rows, words)
        assert got[0].mark == "m"
    assert line_dedup.dedup_lines(spark, frame(spark, [])).count() == 0


def test_whole_runs_go(spark, monkeypatch):
    """Short last lines of a repeated run, indented lines and lines of a hot key."""
    monkeypatch.setattr(common, "HOT_ROWS", 2)
    long = " ".join(f"w{k}" for k in range(30))
    rows = [(1, f"{long}\nshort one\nend"), (2, f"other\n{long}\nshort one\nend"), (3, f"{long}\nshort one\nend\nmore"), (4, "          x\n          y"), (5, "          x\n          y"), (6, "a\tb\tc\td\te\tf\tg\th\ti\tj"), (7, "a\tb\tc\td\te\tf\tg\th\ti\tj\n\t")]
    got = {r.doc_id: (r.text, r.n_deleted, r.n_left) for r in line_dedup.dedup_lines(spark, frame(spark, rows)).collect()}
    assert sorted((str(i), t, n) for i, (t, n, _) in got.items()) == sorted((i, t, n) for i, t, _, n in brute_lines(rows, 10))
    assert got[2][:2] == ("other", 3) and got[3][:2] == ("more", 3) and got[5][1] == 0 and got[7] == ("\t", 1, 0)


def test_decontamination_by_brute_force(spark):
    rng = random.Random(9)
    letters = "abcdefg "
    items = [(k, "".join(rng.choice(letters) for _ in range(rng.randint(15, 70)))) for k in range(12)] + [(50, None), (51, "  "), (52, "tiny")]
    rows = []
    for k in range(80):
        t = "".join(rng.choice(letters) for _ in range(rng.randint(0, 150)))
        if k % 2:
            x = list(items[rng.randrange(12)][1])
            for _ in range(rng.randint(0, 6)):
                p = rng.randrange(len(x))
                x[p : p + 1] = rng.choice(["", "z", x[p] + "q"])
            at = rng.randint(0, len(t))
            t = t[:at] + "".join(x).upper() + t[at:]
        rows.append((k, t.replace(" ", rng.choice([" ", "\n "]))))
    rows += [(200, None), (201, ""), (None, items[0][1]), (3, rows[3][1])]
    rate = 0.08
    bench = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, distance int")
    got = decontaminate.contaminated(spark, frame(spark, rows), bench, rate).collect()
    want = []
    for i, t in rows:
        for j, x in items:
            a, b = decontaminate.normal(x), decontaminate.normal(t)
            if a and b and (d := brute_distance(a, b)) <= int(rate * len(a)):
                want.append((str(i), j, d))
    assert sorted((str(r.doc_id), r.item_id, r.distance) for r in got) == sorted(want) and want
    hit = {i for i, _, _ in want}
    kept = decontaminate.drop_contaminated(spark, frame(spark, rows), bench, rate).collect()
    assert sorted(str(r.doc_id) for r in kept) == sorted(str(i) for i, _ in rows if str(i) not in hit)
    assert decontaminate.contaminated(spark, frame(spark, []), bench).count() == 0
    assert decontaminate.contaminated(spark, frame(spark, rows), bench.where("item_id > 900")).count() == 0


def test_items_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "ITEM_BYTES", 30)
    items = spark.createDataFrame([(k, f"item number {k} of the list") for k in range(5)], "item_id long, text string")
    docs = spark.createDataFrame([(k, f"so here is Item  number {k} of the list, again") for k in range(5)], "doc_id long, text string")
    assert sorted((r.doc_id, r.item_id) for r in decontaminate.contaminated(spark, docs, items, 0.0).collect()) == [(k, k) for k in range(5)]
    assert decontaminate.drop_contaminated(spark, docs, items, 0.0).count() == 0


def test_myers():
    rng = random.Random(4)
    for _ in range(300):
        a, b = ("".join(rng.choice("abc") for _ in range(rng.randint(1, n))) for n in (90, 60))
        got = decontaminate.myers(a, b, 1000)
        assert got and got[0] == brute_distance(a, b)


WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute_license(text):
    w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    starts, labels = [], set()
    for t in license_scan.BASE:
        p = t.text.split()
        for k in range(len(w) - len(p) + 1):
            if w[k : k + len(p)] == p:
                starts.append(k)
                labels.add(t.label)
    return len(w), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(labels))


def test_licenses_by_brute_force(spark):
    rng = random.Random(8)
    vocabulary = ["cc", "by", "CC", "general", "Public", "license", "all", "rights", "reserved", "é", "x1", "all-rights", "cc_by"]
    rows = [(k, rng.choice([" ", ", ", "-\n"]).join(rng.choice(vocabulary) for _ in range(rng.randint(0, 30)))) for k in range(150)]
    rows += [(400, None), (401, ""), (402, "cc"), (None, "CC BY"), (7, rows[7][1]), (7, "cc by"), (403, "cc by " * 500)]
    mit = license_scan.NOTICES[0].text
    rows += [(500, "intro " + mit + " end"), (501, mit.replace("free of charge", "free of any charge")), (502, " ".join(mit.split()[:12]))]
    got = license_scan.license_scan(spark, frame(spark, rows)).collect()
    key = lambda r: str(r)
    assert sorted(((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in got), key=key) == sorted(((i, *brute_license(t)) for i, t in rows), key=key)
    by = {r.doc_id: r for r in got}
    assert "mit" in by[500].labels and "mit" in by[501].labels and "mit" not in by[502].labels
    assert by[500].score == 1.0 and 0.7 <= by[501].score < 1 and by[400].score == 0.0 and by[400].labels == ""
    for r in got:
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) or not r.base_labels
    assert license_scan.license_scan(spark, frame(spark, [])).count() == 0


def test_word_hashes_in_portions(monkeypatch):
    import numpy as np

    from stratalake.llm import common

    rng = random.Random(6)
    texts = ["".join(rng.choice("ab \n") for _ in range(rng.randint(0, 50))) for _ in range(40)] + ["x" * 500, "", "a " * 100]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    inside = common.word_mask(common.WHITE_SPACE)
    whole, counts = common.hash_words(data, offsets, inside)
    assert np.diff(counts).tolist() == [len(t.split()) for t in texts]
    assert len(set(whole.tolist())) == len({w for t in texts for w in t.split()})
    for portion in (1, 3, 16, 64):
        monkeypatch.setattr(common, "PORTION", portion)
        again, c = common.hash_words(data, offsets, inside)
        assert (again == whole).all() and (c == counts).all()


@pytest.mark.parametrize("most", [0, 3, 40])
def test_components_beyond_one_task(spark, monkeypatch, most):
    monkeypatch.setattr(components, "TASK_EDGES", most)
    rng = random.Random(most)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(k, k + 1) for k in range(1000, 1040)]
    least = {x: x for e in edges for x in e}
    changed = True
    while changed:
        changed = False
        for u, v in edges:
            m = min(least[u], least[v])
            changed |= least[u] != m or least[v] != m
            least[u] = least[v] = m
    alone = {x for x in least if all(x not in e or e[0] == e[1] for e in edges)}
    got = components.connected_components(spark, spark.createDataFrame(edges, "u long, v long").repartition(5))
    assert {r.node: r.component for r in got.collect()} == {x: c for x, c in least.items() if x not in alone}


def test_labels_by_brute_force(spark):
    rng = random.Random(4)
    templates = license_scan.BASE + license_scan.NOTICES
    rows = []
    for k in range(120):
        parts = []
        for _ in range(rng.randint(0, 4)):
            w = rng.choice(templates).text.split()
            a = rng.randint(0, len(w) // 3)
            w = w[a : rng.randint(a, len(w))] if rng.random() < 0.5 else w
            for _ in range(rng.randint(0, 3)):
                at = rng.randrange(len(w) + 1)
                w = w[:at] + [rng.choice(["uh", "the", "of"])] + w[at + rng.randint(0, 1) :]
            parts += w + ["x"] * rng.randint(0, 6)
        rows.append((k, " ".join(parts)))
    rows += [(500, None), (501, ""), (None, "CC-BY and cc by"), (502, "general public " * 30 + "license")]
    got = {str(r.doc_id): (r.labels, r.score) for r in license_scan.license_scan(spark, frame(spark, rows), templates).collect()}
    assert got == {str(i): brute_licenses(t, templates, 3, 0.7) for i, t in rows}
