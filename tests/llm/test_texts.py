"""Media, tokens, languages, pages and quality: round trips, brute force and held-out accuracy."""

from __future__ import annotations

import hashlib
import random
import struct
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from stratalake.llm import bpe, entry, html_extract, langid_ecoc, media_jpeg, quality_rff, token_counts

SF = "/root/testdata/sf0.01"
TEXTS = [None, "", "a", "é" * 40, "x" * 64, "plain words and more of them " * 30, "ÀÁ" * 200, "\x00\x7f\n\t", "漢字🙂" * 50, "<|endoftext|>", "z" * 70_000]


def frame(spark, texts, schema="doc_id long, text string, n_tokens string, score string"):
    rows = [(k, t, "n", "s") for k, t in enumerate(texts)] + [(None, "null id", "n", "s"), (3, texts[3] if len(texts) > 3 else None, "n", "s")]
    return spark.createDataFrame(rows, schema)


# ---- JPEG

def scalar_decode(data: bytes) -> dict[int, list[list[int]]]:
    """A plain decoder of progressive scans, bit by bit: coefficients (zigzag order) of each component's blocks."""
    at, tables, comps, coefs, interval = 2, {}, {}, {}, 0
    while data[at + 1] != 0xD9:
        marker, size = data[at + 1], struct.unpack_from(">H", data, at + 2)[0]
        body = data[at + 4 : at + 2 + size]
        at += 2 + size
        if marker == 0xC2:
            h, w, n = struct.unpack_from(">HHB", body, 1)
            for i in range(n):
                comps[body[6 + 3 * i]] = (body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15)
            hm, vm = max(c[0] for c in comps.values()), max(c[1] for c in comps.values())
            mx, my = -(-w // (8 * hm)), -(-h // (8 * vm))
            coefs = {c: [[0] * 64 for _ in range(mx * my * x * y)] for c, (x, y) in comps.items()}
        elif marker == 0xC4:
            k = 0
            while k < len(body):
                bits, code, t, j = body[k + 1 : k + 17], 0, {}, k + 17
                for n, many in enumerate(bits, 1):
                    for _ in range(many):
                        t[n, code] = body[j]
                        code += 1
                        j += 1
                    code <<= 1
                tables[body[k]] = t
                k = j
        elif marker == 0xDD:
            interval = struct.unpack(">H", body)[0]
        elif marker == 0xDA:
            n = body[0]
            chosen = [(body[1 + 2 * i], body[2 + 2 * i]) for i in range(n)]
            ss, se, a = body[1 + 2 * n : 4 + 2 * n]
            ah, al = a >> 4, a & 15
            segments, held = [], bytearray()
            while True:
                if data[at] == 0xFF and data[at + 1] == 0:
                    held.append(0xFF)
                    at += 2
                elif data[at] == 0xFF and 0xD0 <= data[at + 1] <= 0xD7:
                    segments.append(bytes(held))
                    held = bytearray()
                    at += 2
                elif data[at] == 0xFF:
                    break
                else:
                    held.append(data[at])
                    at += 1
            segments.append(bytes(held))
            order = []
            if n > 1:
                for m in range(mx * my):
                    y, x = divmod(m, mx)
                    order.append([(c, tab, (y * comps[c][1] + v) * mx * comps[c][0] + x * comps[c][0] + u) for c, tab in chosen for v in range(comps[c][1]) for u in range(comps[c][0])])
            else:
                c, tab = chosen[0]
                wide, high, stride = -(-(-(-w * comps[c][0] // hm)) // 8), -(-(-(-h * comps[c][1] // vm)) // 8), mx * comps[c][0]
                order = [[(c, tab, y * stride + x)] for y in range(high) for x in range(wide)]
            for s, seg in enumerate(segments):
                bits = iter("".join(f"{b:08b}" for b in seg))
                get = lambda k: int("".join(next(bits) for _ in range(k)) or "0", 2)  # noqa: E731, B023

                def symbol(t):
                    code = 0
                    for n in range(1, 17):
                        code = code << 1 | get(1)  # noqa: B023
                        if (n, code) in t:
                            return t[n, code]
                    raise ValueError

                extend = lambda v, k: v if not k or v >> k - 1 else v - (1 << k) + 1
                pred, run = {}, 0
                part = order[s * interval : (s + 1) * interval] if interval else order
                for mcu in part:
                    for c, tab, block in mcu:
                        z = coefs[c][block]
                        if ss == 0:
                            if ah:
                                z[0] |= get(1) << al
                            else:
                                k = symbol(tables[tab >> 4])
                                pred[c] = pred.get(c, 0) + extend(get(k), k)
                                z[0] = pred[c] << al
                            continue
                        t, k = tables[0x10 | tab & 15], ss
                        if not ah:
                            if run:
                                run -= 1
                                continue
                            while k <= se:
                                sym = symbol(t)
                                r, size = sym >> 4, sym & 15
                                if size:
                                    k += r
                                    z[k] = extend(get(size), size) * (1 << al)
                                    k += 1
                                elif r == 15:
                                    k += 16
                                else:
                                    run = (1 << r) + get(r) - 1
                                    break
                            continue
                        fix = lambda q: z.__setitem__(q, z[q] + (get(1) and (1 if z[q] > 0 else -1) * (1 << al)))  # noqa: E731, B023
                        if not run:
                            while k <= se:
                                sym = symbol(t)
                                r, size = sym >> 4, sym & 15
                                if not size and r < 15:
                                    run = (1 << r) + get(r)
                                    break
                                value = (1 if get(1) else -1) * (1 << al) if size else 0
                                while k <= se:
                                    if z[k]:
                                        fix(k)
                                    else:
                                        if not r:
                                            break
                                        r -= 1
                                    k += 1
                                if value:
                                    z[k] = value
                                k += 1
                        if run:
                            for q in range(k, se + 1):
                                if z[q]:
                                    fix(q)
                            run -= 1
    return coefs


def encoded(payload: bytes) -> bytes:
    size = max(64, -(-len(payload) // 64) * 64)
    g = media_jpeg.grid(size // 64)
    c = np.zeros((6 * g[0] * g[1], 64), np.int16)
    c.reshape(-1)[: len(payload)] = np.frombuffer(payload, np.uint8)
    c.reshape(-1)[:size] -= 128
    return media_jpeg.encode_images(c, [g], [size])[0]


@pytest.mark.parametrize("kind", range(5))
def test_scans_by_a_plain_decoder(kind):
    rng = random.Random(kind)
    payload = [
        lambda: bytes(rng.randrange(256) for _ in range(1500)),
        lambda: bytes(rng.choice([127, 128, 129, 128, 128, 128, 128, 130]) for _ in range(2500)),
        lambda: bytes([128] * 700),
        lambda: b"some english text, with commas. " * 40,
        lambda: b"\xff\x00\xff\xd0" * 200,
    ][kind]()
    data = encoded(payload)
    c, images, starts = media_jpeg.decode_coefficients([data])
    plain = scalar_decode(data)
    assert [row for ident in sorted(plain) for row in plain[ident]] == c.tolist()
    assert media_jpeg.payloads(c, images, starts)[0].rstrip(b"\0") == payload.rstrip(b"\0")


def test_tensors():
    data = encoded(b"q" * 900)
    c, images, starts = media_jpeg.decode_coefficients([data, data])
    (_, a), (_, b) = media_jpeg.tensors(c, images, starts)
    assert a.shape == (images[0].height, images[0].width, 3) and (a == b).all()
    # a flat gray image: only DC coefficients, chroma neutral
    c[:] = 0
    (_, g), _ = media_jpeg.tensors(c, images, starts)
    assert (g == 128).all()
    c[: images[0].blocks * 4 // 6, 0] = 80
    (_, g), _ = media_jpeg.tensors(c, images, starts)
    assert (g == 138).all()


def test_media_round_trip(spark):
    got = media_jpeg.media_digest(media_jpeg.media_column(frame(spark, TEXTS))).collect()
    assert len(got) == len(TEXTS) + 2
    by = {r.doc_id: r for r in got}
    for k, t in enumerate(TEXTS):
        raw = (t or "").encode()
        full = raw + b"\0" * (max(64, -(-len(raw) // 64) * 64) - len(raw))
        r = by[k]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(full), hashlib.sha256(full).hexdigest(), zlib.crc32(full[-64:]))
    assert by[0].feature == by[1].feature and by[0].media_sha256 == by[1].media_sha256
    media = media_jpeg.media_column(frame(spark, TEXTS[:4])).withColumn("error", F.lit("clash"))
    bad = media.limit(1).withColumn("media", F.lit(None).cast("binary")).unionByName(media.limit(1).withColumn("media", F.lit(b"\xff\xd8junk")))
    rows = media_jpeg.tensor_column(media.unionByName(bad)).collect()
    assert sum(r.error is None for r in rows) == 6 and sum(r.tensor is None for r in rows) == 2
    assert all(len(r.tensor) == r.height * r.width * 3 for r in rows if r.tensor is not None)
    assert media_jpeg.media_digest(media_jpeg.media_column(frame(spark, []).limit(0))).count() == 0


# ---- tokens

def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(entry.byte_bpe())


def test_encoder_equals_the_library():
    t, e = library(), bpe.Encoder(entry.byte_bpe())
    rng = random.Random(3)
    letters = "abcdefghij  theingion  \n\n\t.,!'s're012éèñß漢字🙂 \x85\xa0\x1c_<|>"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 40))) for _ in range(3000)]
    texts += [c * n for c in "ab =-é" for n in (1, 7, 64, 1001)] + [t or "" for t in TEXTS] + ["x<|endoftext|> y<|endoftext|>"]
    for x in texts:
        ids = np.frombuffer(e.encode(x), "<u4")
        want = t.encode(x, add_special_tokens=False).ids
        assert ids.tolist() == want
        assert e.decode(ids).decode("utf-8", "replace") == t.decode(want, skip_special_tokens=False) == x


def test_bpe_columns(spark):
    docs = frame(spark, TEXTS)
    got = bpe.bpe_digest(docs, entry.byte_bpe()).collect()
    t = library()
    by = {r.doc_id: r for r in got}
    for k, x in enumerate(TEXTS):
        ids = t.encode(x or "", add_special_tokens=False).ids
        assert (by[k].n_tokens, by[k].ids_sha256, by[k].decoded_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((x or "").encode()).hexdigest())
    rows = bpe.bpe_columns(docs, entry.byte_bpe()).collect()
    assert all(r.decoded == (r.text or "") and r.n_tokens == len(r.token_ids) for r in rows) and len(rows) == len(got)
    assert bpe.bpe_digest(docs.limit(0), entry.byte_bpe()).count() == 0 and bpe.bpe_columns(docs.limit(0), entry.byte_bpe()).count() == 0


@pytest.mark.parametrize("block", [1, 3, 64, 1 << 20])
def test_token_counts(spark, block):
    docs = frame(spark, TEXTS)
    got = sorted((str(r.doc_id), r.n_tokens) for r in token_counts.token_counts(spark, docs, entry.byte_bpe(), block_tokens=block).collect())
    t = library()
    t.encode_special_tokens = True
    want = sorted((str(r.doc_id), len(t.encode(r.text or "", add_special_tokens=False).ids)) for r in docs.collect())
    assert got == want
    assert token_counts.token_counts(spark, docs.limit(0), entry.byte_bpe()).count() == 0


def test_recurring_pieces_are_made_once():
    # more pieces than one generation of the encoder's own table, again and again: the writer makes each of them once
    of_writer, made = token_counts.writer_encoder(entry.byte_bpe()).seen, []
    kept = bpe.Seen(lambda p: made.append(p) or b"1234" * 4, of_writer.generation, of_writer.room)
    for _ in range(3):
        for k in range(300_000):
            assert kept[f" w{k}"] == b"1234" * 4
    assert len(made) == 300_000
    # pieces of many ids fill it up sooner
    kept = bpe.Seen(lambda p: b"1234" * 100, 1000, 4000)
    for k in range(95):
        kept[f" w{k}"]
        assert sum(map(len, kept.values())) <= 4000 and len(kept.old) <= 10
    assert (len(kept), len(kept.old)) == (5, 10)


@pytest.mark.parametrize("block", [1, 2, 5, 100])
def test_scan_of_foreign_files(spark, tmp_path, block):
    rng = random.Random(block)
    want = []
    for k in range(4):
        ids = [rng.choice([9, 1, 2, 3]) for _ in range(rng.randint(0, 60))]
        (tmp_path / f"f{k}.bin").write_bytes(np.array(ids, "<u2").tobytes())
        docs, at = [], 0
        for i, x in enumerate(ids):
            if x == 9:
                docs.append((at, i - at))
                at = i + 1
        if at < len(ids):
            docs.append((at, len(ids) - at))
        want += [(f"f{k}.bin", n, s, c) for n, (s, c) in enumerate(docs)]
    got = token_counts.scan_token_files(spark, str(tmp_path), 9, block)
    assert sorted((r.file.rsplit("/", 1)[1], r.ordinal, r.start, r.n_tokens) for r in got.collect()) == sorted(want)


# ---- languages and quality

def test_codewords_are_apart():
    for n in (2, 3, 4, 5, 6, 12):
        c = langid_ecoc.codewords(n)
        assert len({tuple(r) for r in c}) == n and (abs(c.sum(0)) < n).all()


def test_language_accuracy(spark):
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = entry.op7_language_id(spark, SF).collect()
    held = [r for r in rows if r.held_out]
    assert len(rows) == len(truth) and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    assert np.mean([truth[r.doc_id] == r.lang_pred for r in held]) > 0.97 and all(0 <= r.score <= 1 for r in rows)


def test_languages_of_odd_texts(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(300)
    model = langid_ecoc.fit(spark, docs)
    odd = frame(spark, [None, "", "123 !? 漢", "!!", "the", "×÷ — …"], "doc_id long, text string, lang_pred string, score string")
    by = {r.doc_id: r for r in langid_ecoc.classify(spark, odd, model).collect()}
    assert [by[k].lang_pred for k in (0, 1, 3, 5)] == ["und"] * 4 and by[2].lang_pred != "und" and by[4].lang_pred != "und"
    empty = langid_ecoc.fit(spark, docs.limit(0))
    assert {r.lang_pred for r in langid_ecoc.classify(spark, odd, empty).collect()} == {"und"}
    assert langid_ecoc.classify(spark, odd.limit(0), model).count() == 0
    assert langid_ecoc.keep_languages(spark, docs.select("doc_id", "text", "lang")).columns == ["doc_id", "text", "lang"]


def test_pooled():
    rng = np.random.default_rng(1)
    n, s = rng.integers(1, 9, 60).astype(float), rng.random(60)
    fit = quality_rff.pooled(n, n * s)
    assert (np.diff(fit) >= -1e-12).all() and np.isclose((fit * n).sum(), (n * s).sum())
    # no monotone vector of the pooled levels is nearer
    for _ in range(50):
        other = np.sort(fit + rng.normal(0, 0.05, 60))
        assert ((fit - s) ** 2 * n).sum() <= ((other - s) ** 2 * n).sum() + 1e-9


def test_quality_accuracy(spark):
    rows = entry.op10_quality(spark, SF).collect()
    truth = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    held = [r for r in rows if r.held_out and r.doc_id in truth]
    assert np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.95 and all((r.score >= 0.3) == bool(r.predicted) for r in rows)
    good, bad = ([r.score for r in held if truth[r.doc_id] == q] for q in (1, 0))
    assert np.mean([a > b for a in good for b in bad]) > 0.97


def test_quality_of_odd_tables(spark):
    docs = frame(spark, [None, "", "plain words", "!!! ###"], "doc_id long, text string, predicted string, score string")
    labels = spark.createDataFrame([(1, 0, 0), (2, 1, 0), (2, 1, 1), (None, 1, 0), (3, None, 0)], "doc_id long, quality int, toxic int")
    for l in (labels, labels.limit(0)):
        rows = quality_rff.quality(spark, docs, l, langid_ecoc.held_out("doc_id", 5, 0)).collect()
        assert len(rows) == 6 and all(0 <= r.score <= 1 for r in rows)
    assert quality_rff.quality(spark, docs.limit(0), labels, langid_ecoc.held_out("doc_id", 5, 0)).count() == 0


# ---- pages

PAGES = [
    ("https://h.example/1", "<html><head><title>t</title><style>p{}</style></head><body><nav><ul><li>menu</ul></nav><article><h1>Head &amp; more</h1><p>One <b>two</b>\n three<p>Four<br>five</article><footer>foot</footer></body></html>", "Head & more\nOne two three\nFour five"),
    ("https://h.example/2", "<body><div class='cookie-notice'>ok?</div><main><p>Main &lt;text&gt;</p><aside>side</aside><script>var a='<p>x</p>'</script></main><div id=comments><p>nice</div>", "Main <text>"),
    ("https://h.example/3", "<p>a < b and 3 &gt; 2<!-- gone --><div class=ad>buy</div><form>f</form><p>end", "a < b and 3 > 2\nend"),
    (None, None, ""),
    ("x", "", ""),
    ("https://h.example/4", "just text", "just text"),
    ("https://h.example/6", "<div class='site-header'>S</div><main class='has-sidebar' id='main-menu'><div class='article-header'><h2>T</h2></div><div class='with-ads'>x</div><div class='main sidebar'>no</div></main>", "T\nx"),
    ("https://h.example/5", "<article><header><h1>Own</h1></header><table><tr><td>c1<td>c2<tr><td>c3</table></article><article class=comment>no</article>", "Own\nc1\nc2\nc3"),
]


def test_pages(spark):
    p = spark.createDataFrame([(k, u, h, "x", "y") for k, (u, h, _) in enumerate(PAGES)] + [(0, *PAGES[0][:2], "x", "y")], "page_id long, url string, html string, text string, host string")
    got = html_extract.extract_text(spark, p).collect()
    assert sorted((r.page_id, r.text, r.n_chars) for r in got) == sorted([(k, t, len(t)) for k, (_, _, t) in enumerate(PAGES)] + [(0, PAGES[0][2], len(PAGES[0][2]))])
    assert html_extract.extract_text(spark, p.limit(0)).count() == 0


@pytest.mark.parametrize("sent", [0, 1 << 20])
def test_site_templates_go(spark, monkeypatch, sent):
    monkeypatch.setattr(html_extract, "SENT_HASHES", sent)
    page = "<body><div><p>About this site</p><p>Find us</p></div><div><p>Story {0} begins</p><p>and ends {0}</p></div></body>"
    rows = [(k, f"https://A.example:80/{k}", page.format(k)) for k in range(12)] + [(100 + k, f"https://b{k}.example/", page.format(k)) for k in range(3)]
    got = {r.page_id: r.text for r in html_extract.extract_text(spark, spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[k] == f"Story {k} begins\nand ends {k}" for k in range(12))
    assert got[101] == "About this site\nFind us\nStory 1 begins\nand ends 1"


def test_n_grams_in_portions(monkeypatch):
    import pyarrow as pa

    text = "Ein länger Text mit Éa und mehr. " * 20
    ((_, whole, _),) = langid_ecoc.vectors(pa.array([text]))
    monkeypatch.setattr(langid_ecoc, "PORTION", 37)
    ((_, parts, letters),) = langid_ecoc.vectors(pa.array([text]))
    assert np.allclose(whole, parts) and letters.all()
    monkeypatch.undo()
    got = list(langid_ecoc.vectors(pa.array([text, "x"])))
    assert np.allclose(got[0][1][0], whole[0])


def brute_templates(pages):
    """For each host, how many serialised container subtrees recur on 5 pages and 30 % of its pages; from the parsed pages by plain recursion."""
    counts, sizes = {}, {}
    for url, source in pages:
        host = url.split("/")[2]
        sizes[host] = sizes.get(host, 0) + 1
        page, found = html_extract.Page(source), set()
        inside = page.inside()

        def shape(k, blind):
            parts = []
            for kid in page.kids[k]:
                if kid < 0:
                    part = "LINK" if blind and page.blocks[~kid][2] else page.blocks[~kid][0]
                elif page.ends[kid] > page.elements[kid].first:
                    part = shape(kid, blind)
                else:
                    continue
                if not (blind and parts and parts[-1] == part):
                    parts.append(part)
            return (page.elements[k].tag, tuple(parts))

        total = sum(len(t) for t, _, _ in page.blocks)
        for k, e in enumerate(page.elements):
            own = page.blocks[e.first : page.ends[k]]
            if e.tag in html_extract.CONTAINERS and own:
                found.add((e.names, False, shape(k, False)))
                if len(own) > 1 and all(link for _, _, link in own) and not inside[k] and 2 * sum(len(t) for t, _, _ in own) <= total:
                    found.add((e.names, True, shape(k, True)))
        for x in found:
            counts[host, x] = counts.get((host, x), 0) + 1
    return {h: sum(n >= 5 and n >= 0.3 * sizes[h] for (g, _), n in counts.items() if g == h) for h in sizes}


def test_templates_by_brute_force(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    rows = [(r.url, r.html) for r in pages.collect()]
    want = brute_templates(rows)
    got = {r.url: r.n_template for r in html_extract.extract_text(spark, pages).collect()}
    assert got == {url: want[url.split("/")[2]] for url, _ in rows}
    assert sum(want.values()) > 0


def test_templates_are_told_without_words(spark):
    """Lists of links that differ from page to page, and equal boxes, go by their recurrence alone; lists in articles stay."""
    links = lambda k, n: "".join(f"<li><a href=/{k}/{j}>To {k} {j}</a>" for j in range(n))
    body = lambda k: f"<p>Text of page {k} goes on for more than half of all that the page has to say, and on, and on, and on, and on.</p>"
    rows = [(k, f"https://h.example/{k}", f"<body><div class=q7><ul>{links(k, 2 + k % 3)}</ul></div><div class=z3>Same box</div>{body(k)}") for k in range(8)]
    rows += [(20 + k, f"https://g.example/{k}", f"<body><article>{body(k)}<ul>{links(k, 3)}</ul></article>") for k in range(8)]
    got = {r.page_id: r.text for r in html_extract.extract_text(spark, spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    text = lambda k: body(k)[3:-4]
    assert all(got[k] == text(k) for k in range(8))
    assert all(got[20 + k] == "\n".join([text(k), *(f"To {k} {j}" for j in range(3))]) for k in range(8))
    alone = {r.page_id: r.text for r in html_extract.extract_text(spark, spark.createDataFrame(rows[:3], "page_id long, url string, html string")).collect()}
    assert alone[1] == "To 1 0\nTo 1 1\nTo 1 2\nSame box\n" + text(1)


def test_sections_of_an_article_stay():
    source = "<body><div class=search>find</div><article><section class=discussion><p>One</section><div class=related-work>Two</div><div class=comments>no</div></article><div class=related>out</div>"
    assert html_extract.Page(source).text(set()) == "One\nTwo"


@pytest.mark.parametrize("source", ["<div>x" * 20_000, "<a " * 50_000, '<a "' * 50_000, "<b>x" * 20_000 + "</i>" * 20_000, "<script>" * 30_000, "</script " * 30_000, "<li><td>x" * 5_000, "<a title='>" * 20_000])
def test_broken_pages_take_linear_time(source):
    began = time.perf_counter()
    page = html_extract.Page(source)
    page.subtrees()
    page.text({1})
    assert time.perf_counter() - began < 10


def test_tensors_by_plain_inverse_transform():
    """Coefficients of all frequencies, doubled chroma and colours against the formulas of the standard, sample by sample."""
    rng = np.random.default_rng(3)
    n = 6 * 2 * 1
    c = np.zeros((n, 64), np.int16)
    c[:, 0] = rng.integers(-128, 128, n)
    for k in range(n):
        at = rng.choice(np.arange(1, 64), 12, replace=False)
        c[k, at] = rng.integers(-60, 60, 12)
    (data,) = media_jpeg.encode_images(c, [(2, 1)], [n * 64])
    back, images, starts = media_jpeg.decode_coefficients([data])
    assert (back[: len(c)] == c).all()
    ((_, t),) = media_jpeg.tensors(back, images, starts)
    x = np.arange(8)
    basis = np.cos((2 * x[:, None] + 1) * x[None] * np.pi / 16) * np.where(x == 0, np.sqrt(0.5), 1.0)[None] / 2
    zigzag = sorted(range(64), key=lambda k: (k // 8 + k % 8, (k // 8) if (k // 8 + k % 8) % 2 else (k % 8)))
    def plane(comp):
        p = images[0].components[comp]
        q = images[0].quants[p.quant]
        out = np.zeros((p.v * images[0].mcus[1] * 8, p.h * images[0].mcus[0] * 8))
        for y in range(out.shape[0] // 8):
            for z in range(out.shape[1] // 8):
                block = np.zeros(64)
                block[zigzag] = back[starts[0] + p.base + y * p.stride + z] * q
                out[8 * y : 8 * y + 8, 8 * z : 8 * z + 8] = basis @ block.reshape(8, 8) @ basis.T
        return np.clip(np.rint(out), -128, 127)
    lum, cb, cr = plane(0) + 128, *(np.kron(plane(k), np.ones((2, 2))) for k in (1, 2))
    want = np.stack([lum + 1.402 * cr, lum - 0.344136 * cb - 0.714136 * cr, lum + 1.772 * cb], -1).clip(0, 255)
    want = want[: t.shape[0], : t.shape[1]]
    # a rounding of the transform at a half may differ by one, and by that times 1.772 in a colour
    assert t.shape == want.shape and np.abs(t - want).max() <= 3 and np.abs(t - want).mean() < 0.6


def test_many_short_rows_of_languages():
    import pyarrow as pa

    rows = ["ab cd", "", "é"] * 400
    got = np.concatenate([x for _, x, _ in langid_ecoc.vectors(pa.array(rows))])
    one = [next(iter(langid_ecoc.vectors(pa.array([t]))))[1][0] for t in rows[:3]]
    assert all(np.allclose(got[k], one[k % 3]) for k in range(len(rows)))


def test_decoding_by_plain_losses():
    rng = np.random.default_rng(1)
    code = langid_ecoc.codewords(4)
    assert min((a != b).sum() for i, a in enumerate(code) for b in code[:i]) >= 4
    model = langid_ecoc.Model(list("abcd"), code, rng.normal(size=(langid_ecoc.BUCKETS + 1, code.shape[1])), rng.uniform(0.1, 0.5, code.shape[1]), np.zeros((langid_ecoc.BUCKETS, 4)), np.zeros(4))
    x = rng.random((5, langid_ecoc.BUCKETS)) / 50
    best, score, close = model.decode(x)
    for k in range(5):
        margins = [sum(a * b for a, b in zip(x[k], model.weights[:-1, j], strict=True)) + model.weights[-1, j] for j in range(code.shape[1])]
        losses = [sum(w * np.log1p(np.exp(-m * b)) for w, m, b in zip(model.trust, margins, word, strict=True)) / sum(model.trust) for word in code]
        assert best[k] == int(np.argmin(losses)) and 0 <= score[k] <= 1
        assert close[k] == (sorted(losses)[1] - min(losses) < langid_ecoc.MARGIN)
