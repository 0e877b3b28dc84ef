"""Language identification with error-correcting output codes.

Each language has a codeword; for each bit, a linear classifier over letter n-grams (hashed 1- to 3-grams of the lower-cased
text, all of it) predicts that bit. The loss of a text against a codeword is the sum over bits of weight * log(1 + exp(-margin)),
the weights being the classifiers' accuracies above chance on the half of the sampled rows that they weren't fitted on; the
codeword of least loss wins, and a text whose two best losses are close is flagged as ambiguous. From four languages on the
codewords are four bits or more apart, so a single bit may fail; two or three languages have too few splits for that.

The codes choose among the learned languages only. Whether a text is of any of them is told by its likeness: the mean
log-share of its n-grams in a language, above a floor that is calibrated on the labelled rows, each left out of its own language.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stratalake.llm.common import discard, spans, text_buffer, tidy

#: Hashed features; a text's vector has this length.
BUCKETS = 1 << 13
#: Training rows for each language, those of the least hash of the text in each of STRATA strata. With many languages each has
#: fewer, so that all have TOTAL at most, but two or more.
SAMPLE, STRATA, TOTAL = 640, 64, 5120
MARGIN = 0.15
#: Added to the shares of n-grams before the logarithm. A language's floor: this quantile of its labelled rows' log-shares, less SLACK.
UNSEEN, LOWEST, SLACK = 1e-6, 0.01, 2.5
#: Bytes and rows of texts whose n-grams are counted at a time.
PORTION, ROWS = 1 << 19, 256


def held_out(id_col: str, modulus: int, remainder: int) -> Column:
    """Whether crc32 of the id as text has this remainder; false for null ids."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % modulus == remainder, F.lit(False))


def codewords(n: int) -> np.ndarray:
    """n distinct rows of +1 and -1. Up to five languages get all splits of them in two, more get random columns of a fixed seed."""
    if n <= 1:
        return np.ones((n, 1))
    if n <= 5:
        columns = [[1] + [1 if k >> i & 1 else -1 for i in range(n - 1)] for k in range((1 << n - 1) - 1)]
        return np.array(columns, float).T
    rng = np.random.default_rng(11)
    length = 15 * int(np.ceil(np.log2(n)))
    while True:
        code = rng.choice([-1.0, 1.0], (n, length))
        apart = (code[:, None] != code[None]).sum(-1) + length * np.eye(n, dtype=int)
        if apart.min() >= 5 and (np.abs(code.sum(0)) < n).all():
            return code


def _folded(data: np.ndarray) -> np.ndarray:
    """Bytes with A-Z lowered, Latin-1 capitals' second UTF-8 byte lowered, digits, signs and white space as one blank value."""
    out = data.copy()
    upper = (out >= 65) & (out <= 90)
    out[upper] += 32
    if len(out) > 1:
        after = np.zeros(len(out), bool)
        after[1:] = out[:-1] == 0xC3
        out[after & (out >= 0x80) & (out <= 0x9E) & (out != 0x97)] += 32
    out[(out < 97) | ((out > 122) & (out < 128))] = 32
    return out


def _grams(d: np.ndarray, row: np.ndarray, n_rows: int) -> np.ndarray:
    """Counts of the n-grams that begin at each of the first len(row) folded bytes, by row."""
    n = len(row)
    d = np.concatenate([d, [32, 32]]).astype(np.int32)
    one, two, three = d[:n], d[1 : n + 1], d[2 : n + 2]
    keep = (one != 32) | (two != 32)
    one, two, three, at = one[keep], two[keep], three[keep], row[keep] * BUCKETS
    pair = one * 257 + two
    g2 = pair.astype(np.int64) * 40503 % 65521 % (BUCKETS // 2)
    g3 = (pair * 257 + three).astype(np.int64) * 40503 % 1000003 % (BUCKETS // 2) + BUCKETS // 2
    return np.bincount(at + g2, minlength=n_rows * BUCKETS) + np.bincount(at + g3, minlength=n_rows * BUCKETS)


def vectors(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, square-rooted shares of the hashed n-grams by row, whether the row has a letter) for spans of rows.

    A text longer than a span is counted in portions that overlap by an n-gram, so it needs no more memory than others.
    """
    data, offsets = text_buffer(column)
    for a, b in spans(offsets, PORTION, ROWS):
        first, last = int(offsets[a]), int(offsets[b])
        counts, letters = np.zeros((b - a) * BUCKETS, np.int64), np.zeros(b - a, bool)
        if b - a == 1:
            for at in range(first, last, PORTION):
                lead = int(at > first)
                d = _folded(data[at - lead : min(last, at + PORTION + 2)])[lead:]
                n = min(PORTION, last - at)
                letters |= bool((d[:n] != 32).any())
                counts += _grams(d, np.zeros(n, np.int64), 1)
                if at == first:
                    counts += _grams(np.concatenate([[32], d[:2]]), np.zeros(1, np.int64), 1)
        else:
            # two blanks between the texts keep their n-grams of up to three bytes apart
            begin = np.concatenate([offsets[a:b], [last]]) - first
            d = np.insert(_folded(data[first:last]), np.repeat(begin, 2), 32)
            ends = begin + 2 * np.arange(b - a + 1)
            row = np.repeat(np.arange(b - a), np.diff(ends))
            counts += _grams(d, row, b - a)
            letters = np.bincount(row[d[: len(row)] != 32], minlength=b - a) > 0
        counts = counts.reshape(b - a, BUCKETS).astype(np.float32)
        yield a, np.sqrt(counts / np.maximum(counts.sum(1, keepdims=True), 1)), letters


def has_letter(text: str) -> bool:
    return any(c.isalpha() for c in text)


@dataclass
class Model:
    languages: list[str]
    code: np.ndarray
    weights: np.ndarray  # (BUCKETS + 1, bits)
    trust: np.ndarray  # (bits,)
    log_share: np.ndarray  # (BUCKETS, languages)
    floor: np.ndarray  # (languages,)

    def likeness(self, x: np.ndarray) -> np.ndarray:
        """How far each row's mean log-share lies above the floor of the language that it suits best; negative: of none."""
        return (x * x @ self.log_share - self.floor).max(1)

    def decode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(best language, score 0 to 1, ambiguous) of each row of vectors."""
        margins = x @ self.weights[:-1] + self.weights[-1]
        loss = (np.logaddexp(0, -margins[:, None, :] * self.code[None]) * self.trust).sum(-1) / self.trust.sum()
        p = np.exp(-loss * self.code.shape[1])
        p /= p.sum(1, keepdims=True)
        best = loss.argmin(1)
        two = np.sort(loss, 1)
        close = (two[:, 1] - two[:, 0] < MARGIN) if loss.shape[1] > 1 else np.zeros(len(x), bool)
        return best, p[np.arange(len(x)), best], close


def _sparse(rows: DataFrame) -> DataFrame:
    """(lang, h, at, share): the buckets that each whole text fills, as 16-bit numbers, and their values as 32-bit floats."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, x, _ in vectors(batch.column(1)):
                full = [np.flatnonzero(v).astype(np.uint16) for v in x]
                part = batch.slice(a, len(x))
                at, share = pa.array([k.tobytes() for k in full], pa.binary()), pa.array([v[k].tobytes() for v, k in zip(x, full, strict=True)], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), at, share], names=["lang", "h", "at", "share"])

    return rows.select("lang", "text", "h").mapInArrow(run, "lang string, h long, at binary, share binary")


def _weights(z: np.ndarray, y: np.ndarray, share: np.ndarray, rounds: int) -> np.ndarray:
    """Ridge weights of each bit by conjugate gradients, scaled so that a logistic loss fits the margins."""
    w = np.zeros((z.shape[1], y.shape[1]), np.float32)
    r = z.T @ (share * y)
    p, rs = r.copy(), (r * r).sum(0)
    for _ in range(rounds):
        ap = z.T @ (share * (z @ p)) + 1e-3 * len(z) / 1000 * p
        step = rs / np.maximum((p * ap).sum(0), 1e-30)
        w += step * p
        r -= step * ap
        new = (r * r).sum(0)
        p = r + new / np.maximum(rs, 1e-30) * p
        rs = new
    return 4 * w


def fit(spark: SparkSession, docs: DataFrame, sample: int = SAMPLE, rounds: int = 60, total: int = TOTAL) -> Model:
    """Fit on the rows of docs with text and lang: for each language the rows of least hash, near sample of them and all
    languages together near total (documented bounds of the training sample; whole texts are used).

    A table without such rows gives a model without languages, which says und of everything.
    """
    rows = docs.where("text IS NOT NULL AND lang IS NOT NULL AND length(trim(text)) > 0").select("text", "lang", F.xxhash64("text").alias("h"))
    n_languages = rows.select("lang").distinct().count()
    sample = min(sample, max(2, total // max(1, n_languages)))
    # the hashes up to which rows are taken are found without texts
    strata = min(STRATA, sample)
    rows = rows.withColumn("stratum", F.pmod(F.shiftright("h", 8), F.lit(strata)))
    least = Window.partitionBy("lang", "stratum").orderBy("h")
    cuts = rows.select("lang", "stratum", "h").distinct().withColumn("k", F.row_number().over(least)).where(F.col("k") <= -(-sample // strata)).groupBy("lang", "stratum").agg(F.max("h").alias("cut"))
    rows = rows.join(F.broadcast(cuts), ["lang", "stratum"]).where("h <= cut").select("lang", "text", "h").distinct()
    table = _sparse(rows).toArrow().sort_by([(c, "ascending") for c in ("lang", "h", "at", "share")])
    # the driver's JVM gives back what sampling took before Python needs the dense table
    discard(spark)
    # the rows of even places first: the halves are slices, not copies
    table = table.take(pa.array(np.argsort(np.arange(len(table)) % 2, kind="stable")))
    names = table.column("lang").to_pylist()
    languages = sorted(set(names))
    code = codewords(len(languages))
    if not languages:
        return Model([], code, np.zeros((BUCKETS + 1, 1)), np.ones(1), np.zeros((BUCKETS, 0)), np.zeros(0))
    z = np.zeros((len(names), BUCKETS + 1), np.float32)
    z[:, -1] = 1
    for i, (at, value) in enumerate(zip(table.column("at"), table.column("share"), strict=True)):
        z[i, np.frombuffer(at.as_py(), np.uint16)] = np.frombuffer(value.as_py(), np.float32)
    del table
    which = np.searchsorted(languages, names)
    y = code[which].astype(np.float32)
    # every language counts the same, however many rows it has
    share = ((1 / np.bincount(which))[which][:, None] * len(names) / len(languages)).astype(np.float32)
    w = _weights(z, y, share, rounds)
    # a bit's weight: how often it is right on rows of the half that it wasn't fitted on
    halves = (slice(0, -(-len(names) // 2)), slice(-(-len(names) // 2), None))
    if len(names) >= 2 * len(languages):
        right = np.concatenate([(z[rest] @ _weights(z[own], y[own], share[own], rounds)) * y[rest] > 0 for own, rest in (halves[::-1], halves)])
    else:
        right = (z @ w) * y > 0
    log_share, floor = np.zeros((BUCKETS, len(languages)), np.float32), np.zeros(len(languages), np.float32)
    for k in range(len(languages)):
        portions = np.array_split(np.flatnonzero(which == k), -(-int((which == k).sum()) // 64))
        sums = np.sum([np.square(z[i, :-1], dtype=np.float64).sum(0) for i in portions], 0)
        n = int((which == k).sum())
        log_share[:, k] = np.log(sums / n + UNSEEN)
        suits = []
        for i in portions:
            own = np.square(z[i, :-1], dtype=np.float64)
            suits.append((own * np.log(np.maximum(sums - own, 0) / max(n - 1, 1) + UNSEEN)).sum(1))
        floor[k] = np.quantile(np.concatenate(suits), LOWEST) - SLACK
    return Model(languages, code, w, np.maximum(right.mean(0) - 0.5, 1e-3), log_share, floor)


def classify(spark: SparkSession, docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """docs with lang_pred, score, ambiguous and likeness added; columns of these names that docs has already are replaced.

    lang_pred is the best of the learned languages however little the text is like it; under 0, likeness says it is like none. A null text and a text without a letter get und and score 0. Equal texts get equal results but for the last bits of the
    score. An empty table gives an empty one; repeated rows and null ids pass through.
    """
    docs = docs.drop("lang_pred", "score", "ambiguous", "likeness")
    at = docs.columns.index(text_col)
    shared = spark.sparkContext.broadcast(model)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            column = batch.column(at)
            for a, x, letters in vectors(column):
                part = batch.slice(a, len(x))
                known = letters.copy()
                for i in np.flatnonzero(letters):
                    # bytes beyond ASCII may be signs only
                    t = part.column(at)[int(i)].as_py()
                    known[i] = has_letter(t[:200]) or has_letter(t)
                best, score, close = m.decode(x) if m.languages else (np.zeros(len(x), int), np.zeros(len(x)), np.zeros(len(x), bool))
                known &= bool(m.languages)
                names = [m.languages[k] if ok else "und" for k, ok in zip(best, known, strict=True)]
                like = pa.array((m.likeness(x) if m.languages else np.zeros(len(x))).astype(float))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(names, pa.string()), pa.array(np.where(known, np.round(score, 9), 0.0)), pa.array(close & known), like], names=[*part.schema.names, "lang_pred", "score", "ambiguous", "likeness"])

    return docs.mapInArrow(run, f"{schema}, lang_pred string, score double, ambiguous boolean, likeness double")


def keep_languages(spark: SparkSession, docs: DataFrame, sample: int = SAMPLE, least: float = 0.0) -> DataFrame:
    """docs without the rows whose language can't be told (und), that are like no learned language, or whose score is under least."""
    model = fit(spark, docs, sample)
    found = classify(spark, docs, model)
    return found.where((F.col("lang_pred") != "und") & (F.col("likeness") >= 0) & (F.col("score") >= least)).select(*docs.columns)
