"""Quality classifier: random Fourier features of document statistics, ridge scores, isotonic calibration.

One pass over the whole texts gives a row of statistics for each document, kept as a small table. The labelled rows of it are
standardised and mapped to cosines of random projections (a Gaussian kernel's features); every partition sums its normal
equations for four folds in whole numbers, so the sums don't depend on their order. Models without a fold score that
fold's rows, the binned scores and labels are pooled into a monotone step function, and the model of all folds scores
every document through it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalake.llm.common import WHITE_SPACE, hash_words, materialise, spans, text_buffer, tidy, word_mask

SIGNS = b"!|#$%&*.,;:?-_()[]{}<>/@='\"+\\"
FEATURES = 192
FOLDS = 4
SCALE = 1 << 10
BINS = 512
RIDGE = 1.0


def _classes() -> np.ndarray:
    """A row of 0 and 1 for each statistic that counts bytes."""
    sets = [range(65, 91), range(97, 123), range(48, 58), WHITE_SPACE, [10], range(128, 256), SIGNS, [*range(9), *range(14, 32), 127], *([c] for c in SIGNS[:9])]
    out = np.zeros((256, len(sets)), np.float64)
    for k, s in enumerate(sets):
        out[list(s), k] = 1
    return out


CLASSES = _classes()
N_STATS = CLASSES.shape[1] + 7
STATS = [f"s{k}" for k in range(N_STATS)]


def statistics(column: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    """(first row, statistics by row) for spans of rows; an empty text's are all 0."""
    data, offsets = text_buffer(column)
    inside = word_mask(WHITE_SPACE)
    for a, b in spans(offsets, 1 << 19):
        d, o = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        n = np.diff(o)
        row = np.repeat(np.arange(b - a, dtype=np.int32), n)
        counts = np.zeros((b - a) * 256, np.int64)
        for at in range(0, len(d), 1 << 20):  # a very long text in portions
            counts += np.bincount(row[at : at + (1 << 20)].astype(np.int64) * 256 + d[at : at + (1 << 20)], minlength=len(counts))
        counts = counts.reshape(b - a, 256)
        shares = np.sqrt(counts @ CLASSES / np.maximum(n, 1)[:, None])
        words, c = hash_words(d, o, inside)
        m = np.diff(c)
        owner = np.repeat(np.arange(b - a), m)
        again = np.zeros(b - a)
        if len(words) > 1:
            same = (words[1:] == words[:-1]) & (owner[1:] == owner[:-1])
            again = np.bincount(owner[1:][same], minlength=b - a).astype(float)
        distinct, top = np.zeros(b - a), np.zeros(b - a)
        for i in np.flatnonzero(m):
            many = np.unique(words[c[i] : c[i + 1]], return_counts=True)[1]
            distinct[i], top[i] = len(many), many.max()
        w = np.maximum(m, 1)
        lines = counts[:, 10] + 1
        more = [np.log1p(n) / 4, np.log1p(m) / 4, np.log1p(n / w), again / w, distinct / np.maximum(w, 1) ** 0.8 / 2, np.sqrt(top / w), np.log1p(m / lines) / 3]
        yield a, np.concatenate([shares, np.stack(more, 1)], 1) * (n > 0)[:, None]


def stats_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, s in statistics(batch.column(1)):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, len(s)), *(pa.array(np.ascontiguousarray(s[:, k])) for k in range(N_STATS))], names=["doc_id", *STATS])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, " + ", ".join(f"{s} double" for s in STATS))


@dataclass
class Model:
    mean: np.ndarray
    spread: np.ndarray
    weights: np.ndarray
    steps: np.ndarray  # bin centres
    levels: np.ndarray  # their calibrated scores

    def features(self, s: np.ndarray) -> np.ndarray:
        """Whole numbers: cosines times SCALE, and a constant."""
        rng = np.random.default_rng(7)
        x = np.clip((s - self.mean) / self.spread, -6, 6)
        project = rng.normal(size=(N_STATS, FEATURES - 1)) / np.sqrt(N_STATS) / 1.5
        z = np.round(np.cos(x @ project + rng.uniform(0, 2 * np.pi, FEATURES - 1)) * SCALE)
        return np.concatenate([z, np.full((len(z), 1), SCALE)], 1).astype(np.int64)

    def raw(self, s: np.ndarray) -> np.ndarray:
        return self.features(s) @ self.weights / SCALE

    def score(self, s: np.ndarray) -> np.ndarray:
        r = self.raw(s)
        flat = np.interp(r, self.steps, self.levels) if len(self.steps) else np.full(len(r), 0.5)
        # a trace of the raw score keeps the order of rows on one step
        return np.round(np.clip(0.999 * flat + 0.001 / (1 + np.exp(-4 * (r - 0.5))), 0, 1), 9)


def pooled(counts: np.ndarray, sums: np.ndarray) -> np.ndarray:
    """The non-decreasing means nearest to sums / counts by weight (pool adjacent violators)."""
    blocks: list[list[float]] = []
    for c, s in zip(counts, sums, strict=True):
        blocks.append([float(c), float(s), 1])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][0] >= blocks[-1][1] * blocks[-2][0]:
            c2, s2, k2 = blocks.pop()
            blocks[-1] = [blocks[-1][0] + c2, blocks[-1][1] + s2, blocks[-1][2] + k2]
    return np.concatenate([np.full(int(k), s / c) for c, s, k in blocks]) if blocks else np.zeros(0)


def fit(spark: SparkSession, labelled: DataFrame) -> Model:
    """Fit on rows of statistics with a label (0 or 1). No rows give a model that scores everything 0.5."""
    moments = labelled.agg(*(f(s) for s in STATS for f in (F.avg, F.stddev_pop))).first()
    got = np.array([0.0 if v is None else round(v, 9) for v in moments])
    spread = got[1::2]
    model = Model(got[::2], np.where(spread > 1e-6, spread, 1.0), np.zeros(FEATURES), np.zeros(0), np.zeros(0))
    i, j = np.triu_indices(FEATURES)
    width = len(i) + FEATURES
    rows = labelled.select(F.pmod(F.xxhash64(*STATS), F.lit(FOLDS)).cast("int").alias("fold"), F.col("label").cast("int").alias("label"), *STATS)
    first = spark.sparkContext.broadcast(model)

    def matrix(batch: pa.RecordBatch) -> np.ndarray:
        return np.stack([batch.column(2 + k).to_numpy() for k in range(N_STATS)], 1)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((FOLDS, width), np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                z = first.value.features(matrix(part)).astype(np.float64)
                fold, y = part.column(0).to_numpy(), part.column(1).to_numpy()
                for k in range(FOLDS):
                    zk = z[fold == k]
                    total[k] += np.concatenate([(zk.T @ zk)[i, j], zk.T @ (y[fold == k] * SCALE)]).astype(np.int64)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total.reshape(-1)[at])], names=["cell", "value"])

    table = rows.mapInArrow(sums, "cell int, value long").groupBy("cell").agg(F.sum("value").alias("value")).toPandas()
    total = np.zeros(FOLDS * width)
    total[table["cell"].to_numpy(np.int64)] = table["value"].to_numpy(np.float64) / SCALE**2
    total = total.reshape(FOLDS, width)

    def solved(v: np.ndarray) -> np.ndarray:
        a = np.zeros((FEATURES, FEATURES))
        a[i, j] = a[j, i] = v[: len(i)]
        return np.linalg.solve(a + RIDGE * np.eye(FEATURES), v[len(i) :])

    without = spark.sparkContext.broadcast(np.stack([solved(total.sum(0) - t) for t in total]))
    model.weights = solved(total.sum(0))

    def binned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            z = first.value.features(matrix(batch))
            r = (z * without.value[batch.column(0).to_numpy()]).sum(1) / SCALE
            at = np.round(np.clip(r, -0.5, 1.5) * BINS).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(at), batch.column(1)], names=["bin", "label"])

    bins = rows.mapInArrow(binned, "bin int, label int").groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("ones")).orderBy("bin").toPandas()
    model.steps = bins["bin"].to_numpy(np.float64) / BINS
    # half a row of each label keeps the ends off 0 and 1
    mean = bins["ones"].sum() / max(1, bins["n"].sum())
    model.levels = pooled(bins["n"].to_numpy(float) + 0.02, bins["ones"].to_numpy(float) + 0.02 * mean)
    return model


def scored(spark: SparkSession, stats: DataFrame, model: Model) -> DataFrame:
    """stats' other columns with score added."""
    rest = [c for c in stats.columns if c not in STATS]
    shared = spark.sparkContext.broadcast(model)
    order = stats.select(*rest, *STATS)

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = np.stack([batch.column(len(rest) + k).to_numpy() for k in range(N_STATS)], 1) if batch.num_rows else np.zeros((0, N_STATS))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(rest)], pa.array(shared.value.score(s))], names=[*rest, "score"])

    return order.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in order.schema.fields[: len(rest)]) + ", score double")


def quality(spark: SparkSession, docs: DataFrame, labels: DataFrame, held_out, threshold: float = 0.3, label_col: str = "quality") -> DataFrame:
    """doc_id, held_out, score, predicted for each row of docs; labels of rows for which held_out holds are not learned.

    Null and empty texts are scored by their (zero) statistics. Rows of labels with a null id or label are ignored, and of
    several labels of one id the least is learned; a repeated document is learned as often as it stands. A null id is
    scored but not learned from. Other columns are ignored, whatever their names; an empty table gives an empty one.
    """
    stats = materialise(spark, stats_table(docs).withColumn("held_out", held_out), "stats")
    known = labels.where(f"doc_id IS NOT NULL AND {label_col} IN (0, 1)").groupBy("doc_id").agg(F.min(label_col).alias("label"))
    model = fit(spark, stats.where("NOT held_out").join(known, "doc_id"))
    return scored(spark, stats, model).withColumn("predicted", (F.col("score") >= threshold).cast("int"))
