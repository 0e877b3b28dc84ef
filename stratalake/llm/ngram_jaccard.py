"""N-gram Jaccard join by grouped prefixes.

Every text becomes the set of its distinct word shingles (64-bit hashes). Two texts link when
100 * |A & B| >= percent * |A | B|. The steps, all distributed:

1. count each shingle over the whole corpus (42 bits of the hash, counted in packed partitions) and fold the counts into
   tables of a fixed size: levels, and a bit for those that several texts have, which tells the others apart also where every level
   is taken; rare shingles come first in the order (level, hash). Any order gives right results;
2. compute each text's set size, set key and prefix: the first n - ceil(t n) + 1 shingles in that order;
3. texts with one set form a class, classes with one prefix and size form a group;
4. prefix shingles that one group alone has (those of exact copies) are left out by a filter of a fixed size; groups that share a prefix shingle and fit by size, directly or through others, form a family (components over edges
   that are linear in the number of postings); every linked pair lies in one family;
5. families are split into blocks of bounded classes and shingles by size band and salt; each pair of blocks filters pairs
   of groups by their prefixes and sizes, expands the groups that are left to their members, and verifies the members'
   whole sets by matrix products.

Only links inside one pair of blocks are known to a task, and it emits a spanning forest of them and their number per
class. A class of a family of many blocks is sent once to each block that it meets, so for such families rows grow with
the number of blocks and arithmetic with its square; pairs are never written.
Classes go by numbers of their own, not by ids: an id may stand on rows of different texts.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalake.llm.common import WHITE_SPACE, discard, hash_words, hot_rows, join_counted, materialise, mix, release, shingle_hashes, spans, text_buffer, tidy, word_mask
from stratalake.llm.components import connected_components, contracted

#: Bytes of texts, or of prefixes, that are worked on at a time.
CHUNK = 1 << 18
#: The table of levels has so many bits of slots, a byte each, whatever the corpus.
SLOT_BITS = 24
#: The same for the filter of texts whose whole sets are needed, a bit each.
FILTER_BITS = 24
#: The same for the shingles that several texts have and for the prefix shingles that several groups have, a bit each.
SHARED_BITS, SEVERAL_BITS = 27, 25
#: Parts that the counts are dealt into, by the first bits of the hash: a part has at most 1 << (32 - PART_BITS) shingles.
PART_BITS = 10
#: Hashes that are held before they are counted and put out.
HELD = 1 << 20
#: Posting lists up to this length give their pairs, longer ones a chain.
SHORT = 24
#: Classes of a block, and shingles of their sets.
BLOCK, BLOCK_SHINGLES = 1024, 1 << 19
#: Pairs of entries that are counted one by one at a time.
PAIRS = 1 << 20


def _sets(batch_text: pa.Array, size: int) -> Iterator[tuple[int, list[np.ndarray]]]:
    """For spans of rows: (first row, the sorted distinct shingle hashes of each row)."""
    data, offsets = text_buffer(batch_text)
    inside = word_mask(WHITE_SPACE)
    for a, b in spans(offsets, CHUNK):
        words, counts = hash_words(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], inside)
        h, o = shingle_hashes(words, counts, size)
        yield a, [np.unique(h[o[i] : o[i + 1]]) for i in range(b - a)]


def _top(hashes: np.ndarray, slots: int) -> np.ndarray:
    """The hashes' slots of a power of two: their top bits."""
    return (hashes >> np.uint64(65 - slots.bit_length())).astype(np.int64)


def _bit(table: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Whether the bits of the hashes' slots are set."""
    at = _top(hashes, 8 * len(table))
    return (table[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1).astype(bool)


def _level(tables: tuple[np.ndarray, np.ndarray], hashes: np.ndarray) -> np.ndarray:
    """The hashes' levels; 0 if one text alone has the shingle."""
    levels, shared = tables
    return np.where(_bit(shared, hashes), levels[_top(hashes, len(levels))], 0)


def _levels(spark: SparkSession, docs: DataFrame, size: int, part_bits: int = PART_BITS) -> tuple[np.ndarray, np.ndarray]:
    """Of the slots, the top SLOT_BITS and SHARED_BITS bits of a hash: the greatest level (log2 of the number of texts), and bits that
    are set where a shingle has two texts or more."""
    n_parts = 1 << part_bits

    @tidy
    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(held: list[np.ndarray]) -> pa.RecordBatch:
            keys, counts = np.unique(np.concatenate(held) >> np.uint64(32 - part_bits), return_counts=True)
            cut = np.searchsorted((keys >> np.uint64(32)).astype(np.int64), np.arange(n_parts + 1))
            keys = keys.astype(np.uint32)  # the next 32 bits; a part's own are its number
            rows = [(p, keys[i:j].tobytes(), c.astype(np.uint32).tobytes() if (c := counts[i:j]).max() > 1 else None) for p in range(n_parts) if (i := cut[p]) < (j := cut[p + 1])]
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary()), pa.array([r[2] for r in rows], pa.binary())], names=["part", "keys", "counts"])

        held, n = [], 0
        for batch in batches:
            for _, sets in _sets(batch.column(0), size):
                held += [s for s in sets if len(s)]
                n += sum(map(len, sets))
                if n >= HELD:
                    yield flush(held)
                    held, n = [], 0
        if held:
            yield flush(held)

    @tidy
    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # rows come part by part; what is held of one is merged as it comes, so it has no more than a part's shingles twice
        part, held, n = -1, [], 0

        def merge() -> tuple[np.ndarray, np.ndarray]:
            k, c = (np.concatenate(x) for x in zip(*held, strict=True))
            order = np.argsort(k, kind="stable")
            k, c = k[order], c[order]
            first = np.flatnonzero(np.r_[True, k[1:] != k[:-1]])
            return k[first], np.add.reduceat(c, first)

        def levels() -> pa.RecordBatch:
            k, total = merge()
            table = np.zeros(1 << (SLOT_BITS - part_bits), np.uint8)
            np.maximum.at(table, k.astype(np.int64) >> (32 - SLOT_BITS + part_bits), np.log2(total).astype(np.uint8))
            shared = np.zeros(1 << (SHARED_BITS - part_bits), bool)
            shared[k[total > 1].astype(np.int64) >> (32 - SHARED_BITS + part_bits)] = True
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), *(pa.array([x.tobytes()], pa.binary()) for x in (table, np.packbits(shared)))], names=["part", "levels", "shared"])

        for batch in batches:
            for p, keys, counts in zip(*(batch.column(i) for i in range(3)), strict=True):
                if p.as_py() != part:
                    if held:
                        yield levels()
                    part, held, n = p.as_py(), [], 0
                k = np.frombuffer(keys.as_py(), np.uint32)
                held.append((k, np.frombuffer(counts.as_py(), np.uint32).astype(np.int64) if counts.is_valid else np.ones(len(k), np.int64)))
                n += len(k)
                if n > max(HELD, 2 * len(held[0][0])):
                    held = [merge()]
                    n = len(held[0][0])
        if held:
            yield levels()

    counted = docs.select("text").mapInArrow(packed, "part int, keys binary, counts binary")
    found = counted.repartition("part").sortWithinPartitions("part").mapInArrow(merged, "part int, levels binary, shared binary")
    table, shared = np.zeros((n_parts, 1 << (SLOT_BITS - part_bits)), np.uint8), np.zeros((n_parts, 1 << (SHARED_BITS - part_bits - 3)), np.uint8)
    for row in found.toLocalIterator():  # one row a part, 2 ** SLOT_BITS bytes and 2 ** SHARED_BITS bits in all
        table[row["part"]] = np.frombuffer(row["levels"], np.uint8)
        shared[row["part"]] = np.frombuffer(row["shared"], np.uint8)
    return table.reshape(-1), shared.reshape(-1)


def _several(prefixes: DataFrame, levels, part_bits: int = PART_BITS) -> np.ndarray:
    """A bit for each slot, the top SEVERAL_BITS bits of a hash: set if any first 32 bits in it stand in the prefixes twice or more."""
    n_parts, per_part = 1 << part_bits, 1 << (32 - part_bits)

    @tidy
    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(held: list[np.ndarray]) -> pa.RecordBatch:
            keys = np.sort(np.concatenate(held))
            cut = np.searchsorted(keys >> np.uint32(32 - part_bits), np.arange(n_parts + 1))
            rows = [(p, keys[i:j].tobytes()) for p in range(n_parts) if (i := cut[p]) < (j := cut[p + 1])]
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], names=["part", "keys"])

        held, n = [], 0
        for batch in batches:
            data, offsets = text_buffer(batch.column(0))
            for a, b in spans(offsets, CHUNK):
                tokens = np.frombuffer(data[offsets[a] : offsets[b]].tobytes(), np.uint64)
                tokens = tokens[_level(levels.value, tokens) > 0]
                held.append((tokens >> np.uint64(32)).astype(np.uint32))
                n += len(tokens)
                if n >= HELD:
                    yield flush(held)
                    held, n = [], 0
        if n:
            yield flush(held)

    @tidy
    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # rows come part by part; a part needs two tables of all its keys, whatever it holds
        part, once, twice = -1, np.zeros(per_part, bool), np.zeros(per_part, bool)

        def slots() -> pa.RecordBatch:
            bits = np.packbits(twice.reshape(-1, 1 << (32 - SEVERAL_BITS)).any(1))
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([bits.tobytes()], pa.binary())], names=["part", "bits"])

        for batch in batches:
            for p, keys in zip(batch.column(0), batch.column(1), strict=True):
                if p.as_py() != part:
                    if part >= 0:
                        yield slots()
                    part = p.as_py()
                    once[:], twice[:] = False, False
                k = np.frombuffer(keys.as_py(), np.uint32) & np.uint32(per_part - 1)
                twice[k[1:][k[1:] == k[:-1]]] = True
                twice[k[once[k]]] = True
                once[k] = True
        if part >= 0:
            yield slots()

    found = prefixes.select("prefix").mapInArrow(packed, "part int, keys binary").repartition("part").sortWithinPartitions("part").mapInArrow(merged, "part int, bits binary")
    table = np.zeros((n_parts, 1 << (SEVERAL_BITS - part_bits - 3)), np.uint8)
    for row in found.toLocalIterator():  # one row a part, 2 ** SEVERAL_BITS bits in all
        table[row["part"]] = np.frombuffer(row["bits"], np.uint8)
    return table.reshape(-1)


def prefix_length(n: int, percent: int) -> int:
    """How many of a set's first shingles a linked set must share one of."""
    return n - -(-percent * n // 100) + 1 if n else 0


def _key(s: np.ndarray) -> tuple[int, int]:
    a, b = mix(s), mix(s ^ np.uint64(0x5851F42D4C957F2D))
    return int(a.sum().view(np.int64) if len(s) else 0), int(np.bitwise_xor.reduce(b).view(np.int64) if len(s) else 0)


def _overlap(rows: list[np.ndarray], cols: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of each row's with each column's values."""
    out = np.zeros((len(rows), len(cols)), np.float32)
    if not rows or not cols:
        return out
    ra, ca = np.concatenate(rows), np.concatenate(cols)
    ri, ci = np.repeat(np.arange(len(rows)), [len(x) for x in rows]), np.repeat(np.arange(len(cols)), [len(x) for x in cols])
    values, at = np.unique(np.concatenate([ra, ca]), return_inverse=True)
    rv, cv = at[: len(ra)], at[len(ra) :]
    nr, nc = np.bincount(rv, minlength=len(values)), np.bincount(cv, minlength=len(values))
    # what only a row has doesn't count; in a block against itself every value is on both sides, and counts from two rows on
    useful = (nr > 0) & (nc > 0) & ((nr > 1) | (nc > 1) | (rows is not cols))
    name = np.cumsum(useful) - 1
    rk, ck = useful[rv], useful[cv]
    rv, ri, cv, ci = name[rv[rk]], ri[rk], name[cv[ck]], ci[ck]
    r_order, c_order = np.argsort(rv, kind="stable"), np.argsort(cv, kind="stable")
    rv, ri, cv, ci = rv[r_order], ri[r_order], cv[c_order], ci[c_order]
    nr, nc = nr[useful].astype(np.int64), nc[useful].astype(np.int64)
    # up to each value, the pairs of entries that share one
    work = np.concatenate([[0], np.cumsum(nr * nc)])
    a = 0
    while a < len(nr):
        b = min(a + 4096, len(nr))
        few = (work[b] - work[a]) * 40 < len(rows) * len(cols) * (b - a)
        if few:
            b = min(b, max(a + 1, int(np.searchsorted(work, work[a] + PAIRS, "right")) - 1))
        i, j = np.searchsorted(rv, [a, b])
        k, m = np.searchsorted(cv, [a, b])
        r, c = nr[a:b], nc[a:b]
        if few:
            each = np.repeat(c, r)  # partners of each entry of the rows
            first = np.repeat(np.cumsum(c) - c, r)
            partner = np.arange(each.sum()) - np.repeat(np.cumsum(each) - each - first, each)
            at = np.repeat(ri[i:j], each) * len(cols) + ci[k:m][partner]
            out += np.bincount(at, minlength=out.size).reshape(out.shape)
        else:
            x, y = np.zeros((len(rows), b - a), np.float32), np.zeros((len(cols), b - a), np.float32)
            x[ri[i:j], rv[i:j] - a] = 1
            y[ci[k:m], cv[k:m] - a] = 1
            out += x @ y.T
        a = b
    if rows is cols:
        np.fill_diagonal(out, [len(x) for x in rows])
    return out


def _verify(percent: int):
    """For one pair of blocks: filter group pairs by prefix and size, expand, verify."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        same = bool(pdf["same"].iloc[0])
        left = pdf[pdf["side"] == 0].reset_index(drop=True)
        right = left if same else pdf[pdf["side"] == 1].reset_index(drop=True)
        none = pd.DataFrame({"u": pd.Series(dtype="int64"), "v": pd.Series(dtype="int64"), "degree": pd.Series(dtype="int64")})
        if not len(left) or not len(right):
            return none
        read = lambda column: [np.frombuffer(x, np.uint64) for x in column]
        lg, rg = left.drop_duplicates("group_no"), right.drop_duplicates("group_no")
        ln, rn = lg["n"].to_numpy()[:, None], rg["n"].to_numpy()[None, :]
        fits = (100 * np.minimum(ln, rn) >= percent * np.maximum(ln, rn)) & (_overlap(lp := read(lg["prefix"]), lp if same else read(rg["prefix"])) > 0)
        if same:  # a group's own members are candidates; alone in its group, a class isn't one
            fits &= ~np.eye(len(lg), dtype=bool) | (left.groupby("group_no")["class_no"].nunique().reindex(lg["group_no"]).to_numpy() > 1)[:, None]
        kept_l, kept_r = set(lg["group_no"].to_numpy()[fits.any(1)]), set(rg["group_no"].to_numpy()[fits.any(0)])
        left, right = left[left["group_no"].isin(kept_l)].reset_index(drop=True), right[right["group_no"].isin(kept_r)].reset_index(drop=True)
        if not len(left) or not len(right):
            return none
        both = _overlap(ls := read(left["shingles"]), ls if same else read(right["shingles"]))
        either = left["n"].to_numpy()[:, None] + right["n"].to_numpy()[None, :] - both
        linked = 100 * both >= percent * either
        a, b = left["class_no"].to_numpy(), right["class_no"].to_numpy()
        if same:
            linked &= a[:, None] != b[None, :]
        da, db = linked @ right["copies"].to_numpy(), linked.T @ left["copies"].to_numpy()
        # a spanning forest of the links is enough for components
        parent: dict[int, int] = {}

        def root(x: int) -> int:
            while parent.setdefault(x, x) != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        tree = []
        for i, j in zip(*np.nonzero(np.triu(linked) if same else linked), strict=True):
            x, y = root(int(a[i])), root(int(b[j]))
            if x != y:
                parent[max(x, y)] = min(x, y)
                tree.append((int(a[i]), int(b[j])))
        u, v = [x for x, _ in tree], [y for _, y in tree]
        if both.size > 1 << 16:
            release()
        # rows with v null carry the number of links that this pair of blocks found for u
        ends = [(int(x), int(d)) for x, d in zip(a, da, strict=True) if d] + ([] if same else [(int(x), int(d)) for x, d in zip(b, db, strict=True) if d])
        return pd.DataFrame({"u": pd.Series(u + [x for x, _ in ends], dtype="Int64"), "v": pd.Series(v + [None] * len(ends), dtype="Int64"), "degree": pd.Series([0] * len(u) + [d for _, d in ends], dtype="Int64")})

    return run


def jaccard_components(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 4, percent: int = 85) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id, class_id, class_size, n_links, text_hash (xxhash64 of the text).

    component_id is the least id reachable by links, the row's own included; class_id the least id with the same set;
    n_links the number of other rows that link to it directly. Words are runs of non-white-space, A-Z lowered.
    Null and empty texts and texts of white space have no shingles, link with nothing and are their own component.
    Repeated rows are rows of their own with the same set; rows of one id with different texts are rows of different sets, and
    class_id doesn't tell such sets apart. Rows with a null id take no part: their component is null.
    Other columns are ignored, whatever their names; an empty table gives an empty one.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    levels = spark.sparkContext.broadcast(_levels(spark, docs, size))

    def ordered(s: np.ndarray) -> np.ndarray:
        level = _level(levels.value, s)
        return s[np.argsort(level, kind="stable")] if level.any() else s

    @tidy
    def signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, sets in _sets(batch.column(1), size):
                keys = [_key(s) for s in sets]
                prefixes = [ordered(s)[: prefix_length(len(s), percent)].tobytes() for s in sets]
                columns = [pa.array([len(s) for s in sets], pa.int64()), *(pa.array([k[i] for k in keys], pa.int64()) for i in (0, 1)), pa.array(prefixes, pa.binary())]
                rows = batch.slice(a, len(sets))
                yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(2), *columns], names=["doc_id", "text_hash", "n", "k1", "k2", "prefix"])

    key = ["n", "k1", "k2"]
    whole = materialise(spark, docs.select("*", F.xxhash64("text").alias("text_hash")).mapInArrow(signatures, "doc_id long, text_hash long, n long, k1 long, k2 long, prefix binary"), "whole-sig")
    discard(spark)
    # prefixes are dealt out once; elsewhere two hashes stand for them
    hashes = F.xxhash64("prefix").alias("p1"), F.xxhash64(F.lit("prefix"), "prefix").alias("p2")
    sig = materialise(spark, whole.select("doc_id", "text_hash", *key, *hashes), "sig")
    classes = sig.where("n > 0 AND doc_id IS NOT NULL").groupBy(*key).agg(F.min("doc_id").alias("class_id"), F.count(F.lit(1)).alias("copies"), F.max("p1").alias("p1"), F.max("p2").alias("p2"))
    # written once, so the numbers stay
    numbered = materialise(spark, classes.withColumn("class_no", F.monotonically_increasing_id()), "numbered")
    groups = numbered.groupBy("n", "p1", "p2").agg(F.min("class_no").alias("group_no"))
    classes = materialise(spark, numbered.join(groups, ["n", "p1", "p2"]).drop("p1", "p2"), "classes")
    first = classes.where("group_no = class_no").select(F.col("class_id").alias("doc_id"), *key, "group_no")
    prefixes = whole.select("doc_id", *key, "prefix").join(first, ["doc_id", *key]).dropDuplicates(["doc_id", *key, "group_no"])
    prefixes = materialise(spark, prefixes.select("group_no", "n", "prefix"), "prefixes")
    discard(spark, whole, numbered)
    several = spark.sparkContext.broadcast(_several(prefixes, levels))
    discard(spark)

    @tidy
    def postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_buffer(batch.column(2))
            for a, b in spans(offsets, CHUNK):
                many = np.diff(offsets[a : b + 1]) // 8
                place = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
                tokens = np.frombuffer(data[offsets[a] : offsets[b]].tobytes(), np.uint64)
                # at level 0 no other text has the shingle, in a slot without its bit no other group's prefix
                some = (_level(levels.value, tokens) > 0) & _bit(several.value, tokens)
                columns = [pa.array(tokens[some].view(np.int64)), *(pa.array(np.repeat(batch.column(i).slice(a, b - a).to_numpy(), many)[some], pa.int64()) for i in (0, 1)), pa.array(place[some].astype(np.int32))]
                yield pa.RecordBatch.from_arrays(columns, names=["token", "group_no", "n", "place"])

    # a little wider than the ratio, so that rounding never puts a linked pair two bands apart
    band = F.floor(F.log(F.col("n").cast("double")) / F.lit(max(1e-4, 1.001 * math.log(100 / percent)))).cast("int")
    posted = prefixes.mapInArrow(postings, "token long, group_no long, n long, place int")
    shared = materialise(spark, posted.groupBy("token").agg(F.count(F.lit(1)).alias("df")).where("df > 1"), "shared")
    common = shared.where(F.col("df") > hot_rows(shared, "df")).select("token")
    listed = posted.join(shared.select("token"), "token").join(F.broadcast(common), "token", "left_anti")
    # written here: two Python functions in one stage would take two workers a core, which stay for all later stages
    near = materialise(spark, listed.repartition("token").sortWithinPartitions("token", "n", "group_no").mapInArrow(_near(percent), "u long, v long"), "near")
    edges = near
    if not common.isEmpty():
        # the groups of a very common shingle aren't gathered: each size band's are joined to its least one, and the bands' least ones to each other
        spread = posted.join(F.broadcast(common), "token").withColumn("band", band)
        least = materialise(spark, spread.groupBy("token", "band").agg(F.min("group_no").alias("u"), F.count(F.lit(1)).alias("members")), "least")
        stars = join_counted(spread.select("token", "band", "group_no"), least, ["token", "band"], ["group_no"], "members").select("u", F.col("group_no").alias("v"))
        above = least.select("token", (F.col("band") - 1).alias("band"), F.col("u").alias("v"))
        near = near.unionByName(stars).unionByName(least.join(above, ["token", "band"]).select("u", "v"))
    families = connected_components(spark, near).select(F.col("node").alias("group_no"), F.col("component").alias("family"))
    discard(spark, prefixes, shared, edges)
    # a group of several classes is a family even where no other group is near it
    crowded = classes.groupBy("group_no").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("group_no")
    families = families.unionByName(crowded.join(families, "group_no", "left_anti").select("group_no", F.col("group_no").alias("family")))
    members = materialise(spark, classes.join(families, "group_no").withColumn("band", band), "members")
    sets = _whole_sets(spark, docs, members, size, percent, ordered).dropDuplicates(["doc_id", *key]).withColumnRenamed("doc_id", "class_id")

    found = materialise(spark, _dealt(spark, members, sets).groupBy("family", "b1", "s1", "b2", "s2").applyInPandas(_verify(percent), "u long, v long, degree long"), "links")
    discard(spark, members)
    comps = connected_components(spark, found.where("v IS NOT NULL").select("u", "v")).select(F.col("node").alias("class_no"), "component")
    discard(spark)
    least = materialise(spark, comps.join(classes.select("class_no", "class_id"), "class_no").groupBy("component").agg(F.min("class_id").alias("component_id"), F.count(F.lit(1)).alias("members")), "least")
    comps = join_counted(comps, least, ["component"], ["class_no"], "members").select("class_no", "component_id")
    degrees = found.where("v IS NULL").groupBy(F.col("u").alias("class_no")).agg(F.sum("degree").alias("degree"))
    named = classes.select(*key, "class_no", "class_id", "copies").join(comps, "class_no", "left").join(degrees, "class_no", "left")
    named = materialise(spark, named.select(*key, "class_id", "component_id", "degree", F.col("copies").alias("class_size"), "copies"), "named")
    out = join_counted(sig.select("doc_id", "text_hash", *key), named, key, ["doc_id"], "copies", "left")
    linked = F.col("class_id").isNotNull() & F.col("doc_id").isNotNull()
    return out.select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.when(linked, F.coalesce("component_id", "class_id")).otherwise(F.col("doc_id")).alias("component_id"),
        F.when(linked, F.col("class_id")).otherwise(F.col("doc_id")).alias("class_id"),
        F.when(linked, F.col("class_size")).otherwise(1).alias("class_size"),
        F.when(linked, F.col("class_size") - 1 + F.coalesce("degree", F.lit(0))).otherwise(0).alias("n_links"),
        "text_hash",
    )


def _near(percent: int):
    """Edges between groups of one posting list (rows sorted by token and size) that may link.

    A short list gives its pairs that fit by size and by the places of the shared shingle. A long one gives a chain of
    neighbours in order of size: it joins all that fit by size, and is linear. Of a task's edges, stars are left that join the same groups.
    """

    def edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carry = None
        for batch in batches:
            t, g, n, p = (batch.column(i).to_numpy() for i in range(4))
            if carry is not None:
                t, g, n, p = (np.concatenate([x, y]) for x, y in zip(carry, (t, g, n, p), strict=True))
            # the last SHORT rows of an open list wait for the next batch; what is linked twice does no harm
            at = max(int(np.searchsorted(t, t[-1])), len(t) - SHORT) if len(t) else 0
            carry = tuple(x[at:] for x in (t, g, n, p))
            begin = np.searchsorted(t, t)
            size = np.searchsorted(t, t, "right") - begin
            us, vs = [], []
            for k in range(1, min(SHORT, len(t))):
                ok = (t[k:] == t[:-k]) & (100 * n[:-k] >= percent * n[k:])
                if k > 1:
                    ok &= size[k:] <= SHORT
                least = -(-percent * (n[k:] + n[:-k]) // (100 + percent))
                bound = np.minimum(p[k:], p[:-k]) + np.minimum(n[k:] - p[k:], n[:-k] - p[:-k])
                ok &= (bound >= least) | (size[k:] > SHORT)
                us.append(g[k:][ok])
                vs.append(g[:-k][ok])
            if us:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(us), pa.int64()), pa.array(np.concatenate(vs), pa.int64())], names=["u", "v"])

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from contracted(edges(batches))

    return run


def _whole_sets(spark: SparkSession, docs: DataFrame, members: DataFrame, size: int, percent: int, ordered: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """(doc_id, n, k1, k2, prefix, shingles) of the members' texts, and of a few others: a filter of fixed size spares the rest."""
    slot = lambda name: F.pmod(F.xxhash64(name), F.lit(1 << FILTER_BITS)).cast("int")
    # the filter is put together in the cluster, 64 bits a row; its size is fixed, and what it lets through too much is joined away
    words = members.select(slot("class_id").alias("slot")).groupBy(F.shiftright("slot", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, slot & 63)")).alias("bits"))
    table = words.toArrow()
    wanted = np.zeros(1 << (FILTER_BITS - 6), np.int64)
    wanted[table.column("word").to_numpy()] = table.column("bits").to_numpy()
    flags = spark.sparkContext.broadcast(wanted)

    @tidy
    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.column(2).to_numpy()
            batch = batch.filter(pa.array((flags.value[at >> 6] >> (at & 63) & 1).astype(bool)))
            for a, sets in _sets(batch.column(1), size):
                keys = [_key(s) for s in sets]
                prefixes = [ordered(s)[: prefix_length(len(s), percent)].tobytes() for s in sets]
                columns = [pa.array([len(s) for s in sets], pa.int64()), *(pa.array([k[i] for k in keys], pa.int64()) for i in (0, 1)), pa.array(prefixes, pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, len(sets)), *columns], names=["doc_id", "n", "k1", "k2", "prefix", "shingles"])

    return docs.where("doc_id IS NOT NULL").select("doc_id", "text", slot("doc_id").alias("slot")).mapInArrow(whole, "doc_id long, n long, k1 long, k2 long, prefix binary, shingles binary")


def _dealt(spark: SparkSession, members: DataFrame, sets: DataFrame) -> DataFrame:
    """Each member's row once for each pair of blocks that it takes part in: blocks of its size band and of the next ones."""
    sized = members.groupBy("family", "band").agg(F.count(F.lit(1)).alias("m"), F.sum("n").alias("shingles"))
    salts = sized.select("family", "band", "m", F.ceil(F.greatest(F.col("m") / BLOCK, F.col("shingles") / BLOCK_SHINGLES)).cast("int").alias("s"))
    above = salts.select("family", (F.col("band") - 1).alias("band"), F.col("s").alias("s_up"))
    below = salts.select("family", (F.col("band") + 1).alias("band"), F.col("s").alias("s_down"))
    plan = salts.join(above, ["family", "band"], "left").join(below, ["family", "band"], "left").na.fill(0, ["s_up", "s_down"])
    plan = materialise(spark, plan.join(sized.groupBy("family").agg(F.sum("m").alias("m_all")).where("m_all > 1").select("family"), "family"), "blocks")
    many = join_counted(members, plan, ["family", "band"], ["class_no"], "m").withColumn("salt", F.pmod(F.xxhash64("class_no", F.lit(7)), F.col("s")).cast("int"))
    many = many.join(sets, ["class_id", "n", "k1", "k2"])
    b, s = F.col("band"), F.col("salt")
    place = lambda b1, s1, b2, s2, side: F.struct(b1.alias("b1"), s1.alias("s1"), b2.alias("b2"), s2.alias("s2"), side.alias("side"))
    upto = lambda n: F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    own = F.transform(upto(F.col("s")), lambda o: place(b, F.least(s, o), b, F.greatest(s, o), F.when(s <= o, 0).otherwise(1)))
    up = F.transform(upto(F.col("s_up")), lambda o: place(b, s, b + 1, o, F.lit(0)))
    down = F.transform(upto(F.col("s_down")), lambda o: place(b - 1, o, b, s, F.lit(1)))
    dealt = many.select("family", "group_no", "class_no", "n", "copies", "prefix", "shingles", F.explode(F.concat(own, up, down)).alias("p"))
    return dealt.select("*", "p.*").drop("p").withColumn("same", F.expr("b1 = b2 AND s1 = s2"))


def keep_one_per_component(spark: SparkSession, docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """docs without those that aren't of the least id of their component. Rows of one id and one text stay or go together.

    Rows with null ids and rows without words all stay, as they link with nothing that has an id.
    """
    found = jaccard_components(spark, docs, size=size, percent=percent)
    gone = found.where("n_shingles > 0 AND doc_id IS NOT NULL AND doc_id <> component_id").select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash")).distinct()
    return docs.join(gone, (F.col("doc_id").cast("long") == F.col("__id")) & (F.xxhash64("text") == F.col("__hash")), "left_anti")
