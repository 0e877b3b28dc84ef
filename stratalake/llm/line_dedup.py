"""Line dedup by a suffix array over line identifiers, built by distributed prefix doubling. DataFrame operations only.

The corpus is read in the order (doc_id, hash of text, line). Every line that is not blank has an identifier; the order-keeping
rank of its suffix at depth 1, 2, 4, ... comes from the sorted distinct pairs of ranks at half the depth, as in prefix
doubling. Suffixes that are alone in their interval drop out of the next round. A run qualifies by its words, and as each line
has a word, min_words lines are always enough: the suffix array is ordered up to that depth, and a longer order couldn't change
which lines go. Suffixes of equal ranks over n lines are an interval of the array whose longest common prefix has n lines.

A maximal repeated run is the union of its least windows: from each of its lines on the fewest lines that hold min_words, and
up to each of its lines the fewest lines back that do. (A line so near the run's end that the first kind doesn't fit lies in
the second kind's window of the last line.) A window is in an interval with an earlier member just if it lies in a repeated
run, so all lines of the intervals' later members are deleted, and these are all lines of later copies of maximal runs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stratalake.llm.common import join_counted, materialise

MIN_WORDS = 10
#: What a word of a line is made of: anything but blanks, tabs and the other signs that white space of one line has.
WORD = r"[^ \t\x0B\f\r]+"


def _named(spark: SparkSession, pairs: DataFrame, keys: list[str], name: str) -> DataFrame:
    """(keys, members, rank) of the key values that occur at least twice, ranks in the order of the keys."""
    again = pairs.groupBy(*keys).agg(F.count(F.lit(1)).alias("members")).where("members > 1")
    # after a range sort, the ids of the partitions' rows rise with the keys; the table is written once, so they stay
    return materialise(spark, again.orderBy(*keys).withColumn(name, F.monotonically_increasing_id()), "ranks")


def _words(line: Column) -> Column:
    """The number of a line's words: blanks + 1 where single blanks are its only white space, which most lines have."""
    odd = line.startswith(" ") | line.endswith(" ") | (line == "")
    for sign in ("  ", "\t", "\x0b", "\f", "\r"):
        odd |= line.contains(sign)
    return F.when(odd, F.regexp_count(line, F.lit(WORD))).otherwise(F.length(line) - F.length(F.replace(line, F.lit(" "), F.lit(""))) + 1)


def repeated_runs(spark: SparkSession, docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(did, mark, runs): for each text with later copies, its maximal runs of lines to delete as sorted (start, length) structs.

    docs has did (the id, the least long for null), mark (a hash of the text) and text.
    """
    doc = ["did", "mark"]
    lines = docs.select(*doc, F.posexplode(F.split("text", "\n", -1)).alias("i", "line")).withColumn("w", _words(F.col("line"))).where("w > 0")
    lines = lines.select(*doc, "i", "w", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit("line"), "line").alias("h2"))
    in_doc = Window.partitionBy(*doc).orderBy("i")
    # rows of repeated documents (equal id and text) are one document
    lines = lines.withColumn("again", F.coalesce(F.lag("i").over(in_doc) == F.col("i"), F.lit(False))).where("NOT again").drop("again")
    lines = materialise(spark, lines.withColumn("k", F.row_number().over(in_doc)), "lines")
    first = _named(spark, lines, ["h1", "h2"], "r1")
    at = materialise(spark, join_counted(lines, first, ["h1", "h2"], [*doc, "k"], "members").select(*doc, "i", "k", "w", "r1"), "depth")
    by_line = Window.partitionBy(*doc).orderBy("k")
    depth = 1
    depths = [1]
    while depth * 2 <= min_words:
        a, b = f"r{depth}", f"r{depth * 2}"
        after = F.when(F.lead("k", depth).over(by_line) == F.col("k") + depth, F.lead(a, depth).over(by_line))
        paired = at.withColumn("after", after)
        names = _named(spark, paired.where(f"{a} IS NOT NULL AND after IS NOT NULL").select(F.col(a).alias("x"), F.col("after").alias("y")), ["x", "y"], b)
        paired = paired.withColumns({"x": F.col(a), "y": F.col("after")}).drop("after")
        at = materialise(spark, join_counted(paired, names, ["x", "y"], [*doc, "k"], "members", "left").drop("x", "y"), "depth")
        depth *= 2
        depths.append(depth)
    ranks = F.struct("k", "i", "w", *(f"r{d}" for d in depths))
    # min_words lines are always enough to reach min_words words; ahead and behind go from the line itself on
    both = at.withColumn("ahead", F.collect_list(ranks).over(by_line.rowsBetween(0, min_words - 1)))
    both = both.withColumn("behind", F.reverse(F.collect_list(ranks).over(by_line.rowsBetween(1 - min_words, 0))))
    reach = lambda side: F.expr(f"aggregate({side}, (0 AS n, 0 AS w), (s, x) -> IF(s.w >= {min_words}, s, (s.n + 1 AS n, s.w + x.w AS w)))")
    both = both.withColumns({"fore": reach("ahead"), "back": reach("behind")})
    # a window's lines in order; the lines between must have ranks too, which the places k tell
    fore = F.when((F.col("fore.w") >= min_words) & (F.expr("ahead[fore.n - 1].k") == F.col("k") + F.col("fore.n") - 1), F.slice("ahead", F.lit(1), F.col("fore.n")))
    back = F.when((F.col("back.w") >= min_words) & (F.expr("behind[back.n - 1].k") == F.col("k") - F.col("back.n") + 1), F.reverse(F.slice("behind", F.lit(1), F.col("back.n"))))
    windows = both.select(*doc, F.explode(F.array_compact(F.array_distinct(F.array(fore, back)))).alias("window")).withColumn("n", F.size("window"))
    left, right = _ends(depths)
    seen = windows.select(*doc, F.col("window")[0]["k"].alias("k"), "n", left.alias("a"), right.alias("b"), F.col("window.i").alias("is")).where("a IS NOT NULL AND b IS NOT NULL")
    place = F.struct("did", "mark", "k")
    interval = seen.groupBy("n", "a", "b").agg(F.min(place).alias("head"), F.count(F.lit(1)).alias("members")).where("members > 1")
    interval = materialise(spark, interval, "intervals")
    later = join_counted(seen, interval, ["n", "a", "b"], [*doc, "k"], "members").where(place > F.col("head"))
    gone = later.select(*doc, F.explode("is").alias("i")).distinct()
    island = gone.withColumn("island", F.col("i") - F.row_number().over(in_doc))
    runs = island.groupBy(*doc, "island").agg(F.min("i").alias("start"), F.count(F.lit(1)).cast("int").alias("length"))
    return runs.groupBy(*doc).agg(F.sort_array(F.collect_list(F.struct("start", "length"))).alias("runs"))


def _ends(depths: list[int]) -> tuple[Column, Column]:
    """Ranks of the two halves, which may overlap, of a window of n lines: at the greatest depth within n."""
    left = right = None
    for d in depths:
        here = F.col("n") >= d
        begin, end = F.col("window")[0][f"r{d}"], F.get("window", F.col("n") - d)[f"r{d}"]
        left = F.when(here, begin) if left is None else F.when(here, begin).otherwise(left)
        right = F.when(here, end) if right is None else F.when(here, end).otherwise(right)
    return left, right


def dedup_lines(spark: SparkSession, docs: DataFrame, min_words: int = MIN_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with the later copies of repeated line runs taken out of the text; n_lines, n_deleted and n_left are added.

    A line is deleted if it lies in a run of whole lines with at least min_words words that has an equal run earlier in the
    corpus, in this or another document. Words are what white space sets apart; blank lines (without a word) have no
    identifier: runs go on across them, and they are kept. n_left counts the lines that are neither blank nor deleted.
    A null text stays null with no lines; an empty text has one blank line. Rows with equal id and text are one document and
    get one result; a null id comes first in the order. Columns of the added names are replaced, others are kept; an empty
    table gives an empty one.
    """
    did, mark, kept = "__did", "__mark", [c for c in docs.columns if c not in ("n_lines", "n_deleted", "n_left")]
    base = docs.select(*(F.col(f"`{c}`") for c in kept), F.coalesce(F.col(id_col).cast("long"), F.lit(-(2**63))).alias(did), F.coalesce(F.xxhash64(text_col), F.lit(0)).alias(mark))
    runs = repeated_runs(spark, base.select(F.col(did).alias("did"), F.col(mark).alias("mark"), F.col(text_col).alias("text")).where("text IS NOT NULL"), min_words)
    out = base.join(runs.select(F.col("did").alias(did), F.col("mark").alias(mark), F.col("runs").alias("__runs")), [did, mark], "left")
    out = out.withColumn("__lines", F.split(text_col, "\n", -1))
    # what stands between the runs, sliced once each
    pieces = F.expr(
        "transform(sequence(0, size(__runs)), j -> slice(__lines, "
        "IF(j = 0, 1, __runs[j - 1].start + __runs[j - 1].length + 1), "
        "IF(j = size(__runs), size(__lines), __runs[j].start) - IF(j = 0, 0, __runs[j - 1].start + __runs[j - 1].length)))"
    )
    left = F.when(F.col("__runs").isNull(), F.col("__lines")).otherwise(F.flatten(pieces))
    deleted = F.coalesce(F.aggregate("__runs", F.lit(0), lambda s, r: s + r["length"]), F.lit(0))
    rest = F.size(F.filter("__left", lambda x: F.when(x >= "!", True).otherwise(x.rlike(WORD))))
    given = F.col(text_col).isNotNull()
    out = out.withColumn("__left", left).withColumns({"n_lines": F.when(given, F.size("__lines")).otherwise(0).cast("long"), "n_deleted": deleted.cast("long"), "n_left": F.when(given, rest).otherwise(0).cast("long")})
    out = out.withColumn(text_col, F.when(F.col("__runs").isNull(), F.col(text_col)).otherwise(F.array_join("__left", "\n")))
    return out.select(*(f"`{c}`" for c in kept), "n_lines", "n_deleted", "n_left")


#: DuckDB twin for tables whose ids are distinct and not null.
SQL = rf"""
WITH l AS (
  SELECT doc_id, generate_subscripts(a, 1) - 1 AS i, unnest(a) AS line
  FROM (SELECT doc_id, string_split(text, chr(10)) AS a FROM documents)
), s AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS k
  FROM (SELECT *, len(regexp_extract_all(line, '{WORD}')) AS w FROM l) WHERE w > 0
), near AS (
  SELECT doc_id, k, list(line) OVER f AS fl, list(w) OVER f AS fw, list(i) OVER f AS fi, list(line) OVER b AS bl, list(w) OVER b AS bw, list(i) OVER b AS bi
  FROM s WINDOW f AS (PARTITION BY doc_id ORDER BY k ROWS BETWEEN CURRENT ROW AND {MIN_WORDS - 1} FOLLOWING),
                b AS (PARTITION BY doc_id ORDER BY k ROWS BETWEEN {MIN_WORDS - 1} PRECEDING AND CURRENT ROW)
), win AS (
  SELECT doc_id, k, fi[1:n] AS gone, fl[1:n] AS ls
  FROM (SELECT *, list_min(list_filter(range(1, len(fw) + 1), lambda n: list_sum(fw[1:n]) >= {MIN_WORDS})) AS n FROM near) WHERE n IS NOT NULL
  UNION
  SELECT doc_id, k - n + 1 AS k, bi[len(bi) - n + 1:len(bi)] AS gone, bl[len(bl) - n + 1:len(bl)] AS ls
  FROM (SELECT *, list_min(list_filter(range(1, len(bw) + 1), lambda n: list_sum(bw[len(bw) - n + 1:len(bw)]) >= {MIN_WORDS})) AS n FROM near) WHERE n IS NOT NULL
), named AS (
  SELECT doc_id, k, gone, row_number() OVER (PARTITION BY array_to_string(ls, chr(10)) ORDER BY doc_id, k) AS nth FROM win
), gone AS (SELECT DISTINCT doc_id, unnest(gone) AS i FROM named WHERE nth > 1),
kept AS (
  SELECT l.doc_id, string_agg(l.line, chr(10) ORDER BY l.i) FILTER (g.i IS NULL) AS text, count(*) AS n_lines, count(g.i) AS n_deleted,
         count(*) FILTER (g.i IS NULL AND regexp_matches(l.line, '{WORD}')) AS n_left
  FROM l LEFT JOIN gone g ON l.doc_id = g.doc_id AND l.i = g.i GROUP BY l.doc_id
)
SELECT doc_id, coalesce(text, '') AS text, n_lines, n_deleted, n_left FROM kept
"""
