"""Differential reports: what a change introduced, fixed and left, with path filters and renamed files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

STATUSES = ("introduced", "fixed", "preexisting")


def report_diff(current: DataFrame, previous: DataFrame, key: str = "hash") -> DataFrame:
    """Rows of both reports with a status. Introduced and preexisting rows are the current report's, with its repetitions; fixed
    rows are the previous one's. A null key matches nothing."""
    cur, prev = current.select(key).distinct(), previous.select(key).distinct()
    introduced = current.join(prev, key, "left_anti").withColumn("status", F.lit("introduced"))
    fixed = previous.join(cur, key, "left_anti").withColumn("status", F.lit("fixed"))
    kept = current.join(prev, key, "left_semi").withColumn("status", F.lit("preexisting"))
    return introduced.unionByName(fixed).unionByName(kept)


def only_paths(diff: DataFrame, paths: DataFrame | None, statuses: tuple[str, ...] = STATUSES, file: str = "file") -> DataFrame:
    """Of the given statuses, the rows whose file is among the paths; without paths, and of other statuses, all rows."""
    if paths is None:
        return diff
    named = paths.select(F.col(paths.columns[0]).alias(file)).distinct()
    hit = F.col("status").isin(*statuses)
    return diff.where(~hit).unionByName(diff.where(hit).join(named, file, "left_semi").select(*diff.columns))


def skip_duplicated_types(diff: DataFrame, renames: DataFrame, file: str = "file", kind: str = "bug_type") -> DataFrame:
    """Introduced and fixed rows less those of a type and file (by its old name, if renamed) that the other status has too.

    renames is (current, previous), a file without a row keeps its name.
    """
    old = diff.join(renames.select(F.col("current").alias(file), F.col("previous").alias("__old")), file, "left").withColumn("__old", F.coalesce("__old", file))
    introduced, fixed = old.where("status = 'introduced'"), old.where("status = 'fixed'").withColumn("__old", F.col(file))
    a = introduced.join(fixed.select(kind, "__old").distinct(), [kind, "__old"], "left_anti")
    b = fixed.join(introduced.select(kind, "__old").distinct(), [kind, "__old"], "left_anti")
    return a.unionByName(b).unionByName(old.where("status = 'preexisting'")).select(*diff.columns)


def cost_change(current: DataFrame, previous: DataFrame, key: str = "procedure", on_ui: str | None = None) -> DataFrame:
    """Procedures whose cost's degree changed: increases, and costs that became infinite or unreachable. null degrees are top.

    on_ui names a column of current that says which procedures run on the user interface's thread; their increases are a kind of
    their own. A null there says no.
    """
    ui = F.coalesce(F.col(on_ui), F.lit(False)) if on_ui else F.lit(False)
    both = current.select(key, F.col("degree").alias("now"), ui.alias("__ui")).join(previous.select(key, F.col("degree").alias("before")), key)
    increase = F.when(F.col("__ui"), "COMPLEXITY_INCREASE_UI_THREAD").otherwise("COMPLEXITY_INCREASE")
    kind = F.when(F.col("now").isNull() & F.col("before").isNotNull(), "INFINITE_EXECUTION_TIME").when(F.col("now") < 0, F.when(F.col("before") >= 0, "UNREACHABLE")).when(F.col("now") > F.col("before"), increase)
    return both.withColumn("kind", kind).where("kind IS NOT NULL").select(key, "before", "now", "kind")


def degree_histogram(current: DataFrame, previous: DataFrame, degree: str = "degree") -> DataFrame:
    """(degree, current, previous): how many rows of each side have each degree."""
    c = current.groupBy(degree).agg(F.count(F.lit(1)).alias("current"))
    p = previous.groupBy(degree).agg(F.count(F.lit(1)).alias("previous"))
    return c.join(p, degree, "full_outer").select(degree, F.coalesce("current", F.lit(0)).alias("current"), F.coalesce("previous", F.lit(0)).alias("previous"))


def line_hits(changed: DataFrame, ranges: DataFrame, width: int = 64) -> DataFrame:
    """Changed lines (file, line) joined to ranges (file, start_line, end_line, ...) that hold them.

    An interval join by bins: each range stands in every bin of lines that it touches, so the join is an equi-join.
    """
    binned = ranges.withColumn("__bin", F.explode(F.sequence(F.floor(F.col("start_line") / width), F.floor(F.col("end_line") / width))))
    return changed.withColumn("__bin", F.floor(F.col("line") / width)).join(binned, ["file", "__bin"]).where("line BETWEEN start_line AND end_line").drop("__bin")


def affected_lines(directives: DataFrame, key: str, text: str) -> DataFrame:
    """(key, lines): line numbers that a string of line directives touches.

    O stands for an old line, U for an unchanged and N for a new one. N marks its line and goes on, U goes on and marks its line
    if an O stands right before it, O stays. Only Os mark line 1; nothing marks nothing.
    """
    from pyspark.sql import Window

    c = directives.select(key, F.posexplode(F.split(text, "")).alias("at", "c")).where("c <> ''")
    w = Window.partitionBy(key).orderBy("at")
    line = F.count_if(F.col("c") != "O").over(w.rowsBetween(Window.unboundedPreceding, 0))
    marked = F.when(F.col("c") == "N", True).when(F.col("c") == "U", F.lag("c").over(w) == "O").otherwise(False)
    found = c.select(key, line.alias("line"), F.coalesce(marked, F.lit(False)).alias("hit"), "c").groupBy(key).agg(F.array_sort(F.collect_set(F.when(F.col("hit"), F.col("line")))).alias("lines"), F.bool_and(F.col("c") == "O").alias("old"))
    lines = F.when(F.col("old"), F.array(F.lit(1).cast("long"))).otherwise(F.coalesce("lines", F.array().cast("array<bigint>")))
    return directives.select(key).join(found, key, "left").select(key, F.coalesce(lines, F.array().cast("array<bigint>")).alias("lines"))


def cost_summary(current: DataFrame, previous: DataFrame) -> DataFrame:
    """(kind, current, previous): how many procedures have an unbounded cost (top, a null degree), none (zero) or none that is ever
    reached (unreachable, a negative degree)."""
    both = current.select("degree", F.lit(1).alias("side")).unionByName(previous.select("degree", F.lit(2).alias("side")))
    kinds = {"top": F.col("degree").isNull(), "zero": F.col("degree") == 0, "unreachable": F.col("degree") < 0}
    counts = both.agg(*(F.count_if(is_kind & (F.col("side") == side)).alias(f"{kind}{side}") for kind, is_kind in kinds.items() for side in (1, 2)))
    rows = F.array(*(F.struct(F.lit(k).alias("kind"), F.col(f"{k}1").alias("current"), F.col(f"{k}2").alias("previous")) for k in kinds))
    return counts.select(F.inline(rows))


def in_scope(path, only: list[str] = (), never: list[str] = ()):
    """Whether a path is looked at: it matches one of only, if there are any, and none of never. A null path isn't."""
    wanted, unwanted = F.lit(not only), F.lit(False)
    for p in only:
        wanted = wanted | path.rlike(p)
    for p in never:
        unwanted = unwanted | path.rlike(p)
    return F.coalesce(path.isNotNull() & wanted & ~unwanted, F.lit(False))
