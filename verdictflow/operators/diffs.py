"""Unified diffs as relations: files, hunks, lines.

Line roles follow from running counts: inside a hunk a line is body while fewer old or new lines were seen than its
header announces.  Every step is a window over one case, or a filter; a diff that breaks the counts is an error as a
whole and gives no rows but its error.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

HUNK = r"^@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@(.*)$"


def raw_lines(diffs: DataFrame) -> DataFrame:
    """case_id, pos, raw: lines without their ends; nothing after a final newline."""
    rows = diffs.select("case_id", F.posexplode(F.split("diff", "\n", -1)).alias("pos", "raw"), F.size(F.split("diff", "\n", -1)).alias("n"))
    rows = rows.where((F.col("raw") != "") | (F.col("pos") < F.col("n") - 1))
    return rows.select("case_id", "pos", F.regexp_replace("raw", "\r$", "").alias("raw"))


def strip_path(path: Column) -> Column:
    p = F.btrim(F.substring_index(path, "\t", 1), F.lit('"'))
    return F.regexp_replace(p, "^[ab]/", "")


def classified(diffs: DataFrame) -> DataFrame:
    """Lines with file_id, hunk_id, the hunk's header and their part in it."""
    upto = Window.partitionBy("case_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    df = raw_lines(diffs).withColumn("file_id", F.sum(F.col("raw").startswith("diff --git ").cast("int")).over(upto)).where("file_id > 0")
    in_file = Window.partitionBy("case_id", "file_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    df = df.withColumn("hunk_id", F.sum(F.col("raw").startswith("@@").cast("int")).over(in_file))
    is_head = F.col("raw").startswith("@@")
    number = lambda i, default: F.coalesce(F.nullif(F.regexp_extract("raw", HUNK, i), F.lit("")), F.lit(default)).cast("int")
    good = F.col("raw").rlike(HUNK)
    header = F.when(is_head, F.struct(good.alias("good"), F.when(good, number(1, "0")).alias("old_start"), F.when(good, number(2, "1")).alias("old_count"), F.when(good, number(3, "0")).alias("new_start"), F.when(good, number(4, "1")).alias("new_count"), F.trim(F.regexp_extract("raw", HUNK, 5)).alias("section")))
    hunk = Window.partitionBy("case_id", "file_id", "hunk_id").orderBy("pos")
    df = df.withColumn("is_head", is_head).withColumn("h", F.first(header).over(hunk.rowsBetween(Window.unboundedPreceding, 0)))
    mark = F.substring("raw", 1, 1)
    counted = ~F.col("is_head") & (F.col("hunk_id") > 0)
    df = df.withColumn("o", (counted & (mark.isin("-", " ") | (F.col("raw") == ""))).cast("int")).withColumn("n", (counted & (mark.isin("+", " ") | (F.col("raw") == ""))).cast("int"))
    before = hunk.rowsBetween(Window.unboundedPreceding, -1)
    df = df.withColumn("old_before", F.coalesce(F.sum("o").over(before), F.lit(0)).cast("int")).withColumn("new_before", F.coalesce(F.sum("n").over(before), F.lit(0)).cast("int"))
    body = counted & F.col("h.good") & ((F.col("old_before") < F.col("h.old_count")) | (F.col("new_before") < F.col("h.new_count")))
    kind = F.when(mark == "+", "added").when(mark == "-", "deleted").when((mark == " ") | (F.col("raw") == ""), "context").when(mark == "\\", "marker").otherwise("bad")
    df = df.withColumn("body", F.coalesce(body, F.lit(False))).withColumn("kind", F.when(F.col("body"), kind))
    return _with_error(df, hunk)


def _with_error(lines: DataFrame, hunk: WindowSpec) -> DataFrame:
    """lines with error: what is wrong with the first broken hunk of their case; null if none is."""
    whole = hunk.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    seen = lambda before, own: F.coalesce(F.max(F.when(F.col("body"), F.col(before) + F.col(own))).over(whole), F.lit(0))
    bad = F.coalesce(F.bool_or(F.col("kind") == "bad").over(whole), F.lit(False))
    o, n = seen("old_before", "o"), seen("new_before", "n")
    over = (o > F.col("h.old_count")) | (n > F.col("h.new_count"))
    short = (o < F.col("h.old_count")) | (n < F.col("h.new_count"))
    error = F.when(F.col("hunk_id") > 0, F.when(~F.col("h.good"), "malformed hunk header").when(bad, "bad line prefix").when(over, "hunk overrun").when(short, "truncated hunk"))
    case = Window.partitionBy("case_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return lines.withColumn("__error", error).withColumn("error", F.first("__error", ignorenulls=True).over(case)).drop("__error")


def errors(lines: DataFrame) -> DataFrame:
    """case_id, error of every case with a malformed header, a bad prefix, an overrun or a truncated hunk."""
    return lines.where("error IS NOT NULL").groupBy("case_id").agg(F.first("error").alias("error"))


def headless(diffs: DataFrame) -> DataFrame:
    """case_id, warning of texts that are not blank and hold no ``diff --git`` line, so that nothing was read."""
    return diffs.where(F.col("diff").rlike(r"\S") & ~F.col("diff").rlike(r"(?m)^diff --git ")).select("case_id", F.lit("no file section").alias("warning"))


def _paths(over: Callable[[Column], Column]) -> dict[str, Column]:
    """old_path, new_path, is_new, is_deleted, is_binary from the header lines that ``over`` aggregates."""
    head = ~F.col("body") & ~F.col("is_head")
    raw = F.col("raw")
    fields = F.split(F.trim(F.substr(raw, F.lit(len("diff --git ") + 1))), r"\s+")
    git = raw.startswith("diff --git ") & (F.size(fields) == 2)
    path = F.trim(F.substr(raw, F.lit(5)))
    pick = lambda cond: over(F.max_by(F.when(cond, path), F.when(cond, F.col("pos"))))
    ever = lambda cond: over(F.bool_or(head & cond))
    old, new = pick(head & raw.startswith("--- ")), pick(head & raw.startswith("+++ "))
    gone = "/dev/null"
    resolved = lambda own, i: F.when(own.isNull(), over(F.max(F.when(git, strip_path(fields[i]))))).when(own == gone, None).otherwise(strip_path(own))
    return {
        "old_path": resolved(old, 0),
        "new_path": resolved(new, 1),
        "is_new": ever(raw.startswith("new file mode")) | F.coalesce(old == gone, F.lit(False)),
        "is_deleted": ever(raw.startswith("deleted file mode")) | F.coalesce(new == gone, F.lit(False)),
        "is_binary": ever(raw.startswith("Binary files ") | raw.startswith("GIT binary patch")),
    }


def files(lines: DataFrame) -> DataFrame:
    """case_id, file_id, old_path, new_path, is_new, is_deleted, is_binary; a path that does not exist is null."""
    return lines.groupBy("case_id", "file_id").agg(*[c.alias(n) for n, c in _paths(lambda c: c).items()])


def with_paths(lines: DataFrame) -> DataFrame:
    """lines with the columns of their file: windows over the partitioning that the lines have, in place of a join."""
    of_file = Window.partitionBy("case_id", "file_id")
    return lines.withColumns(_paths(lambda c: c.over(of_file)))


def body_of(lines: DataFrame, *also: str) -> DataFrame:
    """case_id, file_id, hunk_id, pos, kind, text, old_line, new_line, section, and more columns, of lines of sound diffs."""
    return lines.where("body AND kind <> 'marker'").select(
        "case_id", "file_id", "hunk_id", "pos", "kind", F.substr("raw", F.lit(2)).alias("text"),
        F.when(F.col("kind") != "added", F.col("h.old_start") + F.col("old_before")).alias("old_line"),
        F.when(F.col("kind") != "deleted", F.col("h.new_start") + F.col("new_before")).alias("new_line"),
        F.col("h.section").alias("section"), *also,
    )


def body_lines(lines: DataFrame) -> DataFrame:
    """body_of the diffs without an error."""
    return body_of(lines.where("error IS NULL"))


def added_lines(lines: DataFrame) -> DataFrame:
    return body_lines(lines).where("kind = 'added'")


def post_image_paths(diffs: DataFrame) -> DataFrame:
    """(case_id, pos, path) of every file that is there after the change, by prefixes alone."""
    return raw_lines(diffs).where(F.col("raw").startswith("+++ b/")).select("case_id", "pos", F.substr("raw", F.lit(7)).alias("path"))


def coarse_added(diffs: DataFrame) -> DataFrame:
    """(case_id, pos, path, content) by prefixes alone: only ``+++ b/`` sets a path, any other ``+++ `` clears it.

    Every other line that starts with + and not with +++ is added; before the first header its path is null.
    """
    raw = F.col("raw")
    event = F.when(raw.startswith("+++ b/"), F.substr(raw, F.lit(7))).when(raw.startswith("+++ "), "")
    upto = Window.partitionBy("case_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    df = raw_lines(diffs).withColumn("path", F.nullif(F.last(event, ignorenulls=True).over(upto), F.lit("")))
    return df.where(raw.startswith("+") & ~raw.startswith("+++")).select("case_id", "pos", "path", F.substr("raw", F.lit(2)).alias("content"))


def diff_stats(diffs: DataFrame) -> DataFrame:
    """case_id, n_files, n_changed: sections, and lines that start with one + or -."""
    raw = F.col("raw")
    changed = (raw.startswith("+") & ~raw.startswith("+++")) | (raw.startswith("-") & ~raw.startswith("---"))
    return raw_lines(diffs).groupBy("case_id").agg(F.count_if(raw.startswith("diff --git ")).alias("n_files"), F.count_if(changed).alias("n_changed"))


def images_of(body: DataFrame) -> DataFrame:
    """The new side of each hunk of body (with file): rows array of struct<pos, text, new_line, added>, in order."""
    rows = F.array_sort(F.collect_list(F.struct("pos", "text", "new_line", (F.col("kind") == "added").alias("added"))))
    return body.where("kind <> 'deleted'").groupBy("case_id", "file_id", "hunk_id").agg(F.first("file").alias("file"), rows.alias("rows"))
