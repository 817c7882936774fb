"""Declared dependencies: requirement files line by line, TOML files by last-event windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Keys and tables whose arrays hold dependencies.
DEPENDENCY_KEYS = ("dependencies", "optional-dependencies")
DEPENDENCY_TABLES = ("project.optional-dependencies", "dependency-groups", "build-system")
POETRY_TABLE = r"^tool\.poetry\.(dependencies|dev-dependencies|group\.[^.]+\.dependencies)$"

# The line shapes of TOML tables, keys and strings that these rules tell apart, and a distribution's name.
NAME = r"^[A-Za-z0-9][A-Za-z0-9._-]*"
HEADER = r"^\s*\[{1,2}([^\[\]]+)\]{1,2}\s*$"
OPENER = r"^\s*[\"']?([A-Za-z0-9_.-]+)[\"']?\s*=\s*\["
PAIR = r"^\s*[\"']?([A-Za-z0-9_.-]+)[\"']?\s*="
QUOTED = r"[\"']([^\"']+)[\"']"


def distribution(spec: Column) -> Column:
    """The name at the start of a requirement; null for addresses, paths and anything else."""
    s = F.trim(F.regexp_replace(F.trim(spec), "[\"']", ""))
    name = F.regexp_extract(s, NAME, 0)
    refused = (s == "") | s.contains("://") | s.contains(" @ ") | s.contains("/") | s.startswith(".") | s.startswith("-") | (name == "")
    return F.when(~refused, name)


def requirement(line: Column) -> Column:
    t = F.trim(line)
    body = F.trim(F.substring_index(F.trim(F.substring_index(t, " #", 1)), ";", 1))
    return F.when((t == "") | t.startswith("#") | t.startswith("-"), None).otherwise(distribution(body))


def requirements(added: DataFrame, text: str = "text") -> DataFrame:
    return added.withColumn("name", requirement(F.col(text))).where("name IS NOT NULL")


def toml_dependencies(lines: DataFrame, keep_extras: bool = False) -> DataFrame:
    """lines (case_id, file_id, hunk_id, pos, kind, text, section, ...) of TOML files; the dependencies of added lines.

    The result has the columns of the line, k (the item's place in it) and name.

    Each transition of the (table, key) state sets a constant, so the state before a line is the last event before it;
    the hunk's heading is the first event.  By default a bracket inside an item ends its array, as in the strict rule;
    with ``keep_extras`` brackets inside quotes don't count.
    """
    shown = lines.where("kind <> 'deleted'")
    heading = shown.groupBy("case_id", "file_id", "hunk_id").agg(F.min("pos").alias("pos"), F.first("section").alias("text"))
    heading = heading.withColumn("pos", F.col("pos") - 1).withColumn("kind", F.lit("heading"))
    rows = shown.unionByName(heading, allowMissingColumns=True)
    t = F.col("text")
    plain = F.regexp_replace(t, QUOTED, "") if keep_extras else t
    closes = plain.contains("]")
    is_header, is_opener = t.rlike(HEADER), t.rlike(OPENER)
    table = F.when(is_header, F.trim(F.regexp_extract(t, HEADER, 1)))
    inline_end = F.regexp_replace(plain, OPENER, "").contains("]")
    key = F.when(is_header, "").when(is_opener, F.when(inline_end, "").otherwise(F.regexp_extract(t, OPENER, 1))).when(closes, "")
    before = Window.partitionBy("case_id", "file_id", "hunk_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    state = lambda event: F.coalesce(F.last(event, ignorenulls=True).over(before), F.lit(""))
    rows = rows.withColumn("table", state(table)).withColumn("key", state(key))
    dep = lambda k: k.isin(*DEPENDENCY_KEYS) | F.col("table").isin(*DEPENDENCY_TABLES)
    own = F.regexp_extract(t, OPENER, 1)
    items = F.regexp_extract_all(F.substr(t, F.instr(t, "[") + 1), F.lit(QUOTED), F.lit(1))
    first = F.regexp_extract(t, QUOTED, 1)
    pair = F.regexp_extract(t, PAIR, 1)
    none = F.array().cast("array<string>")
    emitted = (
        F.when(is_header, none)
        .when(is_opener, F.when(dep(own), F.transform(items, distribution)).otherwise(none))
        .when(F.col("key") != "", F.when(dep(F.col("key")) & (first != ""), F.array(distribution(first))).otherwise(none))
        .when(F.col("table").rlike(POETRY_TABLE) & (pair != "") & (pair != "python"), F.array(pair))
        .otherwise(none)
    )
    return rows.where("kind = 'added'").select("*", F.posexplode(emitted).alias("k", "name")).where("name IS NOT NULL").drop("table", "key")
