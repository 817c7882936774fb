"""Corpus upkeep: gate funnel, capped picks, quarantine, name tables, diagnosis, merges of runs."""

from __future__ import annotations

import difflib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import diffs as diff_lines
from . import imports

# Limits of the corpus miner.
MAX_AGE_DAYS, MAX_FILES, MAX_CHANGED, PER_REPO, DEFAULT_COUNT = 730, 30, 1500, 15, 12


def is_bot(user_type: Column, login: Column) -> Column:
    return (F.coalesce(user_type, F.lit("")) == "Bot") | F.coalesce(login, F.lit("")).endswith("[bot]")


def merged_within(merged_at: Column, now: Column) -> Column:
    return F.coalesce(merged_at >= now - F.make_dt_interval(F.lit(MAX_AGE_DAYS)), F.lit(False))


def is_requirement_like(path: Column, content: Column) -> Column:
    """Whether an added line of a manifest may name a package; in .txt files all but comments, options and links."""
    line = F.regexp_replace(content, r"^\s+|\s+$", "")
    spec = F.btrim(F.btrim(line, F.lit(",")), F.lit("\"'")).rlike(r"^[A-Za-z0-9][A-Za-z0-9._-]*(?:\[[^\]]+\])?\s*(?:(?:===|==|>=|<=|~=|!=|>|<)\S*|;.*)?$")
    return (line != "") & ~line.startswith("#") & F.when(path.endswith(".txt"), ~line.startswith("-") & ~line.contains("://")).otherwise(spec)


def diff_gates(diffs: DataFrame) -> DataFrame:
    """case_id, touches_python, adds_name: does any file or added line of the diff pass?  Empty diffs have no row."""
    raw, path, content = F.col("raw"), F.col("path"), F.substr("raw", F.lit(2))
    event = F.when(raw.startswith("+++ b/"), F.substr(raw, F.lit(7))).when(raw.startswith("+++ "), "")
    upto = Window.partitionBy("case_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    lines = diff_lines.raw_lines(diffs).withColumn("path", F.coalesce(F.last(event, ignorenulls=True).over(upto), F.lit("")))
    added = raw.startswith("+") & ~raw.startswith("+++")
    manifest = path.rlike(r"(?:^|/)(?:requirements[^/]*\.txt|pyproject\.toml|setup\.py|setup\.cfg)$")
    named = F.when(path.endswith(".py"), content.rlike(r"^\s*(?:import|from)\s+[A-Za-z_.]")).otherwise(manifest & is_requirement_like(path, content))
    return lines.groupBy("case_id").agg(F.bool_or(raw.startswith("+++ b/") & raw.endswith(".py")).alias("touches_python"), F.bool_or(added & named).alias("adds_name"))


def mined(pulls: DataFrame, diffs: DataFrame, existing: DataFrame, now: Column, target: int = DEFAULT_COUNT) -> DataFrame:
    """The examined pulls with case_id and gate: kept, already mined, or the first gate that they fail.

    pulls: (repo, pos, number, merged_at, user_type, login), pos in listing order; diffs: (case_id, diff), without a row
    or null where a diff can't be had; existing: (case_id).  Cases mined before, or earlier in the listing, count toward
    the cap.
    """
    case_id = F.concat(F.replace("repo", F.lit("/"), F.lit("__")), F.lit("__pr"), F.col("number").cast("string"))
    rows = pulls.withColumns({"case_id": case_id, "recent": merged_within(F.col("merged_at"), now), "bot": is_bot(F.col("user_type"), F.col("login"))})
    had = diffs.where("diff IS NOT NULL")
    for df in (existing.select("case_id").distinct().withColumn("existing", F.lit(True)), had.select("case_id", F.lit(True).alias("has_diff")), diff_gates(had), diff_lines.diff_stats(had)):
        rows = rows.join(df, "case_id", "left")
    gates = [
        ("not merged", "merged_at IS NULL"), ("too old", "NOT recent"), ("bot", "bot"), ("already mined", "existing"), ("diff unavailable", "has_diff IS NULL"), ("no python file", "NOT coalesce(touches_python, false)"),
        ("too large", f"n_files > {MAX_FILES} OR n_changed > {MAX_CHANGED}"), ("no import or requirement", "NOT coalesce(adds_name, false)"),
    ]
    again = F.row_number().over(Window.partitionBy("case_id", "gate").orderBy("pos")) > 1
    rows = first_gate(rows, gates).withColumn("gate", F.when((F.col("gate") == "kept") & again, "already mined").otherwise(F.col("gate")))
    counted = rows.withColumn("counted", F.col("gate").isin("kept", "already mined"))
    return examined_until_full(counted, "repo", ["pos"], "counted", min(target, PER_REPO)).select("repo", "pos", "number", "case_id", "gate")


def registry_checked(names: DataFrame) -> DataFrame:
    """One row: how many names of a name table the registry resolved."""
    return names.agg(F.count_if(F.col("status").isin("pypi", "pypi-alias")).alias("names"))


def first_gate(rows: DataFrame, gates: list[tuple[str, str]], passed: str = "kept") -> DataFrame:
    """rows with gate: the first of (name, failing condition) that holds, else passed."""
    gate = F
    for name, fails in gates:
        gate = gate.when(F.expr(fails), name)
    return rows.withColumn("gate", gate.otherwise(passed))


def funnel(rows: DataFrame, by: str, gates: list[tuple[str, str]], passed: str = "kept") -> DataFrame:
    return first_gate(rows, gates, passed).groupBy(by, "gate").agg(F.count(F.lit(1)).alias("n"))


def examined_until_full(rows: DataFrame, by: str, order: list[str], kept: str, cap: int) -> DataFrame:
    """Rows in order up to and with the one that fills the cap; later ones were never examined."""
    before = Window.partitionBy(by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("__k", F.coalesce(F.sum(F.col(kept).cast("int")).over(before), F.lit(0))).where(F.col("__k") < cap).drop("__k")


def quarantine(cases: DataFrame, flagged: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(kept, review)."""
    return cases.join(flagged, key, "left_anti"), cases.join(flagged, key, "left_semi")


def name_table(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """First-seen status and evidence of each name, and its cases in the order they were first seen."""
    seen = rows.groupBy(*keys, "case_id").agg(F.min(order).alias("__o"), F.min_by(F.struct("status", "evidence"), order).alias("v"))
    return seen.groupBy(*keys).agg(F.min_by("v", "__o").alias("v"), F.transform(F.array_sort(F.collect_list(F.struct("__o", "case_id"))), lambda x: x["case_id"]).alias("cases")).select(*keys, "v.status", "v.evidence", "cases")


def merge_counts(old: DataFrame, new: DataFrame, keys: list[str], value: str) -> DataFrame:
    return old.unionByName(new).groupBy(*keys).agg(F.sum(value).alias(value))


def upsert(old: DataFrame, new: DataFrame, key: str, value: str) -> DataFrame:
    """key, action, value: insert, update, delete or keep, for a sink that holds one row per key."""
    o, n = old.select(key, F.col(value).alias("__o"), F.lit(True).alias("__in_o")), new.select(key, F.col(value).alias("__n"), F.lit(True).alias("__in_n"))
    action = F.when(F.col("__in_o").isNull(), "insert").when(F.col("__in_n").isNull(), "delete").when(F.col("__o").eqNullSafe(F.col("__n")), "keep").otherwise("update")
    return o.join(n, key, "full").select(key, action.alias("action"), F.coalesce("__n", "__o").alias(value))


def mining_report(old: DataFrame, new: DataFrame) -> DataFrame:
    """repo, body: the counts (repo, gate, n) of earlier runs and this one together, as one JSON object per repository."""
    counts = merge_counts(old, new, ["repo", "gate"], "n")
    by_gate = F.map_from_entries(F.array_sort(F.collect_list(F.struct("gate", "n"))))
    return counts.groupBy("repo").agg(F.to_json(F.struct(F.sum("n").alias("examined"), by_gate.alias("gates"))).alias("body"))


def lost(old: DataFrame, new: DataFrame) -> DataFrame:
    """name: what a list that may only grow has lost; must be empty."""
    return old.select("name").distinct().join(new.select("name"), "name", "left_anti")


def coverage(listed: DataFrame, wanted: DataFrame, least: int) -> DataFrame:
    """One row: how many names are listed, how many wanted ones are missing, and whether the list is whole."""
    both = listed.select("name", F.lit(1).alias("l"), F.lit(0).alias("w")).unionByName(wanted.select("name", F.lit(0).alias("l"), F.lit(1).alias("w")))
    by_name = both.groupBy("name").agg(F.max("l").alias("l"), F.max("w").alias("w"))
    out = by_name.agg(F.coalesce(F.sum("l"), F.lit(0)).alias("listed"), F.count_if((F.col("w") == 1) & (F.col("l") == 0)).alias("missing"))
    return out.withColumn("whole", (F.col("missing") == 0) & (F.col("listed") > least))


def first_match(rows: DataFrame, by: list[str], order: list[str], condition: Column) -> DataFrame:
    """The first row of each group, in order, that the condition holds for."""
    values = [c for c in rows.columns if c not in by]
    return rows.where(condition).groupBy(*by).agg(F.min_by(F.struct(*values), F.struct(*order)).alias("r")).select(*by, "r.*")


def issue_actions(wanted: DataFrame, issues: DataFrame) -> DataFrame:
    """wanted (title, body) with number and action: update the first open issue of that very title, or open one.

    issues: (number, title) of the open ones.
    """
    known = issues.groupBy("title").agg(F.min("number").alias("number"))
    return wanted.join(known, "title", "left").withColumn("action", F.when(F.col("number").isNull(), "open").otherwise("update"))


def verified_assets(assets: DataFrame, sums: DataFrame) -> DataFrame:
    """assets (release, name, sha256) with verdict: verified, failed, or unlisted where the release's sums lack the name.

    sums: (release, text), the lines of which hold a digest, blanks, and a name that a star may precede.
    """
    lines = sums.select("release", F.explode(F.split("text", "\n")).alias("line"))
    listed = lines.select("release", F.lower(F.regexp_extract("line", r"^([0-9A-Fa-f]{64})\s+\*?(.+?)\s*$", 1)).alias("listed"), F.regexp_extract("line", r"^([0-9A-Fa-f]{64})\s+\*?(.+?)\s*$", 2).alias("name"))
    one = listed.where("listed <> ''").groupBy("release", "name").agg(F.min("listed").alias("listed"), F.max("listed").alias("__other"))
    verdict = F.when(F.col("listed").isNull(), "unlisted").when((F.col("listed") == F.lower("sha256")) & (F.col("__other") == F.col("listed")), "verified").otherwise("failed")
    return assets.join(one, ["release", "name"], "left").withColumn("verdict", verdict).drop("listed", "__other")


def diagnose(unresolved: DataFrame, tree: DataFrame, known: DataFrame, diffs: DataFrame) -> DataFrame:
    """unresolved (case_id, repo, ord, top, file) with signals, what may explain the name.

    tree: (repo, path); known: (name) of real packages; diffs: (case_id, diff).  The tree is asked for the name, the name
    with .py and the name under src, and the first that is there counts.
    """
    probes = unresolved.select("repo", "ord", F.posexplode(F.array("top", F.concat("top", F.lit(".py")), F.concat(F.lit("src/"), "top"))).alias("k", "path"))
    seen = probes.join(tree.select("repo", "path").distinct(), ["repo", "path"]).groupBy("ord").agg(F.min_by("path", "k").alias("probe"))
    near = close_names(unresolved.select(F.lower("top").alias("name")), known.select(F.lower("name").alias("name"))).select(F.col("name").alias("__name"), "near")
    guards = diffs.select("case_id", imports.guarded(F.col("diff")).alias("guarded"))
    rows = unresolved.join(seen, "ord", "left").join(guards, "case_id", "left").withColumn("__name", F.lower("top")).join(near, "__name", "left").drop("__name")
    rows = rows.withColumn("in_tree", F.col("probe").isNotNull()).withColumn("is_test", F.lower("file").contains("test"))
    return signals(rows).drop("guarded", "is_test", "in_tree")


def signals(rows: DataFrame) -> DataFrame:
    """rows (in_tree, near, is_test, guarded) with the list of what may explain an unresolved name."""
    found = F.array_compact(F.array(F.when(F.col("in_tree"), "exists in tree"), F.when(F.col("near").isNotNull(), F.concat(F.lit("near "), "near")), F.when(F.col("is_test"), "test file"), F.when(F.col("guarded"), "guarded import")))
    return rows.withColumn("signals", F.when(F.size(found) == 0, F.array(F.lit("none"))).otherwise(found))


def nearest(names: DataFrame, known: DataFrame, most: int = 2) -> DataFrame:
    """The closest known name within ``most`` edits, ties by name.  A deletion-variant key replaces the cross join.

    Two words within k edits share a string that both become by deleting at most k characters.
    """
    spots = lambda c: F.sequence(F.lit(1), F.length(c))
    drop = lambda c: F.when(F.length(c) > 0, F.transform(spots(c), lambda i: F.concat(F.substr(c, F.lit(1), i - 1), F.substr(c, i + 1)))).otherwise(F.array(c))

    def keyed(df: DataFrame, name: str) -> DataFrame:
        df = df.withColumn("__k", F.array(F.col(name)))
        for _ in range(most):
            df = df.withColumn("__k", F.array_distinct(F.concat("__k", F.flatten(F.transform("__k", drop)))))
        return df.withColumn("__k", F.explode("__k"))

    pairs = keyed(names.select("name").distinct(), "name").join(keyed(known.select(F.col("name").alias("near")).distinct(), "near"), "__k").select("name", "near").distinct()
    far = pairs.withColumn("distance", F.levenshtein("name", "near")).where(F.col("distance") <= most)
    return far.groupBy("name").agg(F.min(F.struct("distance", "near")).alias("b")).select("name", "b.near", F.col("b.distance").cast("long").alias("distance"))


# Well-known packages to which a name may come close.
POPULAR = (
    "requests numpy pandas scipy matplotlib flask django pytest setuptools pillow aiohttp httpx urllib3 certifi click rich pydantic sqlalchemy boto3 "
    "beautifulsoup4 lxml cryptography packaging wheel virtualenv tox mypy black isort coverage"
)


def close_names(names: DataFrame, known: DataFrame, cutoff: float = 0.8) -> DataFrame:
    """name, near, ratio: the known name of the greatest matching ratio, if it reaches cutoff; ties by the later name.

    The ratio is 2 * matched / (len(a) + len(b)), matched in common blocks, so a pair at cutoff has a common subsequence
    of cutoff / 2 of both lengths.  A name's padded character pairs are its keys.  What is not common breaks at most two
    pairs each, so a pair of names shares a key, and all of them need not be compared; candidates are then compared exactly.
    """
    padded = lambda c: F.concat(F.lit("\x02"), c, F.lit("\x03"))
    grams = lambda c: F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(c) + 1), lambda i: F.substr(padded(c), i, F.lit(2))))
    left = names.select("name").where("name <> ''").distinct().withColumn("key", F.explode(grams(F.col("name"))))
    right = known.select(F.col("name").alias("near")).where("near <> ''").distinct().withColumn("key", F.explode(grams(F.col("near"))))
    lengths = F.least(F.length("name"), F.length("near")) * 2 >= F.lit(cutoff) * (F.length("name") + F.length("near"))
    pairs = left.join(right, "key").where(lengths).select("name", "near").distinct()

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ratios = [difflib.SequenceMatcher(None, b, a).ratio() for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(ratios, pa.float64())], ["name", "near", "ratio"])

    found = pairs.mapInArrow(compared, "name string, near string, ratio double").where(F.col("ratio") >= cutoff)
    return found.groupBy("name").agg(F.max(F.struct("ratio", "near")).alias("b")).select("name", "b.near", "b.ratio")
