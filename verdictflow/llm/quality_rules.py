"""Quality rules: a threshold table compiled into one projection of built-in expressions.

Edge cases: a null text counts as empty and fails; a text of any length is read whole; ties and repeated rows are judged
row by row; an empty table gives an empty table; columns of the input that clash with names made here are replaced only
in the result of ``measure``, never read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, text_of, words_of

SYMBOLS = "#*$%&|<>"
WINDOW = 5

#: Frequent function words of the four languages of the corpora.
STOP_WORDS = {
    "en": "the of and to in a is that for it was on are be with as by at this from or an",
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es",
    "es": "de la que el en y a los se del las un por con no una su para es al lo como",
    "fr": "de la le et les des en un du une que est pour qui dans a par plus pas au sur ne",
}


def stop_forms() -> list[str]:
    """The stop words as they stand inside a sentence and at its start."""
    words = {w for ws in STOP_WORDS.values() for w in ws.split()}
    return sorted(words | {w.capitalize() for w in words})


@dataclass(frozen=True)
class Rule:
    """``low <= value <= high``; value is an SQL expression over the measures."""

    name: str
    value: str
    low: float
    high: float


#: The production table.  Ratios are 0 where their divisor is 0.
RULES = (
    Rule("length", "n_words", 10, float("inf")),
    Rule("word_length", "word_chars / greatest(n_words, 1)", 1.5, 25.0),
    Rule("symbols", "n_symbols / greatest(word_chars, 1)", 0.0, 0.08),
    Rule("stop_words", "(n_stop_words + 1) / greatest(n_words, 1)", 0.01, 2.0),
    Rule("duplicate_lines", "n_dup_lines / greatest(n_lines, 1)", 0.0, 0.5),
    Rule("bullet_lines", "n_bullet_lines / greatest(n_lines, 1)", 0.0, 0.9),
    Rule("ellipsis_lines", "n_ellipsis_lines / greatest(n_lines, 1)", 0.0, 0.5),
)

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_stop_words", "n_lines", "n_bullet_lines", "n_ellipsis_lines")


def compile_rules(rules: tuple[Rule, ...]) -> Column:
    """One boolean expression; Catalyst folds it into the projection that holds the measures."""
    out = F.lit(True)
    for r in rules:
        value = F.expr(r.value).cast("double")
        out = out & (value >= F.lit(r.low))
        if r.high != float("inf"):
            out = out & (value <= F.lit(r.high))
    return out


def _count(text: Column, keep: str) -> Column:
    """Characters of text outside the class that ``keep`` (a run of other characters) matches."""
    return F.length(F.regexp_replace(text, keep, "")).cast("long")


def repeat_words(df: DataFrame, words: str, out: str) -> DataFrame:
    """Words inside WINDOW-word windows that occur twice or more in the text.

    A window is known by a 64-bit hash of its words' hashes.  Most texts have no repeated window, which one distinct
    over longs shows; only the others have their windows sorted, so the work is n log n for any text.
    """
    hashed = F.transform(F.col(words), lambda w: F.xxhash64(w))
    df = df.withColumn("__h", hashed)
    windows = F.when(
        F.size("__h") >= WINDOW,
        F.transform(F.slice("__h", 1, F.size("__h") - (WINDOW - 1)), lambda h, i: F.xxhash64(h, *[F.get("__h", i + k) for k in range(1, WINDOW)])),
    ).otherwise(F.array().cast("array<bigint>"))
    df = df.withColumn("__w", windows)
    repeated = F.size(F.array_distinct("__w")) < F.size("__w")
    df = df.withColumn("__s", F.when(repeated, F.sort_array(F.transform("__w", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    twice = F.filter(F.col("__s"), lambda x, i: (x["h"] == F.get("__s", i - 1)["h"]) | (x["h"] == F.get("__s", i + 1)["h"]))
    df = df.withColumn("__p", F.sort_array(F.transform(twice, lambda x: x["i"])))
    covered = F.aggregate(
        F.transform("__p", lambda p, i: F.least(F.lit(WINDOW), F.coalesce(F.get("__p", i + 1) - p, F.lit(WINDOW)))).cast("array<bigint>"),
        F.lit(0).cast("bigint"),
        lambda a, b: a + b,
    )
    return df.withColumn(out, F.coalesce(covered, F.lit(0).cast("bigint"))).drop("__h", "__w", "__s", "__p")


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with the columns of MEASURES, all long."""
    df = docs.withColumn("__t", text_of(text)).withColumn("__ws", words_of(F.col("__t")))
    df = df.withColumn("__lines", F.filter(F.split("__t", "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    df = repeat_words(df, "__ws", "n_repeat_words")
    lines = F.col("__lines")
    df = df.withColumns({
        "n_words": F.size("__ws").cast("long"),
        "word_chars": F.length(F.array_join("__ws", "")).cast("long"),
        "n_symbols": _count(F.col("__t"), r"[^#*$%&|<>]+"),
        "n_dup_lines": (F.size(lines) - F.size(F.array_distinct(lines))).cast("long"),
        "n_stop_words": F.size(F.filter("__ws", lambda w: w.isin(stop_forms()))).cast("long"),
        "n_lines": F.size(lines).cast("long"),
        "n_bullet_lines": F.size(F.filter(lines, lambda x: F.ltrim(x).substr(1, 1).isin("-", "*", "•"))).cast("long"),
        "n_ellipsis_lines": F.size(F.filter(lines, lambda x: F.rtrim(x).endswith("...") | F.rtrim(x).endswith("…"))).cast("long"),
    })
    return df.drop("__t", "__ws", "__lines")


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 20)


def apply_rules(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text") -> DataFrame:
    """docs with the measures, base_failed and kept."""
    return measure(docs, text).withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & compile_rules(rules))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return apply_rules(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the rules keep, with their own columns."""
    kept = apply_rules(docs.select(F.struct("*").alias("__row"), F.col("text").alias("__text")), text="__text")
    # A filter on a plain column would be pushed below the projections, and evaluate their arrays once for each element.
    held = F.when(F.monotonically_increasing_id() >= 0, F.col("kept"))
    return kept.withColumn("__kept", held).where("__kept").select("__row.*")


_STOP_SQL = ", ".join("'" + w + "'" for w in stop_forms())

#: DuckDB; windows are compared as strings.
ORACLE = rf"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents
), w AS (
  SELECT rid, doc_id, t,
    list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
    list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls
  FROM d
), win AS (
  SELECT rid, i, ws[i] || chr(10) || ws[i+1] || chr(10) || ws[i+2] || chr(10) || ws[i+3] || chr(10) || ws[i+4] AS g
  FROM (SELECT rid, ws, unnest(range(1, len(ws) - 3)) AS i FROM w WHERE len(ws) >= 5)
), rep AS (
  SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS c FROM win) WHERE c > 1
), cov AS (
  SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest(range(i, i + 5)) AS p FROM rep) GROUP BY rid
), m AS (
  SELECT w.doc_id, len(ws)::BIGINT AS n_words,
    length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols,
    (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
    coalesce(cov.n, 0)::BIGINT AS n_repeat_words,
    len(list_filter(ws, lambda x: x IN ({_STOP_SQL})))::BIGINT AS n_stop_words,
    len(ls)::BIGINT AS n_lines,
    len(list_filter(ls, lambda x: ltrim(x, ' ')[1] IN ('-', '*', '•')))::BIGINT AS n_bullet_lines,
    len(list_filter(ls, lambda x: regexp_matches(x, '(\.\.\.|…) *$')))::BIGINT AS n_ellipsis_lines
  FROM w LEFT JOIN cov USING (rid)
), b AS (
  SELECT *, (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AS base_failed FROM m
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  (NOT base_failed AND {" AND ".join(f"({r.value})::DOUBLE >= {r.low}" + ("" if r.high == float("inf") else f" AND ({r.value})::DOUBLE <= {r.high}") for r in RULES)}) AS kept
FROM b
"""
