"""Mixing sources to target weights: capped water-filling, then seeded whole and fractional repetitions.

Targets: all sizes are shared by weight; a source whose share exceeds ``max_epochs`` times its size is clamped there and
the excess is shared again among the others by weight, until no source is above.  Each round is one aggregate over the
table of sources; the driver holds three sums.

Repetitions: at rate r = target / size, each document of a source is taken floor(r) times, and a seeded subset once
more.  The subset is drawn by size class, from the largest documents down; each class takes its share of the words
still due, by rank of a seeded hash, and hands its remainder on, so a source's taken words end within a small document
of its target.  Ranks are counted per (source, class, hash bucket), so a source with a third of all rows is dealt over
many tasks.

Edge cases: a null text has size 0; null sources form one source, last in order; rows with one doc_id, or none, are
documents of their own, told apart by a hash of their content, so reruns agree whatever the rows' order; equal rows are
interchangeable; an empty table gives an empty table; other columns pass through ``mix`` untouched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import content_hash, discard, n_words_of, stored, table, text_of

MAX_EPOCHS = 3.0
SEED = 20240607
BUCKETS = 64
CYCLE = 3
CELL = ["__source", "__class", "__bucket"]


def source_key(source: Column) -> Column:
    """Orders by code point with null last, and joins without null-safe equality."""
    return F.coalesce(F.concat(F.lit("0"), source.cast("string")), F.lit("1"))


def with_weights(sources: DataFrame) -> DataFrame:
    """Weight 1, 2, 3, repeating.  There is one row per source by now: the ordered window sees sources, not documents."""
    place = F.row_number().over(Window.orderBy("__source"))
    return sources.withColumn("weight", ((place - 1) % CYCLE + 1).cast("double"))


def water_fill(sources: DataFrame, max_epochs: float = MAX_EPOCHS) -> DataFrame:
    """sources (source_size, weight) with target.  A round clamps the sources above their caps and raises the level."""
    cap = F.col("source_size") * F.lit(float(max_epochs))
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    level, clamped = 0.0, -1
    while True:
        over = (F.col("weight") * F.lit(level) > cap) if clamped >= 0 else F.lit(False)
        n, used, weight = sources.agg(F.count_if(over), F.sum(F.when(over, cap).otherwise(0.0)), F.sum(F.when(over, 0.0).otherwise(F.col("weight")))).first()
        if n == clamped:
            break
        clamped = n
        level = (total - (used or 0.0)) / weight if weight else level
    return sources.withColumn("target", F.least(cap, F.col("weight") * F.lit(level)))


def class_quotas(cells: DataFrame, sources: DataFrame, seed: int) -> DataFrame:
    """__source, __class, __quota: how many documents of each size class are taken once more.

    A source's classes, 8 for each doubling of the size, are walked from the largest down in one expression.
    """
    classes = cells.groupBy("__source", "__class").agg(F.sum("n").alias("n"), F.sum("words").alias("words"))
    draw = F.pmod(F.xxhash64(F.lit(seed + 1), "__source", "__class"), F.lit(1 << 30)) / float(1 << 30)
    classes = classes.join(sources.select("__source", (F.col("rate") - F.floor("rate")).alias("share")), "__source").withColumn("draw", draw)

    fields = F.struct("__class", F.col("n").cast("double").alias("n"), "words", (F.col("words") / F.col("n")).alias("mean"), "share", "draw")
    due = lambda s, x: s["due"] + x["words"] * x["share"]
    quota = lambda s, x: F.when(x["mean"] > 0, F.least(x["n"], F.greatest(F.lit(0.0), F.floor(due(s, x) / x["mean"] + x["draw"]).cast("double")))).otherwise(0.0)
    step = lambda s, x: F.struct((due(s, x) - quota(s, x) * x["mean"]).alias("due"), F.concat(s["quotas"], F.array(F.struct(x["__class"].alias("c"), quota(s, x).cast("long").alias("q")))).alias("quotas"))
    start = F.struct(F.lit(0.0).alias("due"), F.array().cast("array<struct<c:int,q:bigint>>").alias("quotas"))
    of_source = classes.groupBy("__source").agg(F.sort_array(F.collect_list(fields), asc=False).alias("cs"))
    chosen = of_source.select("__source", F.explode(F.aggregate("cs", start, step)["quotas"]).alias("x"))
    return chosen.select("__source", F.col("x.c").alias("__class"), F.col("x.q").alias("__quota"))


def mix(docs: DataFrame, key: str = "doc_id", source: str = "source", size: str = "size", content: str = "content", seed: int = SEED, max_epochs: float = MAX_EPOCHS) -> DataFrame:
    """docs with __source_size, __target, __repeats.  Reads docs twice; its other columns move once.

    The column named by content is a hash of what tells rows of one key apart.
    """
    rows = docs.withColumns({
        "__source": source_key(F.col(source)),
        "__class": F.floor(F.log2(F.col(size) + 1) * 8).cast("int"),
        "__hash": F.xxhash64(F.lit(seed), F.col(key), F.col(content)),
    }).withColumn("__bucket", F.pmod("__hash", F.lit(BUCKETS)).cast("int"))
    cells = stored(rows.groupBy(*CELL).agg(F.count(F.lit(1)).alias("n"), F.sum(size).alias("words")), "mix-cells")
    sizes = cells.groupBy("__source").agg(F.sum("words").alias("source_size"))
    weighted = stored(with_weights(sizes), "mix-weights")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    sources = water_fill(weighted, max_epochs).withColumn("rate", rate)
    before = F.sum("n").over(Window.partitionBy("__source", "__class").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1))
    plan = stored(
        cells.withColumn("__before", F.coalesce(before, F.lit(0)))
        .join(class_quotas(cells, sources, seed), ["__source", "__class"])
        .join(sources.select("__source", F.col("source_size").alias("__source_size"), F.col("target").alias("__target"), F.floor("rate").alias("__whole")), "__source")
        .drop("n", "words"),
        "mix-plan",
    )
    discard(cells, weighted)
    place = F.row_number().over(Window.partitionBy(*CELL).orderBy("__hash", key, size, content))
    more = (F.col("__before") + F.col("__place") <= F.col("__quota")).cast("long")
    out = rows.withColumn("__place", place).join(plan, CELL).withColumn("__repeats", F.col("__whole") + more)
    return out.drop(*CELL, "__hash", "__place", "__before", "__quota", "__whole")


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", n_words_of(text_of()).alias("size"), F.xxhash64("text").alias("content"))
    return mix(docs).select("doc_id", "size", F.col("__source_size").alias("source_size"), F.col("__target").alias("target"), (F.col("size") * F.col("__repeats")).alias("taken"), F.col("__repeats").alias("repeats"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    rows = docs.select(F.struct("*").alias("__row"), F.col("doc_id").alias("__key"), F.col("source").alias("__of"), n_words_of(text_of()).alias("__size"), content_hash(docs).alias("__content"))
    out = mix(rows, "__key", "__of", "__size", "__content").where("__repeats > 0")
    return out.withColumn("__n", F.explode(F.sequence(F.lit(1), F.col("__repeats").cast("int")))).select("__row.*")
