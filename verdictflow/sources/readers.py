"""Readers with declared schemas; nothing is inferred."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TRUTH = "struct<name:string,file:string,kind:string,category:string,origin:string,mimics:string,verified_absent:string>"
CASE = f"id string, diff string, label string, scenario string, context string, source map<string,string>, truth array<{TRUTH}>, adjudicated array<struct<name:string,decision:string,date:string,reason:string>>"
REGISTRY = "name string, status int, exists boolean, checked string"
LABELS = ("clean", "hallucination")
FINDING = "array<struct<name:string,file:string,line:int,kind:string,message:string>>"


def as_diffs(texts: DataFrame) -> DataFrame:
    """Whole texts, read from files in batch or as a stream: case_id (the file's name without its suffix), diff."""
    name = F.regexp_extract(F.col("_metadata.file_name"), r"^(.*?)(\.diff|\.patch)?$", 1)
    return texts.select(name.alias("case_id"), F.col("value").alias("diff"))


def diffs(spark: SparkSession, path: str) -> DataFrame:
    """One row per file."""
    return as_diffs(spark.read.text(path, wholetext=True))


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """Cases of a JSON-lines manifest; blank lines and # lines are skipped; ``error`` says what is wrong with a row.

    place is the row's file and line.  A manifest lists cases, it doesn't hold them, so a file is one row at first.
    """
    whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("file"), F.posexplode(F.split("value", "\n")).alias("n", "value"))
    lines = whole.where(~F.col("value").rlike(r"^\s*(#|$)")).withColumn("place", F.concat_ws(":", "file", (F.col("n") + 1).cast("string")))
    rows = lines.select("place", "value", F.from_json("value", CASE, {"mode": "PERMISSIVE"}).alias("c")).select("place", "value", "c.*")
    error = (
        F.when(F.col("id").isNull(), "bad json or no id")
        .when(~F.coalesce(F.col("label"), F.lit("")).isin(*LABELS), "unknown label")
        .when((F.col("label") == "clean") & (F.coalesce(F.size("truth"), F.lit(0)) > 0), "a clean case has truths")
    )
    return rows.withColumn("error", error).withColumn("diff", F.coalesce("diff", F.concat(F.lit("diffs/"), "id", F.lit(".diff")))).drop("value")


def _inside(folder: str) -> Column:
    """The path of a row's file inside folder, without schemes."""
    plain = lambda p: F.regexp_replace(p, r"^[a-z0-9+.-]+:/*", "/")
    return F.substr(plain(F.url_decode(F.col("_metadata.file_path"))), F.length(plain(F.lit(folder.rstrip("/")))) + 2)


def case_diffs(spark: SparkSession, folder: str) -> DataFrame:
    """The sound cases of a corpus folder with their diffs: the manifest's columns, diff being the text.

    A case whose file is missing has a null diff.
    """
    cases = manifest(spark, f"{folder}/manifest.jsonl").where("error IS NULL").withColumnRenamed("diff", "path").withColumnRenamed("id", "case_id")
    texts = spark.read.option("recursiveFileLookup", True).text(f"{folder}/diffs", wholetext=True).select(_inside(folder).alias("path"), F.col("value").alias("diff"))
    return cases.join(texts, "path", "left")


def adjudicated(manifest: DataFrame) -> DataFrame:
    """(case_id, name): the names of each case that its owner has adjudicated."""
    return manifest.select(F.col("id").alias("case_id"), F.explode("adjudicated.name").alias("name")).where("name IS NOT NULL").distinct()


def registry(spark: SparkSession, path: str) -> DataFrame:
    """A snapshot with one JSON object per ``*.json`` file; objects without a name are left out."""
    return spark.read.schema(REGISTRY).option("multiLine", True).option("pathGlobFilter", "*.json").json(path).where("name IS NOT NULL")


def repo_context(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Captured listings: (ctx_id, name) of top-level names, (ctx_id, dir, name) of siblings.

    ctx_id is the folder ``ctx_id=...`` that a listing stands in, as sinks.write_contexts writes them, else its file's name.
    """
    schema = "ctx_id string, top_level array<string>, siblings map<string,array<string>>, _truncated boolean"
    raw = spark.read.schema(schema).option("multiLine", True).option("pathGlobFilter", "*.json").json(path)
    raw = raw.withColumn("ctx_id", F.coalesce("ctx_id", F.regexp_extract("_metadata.file_name", r"^(.*)\.json$", 1)))
    top = raw.select("ctx_id", F.explode("top_level").alias("name")).distinct()
    by_dir = raw.select("ctx_id", F.explode("siblings").alias("dir", "names"))
    return top, by_dir.select("ctx_id", "dir", F.explode("names").alias("name")).distinct()


def parse_findings(runs: DataFrame) -> DataFrame:
    """runs (case_id, stdout) with findings and error.  Blank is no finding; else an array of objects with names."""
    blank = ~F.coalesce("stdout", F.lit("")).rlike(r"\S")
    parsed = F.from_json("stdout", FINDING)
    named = F.forall(parsed, lambda f: f["name"].isNotNull())
    is_array = F.json_array_length("stdout").isNotNull() & F.ltrim("stdout").startswith("[")
    good = is_array & parsed.isNotNull() & named
    return runs.withColumn("error", F.when(blank | F.coalesce(good, F.lit(False)), None).otherwise("not an array of objects with names")).withColumn("findings", F.when(~blank & F.coalesce(good, F.lit(False)), parsed).otherwise(F.array().cast(FINDING)))


def run_status(runs: DataFrame) -> DataFrame:
    """A failed exit with blank output and something on stderr is a crash, not an empty answer."""
    crash = (F.col("returncode") != 0) & ~F.coalesce("stdout", F.lit("")).rlike(r"\S") & F.coalesce("stderr", F.lit("")).rlike(r"\S")
    return runs.withColumn("crashed", crash)
