"""Repository listings from a directory tree, a captured tree, or pages of merged requests."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.names import MAX_DEPTH, SKIPPED_DIRS

PULL = "number long, merged_at string, merge_commit_sha string, html_url string, user struct<login:string,type:string>"
TREE = "repo string, ref string, truncated boolean, tree array<struct<path:string,type:string>>"


def with_parents(files: DataFrame) -> DataFrame:
    """files (ctx_id, path) with the directories above them: ctx_id, path, is_dir."""
    parts = F.split("path", "/")
    above = F.transform(F.when(F.size(parts) > 1, F.sequence(F.lit(1), F.size(parts) - 1)).otherwise(F.array().cast("array<int>")), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
    dirs = files.select("ctx_id", F.explode(above).alias("path")).distinct().withColumn("is_dir", F.lit(True))
    return files.select("ctx_id", "path").distinct().withColumn("is_dir", F.lit(False)).unionByName(dirs)


def _children(uri: str, inside: str) -> list[tuple[str, bool]]:
    """(path under uri, is_dir) of a directory's entries; none if it can't be read."""
    import pyarrow.fs as pafs

    fs, base = pafs.FileSystem.from_uri(uri)
    at = f"{base}/{inside}" if inside else base
    try:
        found = fs.get_file_info(pafs.FileSelector(at))
    except OSError:
        return []
    return [(f"{inside}/{f.base_name}" if inside else f.base_name, f.type == pafs.FileType.Directory) for f in found]


def directory(spark: SparkSession, root: str, ctx_id: str) -> DataFrame:
    """ctx_id, path, is_dir of a tree in any file system.  Skipped directories are never entered, nor is what lies
    deeper than MAX_DEPTH; what can't be read is left out.  The subtrees of the root are dealt over tasks.

    Spark's own file sources leave out names that start with an underscore, so the tree is walked by its file system.
    """

    def top(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for uri in batch["uri"]:
                yield pd.DataFrame(_children(uri, ""), columns=["path", "is_dir"])

    def below(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            todo = list(batch[["path", "is_dir"]].itertuples(index=False, name=None))
            while todo:
                yield pd.DataFrame(todo, columns=["path", "is_dir"])
                todo = [x for path, is_dir in todo if is_dir and path.rsplit("/", 1)[-1] not in SKIPPED_DIRS and path.count("/") < MAX_DEPTH - 1 for x in _children(root, path)]

    first = spark.createDataFrame([(root,)], "uri string").mapInPandas(top, "path string, is_dir boolean")
    return first.repartition("path").mapInPandas(below, "path string, is_dir boolean").select(F.lit(ctx_id).alias("ctx_id"), "path", "is_dir")


def captured_trees(spark: SparkSession, path: str) -> DataFrame:
    """One request per repository, as JSON: ctx_id, path, is_dir, truncated."""
    raw = spark.read.schema(TREE).json(path)
    return raw.select(F.col("repo").alias("ctx_id"), "truncated", F.explode("tree").alias("t")).select("ctx_id", "t.path", (F.col("t.type") == "tree").alias("is_dir"), "truncated")


def pulls(spark: SparkSession, path: str) -> DataFrame:
    """Merged requests with merged_at as a timestamp; null if they were never merged."""
    return spark.read.schema(PULL).json(path).withColumn("merged_at", F.try_to_timestamp("merged_at"))


def pull_pages(spark: SparkSession, path: str) -> DataFrame:
    """repo, page, k and PULL of captured pages ``<repo>/<page>.json``, each an array; nothing after a repo's first empty
    page, as there the listing stopped."""
    texts = spark.read.option("recursiveFileLookup", True).text(path, wholetext=True)
    where = F.regexp_extract(F.url_decode("_metadata.file_path"), r"([^/]+)/(\d+)\.json$", 1), F.regexp_extract("_metadata.file_path", r"/(\d+)\.json$", 1).cast("int")
    pages = texts.select(where[0].alias("repo"), where[1].alias("page"), F.from_json("value", f"array<struct<{PULL}>>").alias("pulls")).where("page IS NOT NULL")
    end = pages.where("size(pulls) = 0").groupBy("repo").agg(F.min("page").alias("end"))
    rows = pages.join(end, "repo", "left").where("end IS NULL OR page < end").select("repo", "page", F.posexplode("pulls").alias("k", "p"))
    return rows.select("repo", "page", "k", "p.*").withColumn("merged_at", F.try_to_timestamp("merged_at"))


def event_number(body: Column) -> Column:
    """The request's number in a host's event payload."""
    return F.coalesce(F.get_json_object(body, "$.pull_request.number"), F.get_json_object(body, "$.number")).cast("long")


def event_commit(body: Column) -> Column:
    """The commit that the request proposes, in a host's event payload."""
    return F.coalesce(F.get_json_object(body, "$.pull_request.head.sha"), F.get_json_object(body, "$.after"))
