"""Connected components of an edge table, by alternating large and small stars.

Every round is a few joins and aggregates over written tables; the driver sees two numbers per round.  Minima are
written before they are joined back, so that Spark can split the join at a vertex with very many edges.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, stored


def _star(edges: DataFrame, label: str) -> DataFrame:
    """edges (u, v): each u's neighbours v, and u itself, linked to the least among them."""
    least = stored(edges.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), f"{label}-least")
    linked = edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    out = stored(linked.where("u <> v").distinct(), label)
    discard(least)
    return out


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def connected_components(edges: DataFrame) -> DataFrame:
    """(id, root) for every vertex of edges (u, v) but the roots themselves; root is the least vertex of the component."""
    edges = stored(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "cc")
    before = _state(edges)
    while before[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _star(both, "cc-large").where("u > v")
        small = _star(large, "cc-small")
        discard(edges, large)
        edges, now = small, _state(small)
        if now == before:
            break
        before = now
    return edges.select(F.col("u").alias("id"), F.col("v").alias("root"))
