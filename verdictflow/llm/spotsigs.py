"""Document fingerprints by SpotSigs.

A spot is a common word (the anchor) with the chain of the next content words after it; a document's signature set holds
a 48-bit hash of each distinct spot.  The fingerprint is that set in order, written in hex, so equal texts have equal
fingerprints and two fingerprints give the exact Jaccard likeness of their sets.  Sets whose lengths alone rule a
threshold out are not compared: that bound prunes ``pruned_jaccard``, and ``similar`` joins only adjacent partitions by
length.

Edge cases: a null or empty text has the empty fingerprint; a text with few spots is known by them and its words; equal
fingerprints have likeness 1, also empty ones; texts of any length are read whole; ties of doc_id are ordered by text,
null ids come last; an empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import slices, stored, table, text_of
from .quality_rules import STOP_WORDS

CHAIN = 2
#: With fewer spots than this, or than one in so many words, the words themselves are added.
LEAST_SPOTS, LEAST_SHARE = 8, 20
ANCHORS = frozenset(w for ws in STOP_WORDS.values() for w in ws.split())
PUNCTUATION = ".,;:!?\"'()[]{}«»“”„…*$%&#|-"
MASK = (1 << 48) - 1
#: Ranges of ids that are walked in order; each is about ROWS documents, and there are at most MOST of them.
ROWS, MOST = 1024, 20_000


def signatures(text: str) -> np.ndarray:
    """Sorted distinct spot hashes."""
    import xxhash

    digest = xxhash.xxh3_64_intdigest
    words = [w if w.isalnum() else w.strip(PUNCTUATION) for w in text.lower().split()]
    content = [w for w in words if w and w not in ANCHORS]
    found, k = [], 0
    for w in words:
        if w in ANCHORS:
            chain = content[k : k + CHAIN]
            if len(chain) == CHAIN:
                found.append(f"{w} {' '.join(chain)}")
        elif w:
            k += 1
    spots = set(found)
    if len(spots) < max(LEAST_SPOTS, len(words) // LEAST_SHARE):
        spots.update(w for w in words if w)
    return np.unique(np.array([digest(s) & MASK for s in spots], np.uint64))


def fingerprint(spots: np.ndarray) -> str:
    return spots.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 2:].tobytes().hex() if len(spots) else ""


def pruned_jaccard(a: np.ndarray, b: np.ndarray, threshold: float = 0.0) -> float:
    """Exact where it reaches threshold; 0 where the lengths rule that out."""
    if not len(a) and not len(b):
        return 1.0
    if min(len(a), len(b)) < threshold * max(len(a), len(b)) - 1e-9:
        return 0.0
    common = len(np.intersect1d(a, b, assume_unique=True))
    return common / (len(a) + len(b) - common)


def edited(text: str, following: str) -> str:
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _sha(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()


NAMES = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "n_spots"]
TYPES = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.int64()]
SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, n_spots long"


def _greatest(docs: DataFrame, near: list[float]) -> np.ndarray:
    """Sorted: the greatest id up to each bound, and of all.  Bounds are doubles, so no id need equal one."""
    bounds = np.array(sorted({min(int(x), (1 << 63) - 1) for x in near}), np.int64)

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = np.sort(batch.column(0).to_numpy(zero_copy_only=False))
            at = np.searchsorted(bounds, ids)
            ends = np.flatnonzero(np.append(at[1:] != at[:-1], True)) if len(ids) else []
            yield pa.RecordBatch.from_arrays([pa.array(at[ends], pa.int32()), pa.array(ids[ends], pa.int64())], ["at", "doc_id"])

    found = docs.select("doc_id").where("doc_id IS NOT NULL").mapInArrow(ends, "at int, doc_id long").groupBy("at").agg(F.max("doc_id").alias("doc_id"))
    return np.array(sorted(r.doc_id for r in found.collect()), np.int64)


def with_next(docs: DataFrame) -> DataFrame:
    """Fingerprints of docs (doc_id, text), of each edited text, and their likeness.

    The ids are cut into ranges at ids that occur.  A range's greatest document goes to its own range and, as the one
    that follows, to the range before; so each range can be walked in order by itself, with two documents in memory.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    n, top = docs.agg(F.count(F.lit(1)), F.max("doc_id")).first()
    ranges = max(1, min(MOST, n // ROWS))
    near = docs.stat.approxQuantile("doc_id", [i / ranges for i in range(1, ranges)], 0.1 / ranges) if ranges > 1 else []
    cuts = _greatest(docs, near) if near else np.array([] if top is None else [top], np.int64)
    last = max(0, len(cuts) - 1)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Adds the row's range, 0 for the greatest ids, and whether it is its range's head."""
        for batch in batches:
            ids = batch.column(0)
            known = ids.fill_null(0).to_numpy(zero_copy_only=False)
            at = np.searchsorted(cuts, known) if len(cuts) else np.zeros(len(known), np.int64)
            is_null = ids.is_null().to_numpy(zero_copy_only=False)
            found = np.where(is_null, last, last - np.minimum(at, last))
            head = ~is_null & (cuts[np.minimum(at, last)] == known) if len(cuts) else np.zeros(len(known), bool)
            yield pa.RecordBatch.from_arrays([ids, batch.column(1), pa.array(found, pa.int32()), pa.array(head, pa.bool_())], ["doc_id", "text", "part", "head"])

    placed = docs.mapInArrow(place, "doc_id long, text string, part int, head boolean")
    if top is None:  # no id at all: one range, whose first document follows its last
        placed = placed.withColumn("head", F.lit(True))
    before = F.when(F.col("part") == 0, last).otherwise(F.col("part") - 1)
    own = F.struct(F.col("part").alias("part"), F.lit(0).alias("role"))
    dealt = placed.withColumn("to", F.explode(F.when(F.col("head"), F.array(own, F.struct(before.alias("part"), F.lit(1).alias("role")))).otherwise(F.array(own))))
    dealt = dealt.select(F.col("to.part").alias("part"), F.col("to.role").alias("role"), "doc_id", "text")
    ordered = dealt.repartition("part").sortWithinPartitions("part", "role", F.col("doc_id").desc_nulls_last(), "text")

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in slices(batches):
            out = []
            for part, role, doc_id, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and held[0] == part:
                    here = signatures(text)
                    out.append(_compared(held[1], held[2], held[3], text, here))
                    held = (part, doc_id, text, here) if role == 0 else None
                elif role == 0:
                    held = (part, doc_id, text, signatures(text))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(TYPES)], NAMES)

    return ordered.mapInArrow(walk, SCHEMA)


def _compared(doc_id: int | None, text: str, spots: np.ndarray, following: str, next_spots: np.ndarray) -> tuple:
    changed = edited(text, following)
    changed_spots = signatures(changed)
    return doc_id, len(text), _sha(changed), fingerprint(spots), fingerprint(changed_spots), pruned_jaccard(spots, changed_spots), pruned_jaccard(spots, next_spots), len(spots)


def similar(docs: DataFrame, threshold: float, salts: int = 8) -> tuple[DataFrame, DataFrame]:
    """(pairs, members) of docs (doc_id, text) for a likeness of threshold (above 0, below 1).

    members: row, doc_id, rep, one row per document; documents of equal sets share a rep.  pairs: rep, other_rep,
    likeness of all pairs of different sets whose likeness reaches threshold; copies are not expanded.

    Partitions of set length are joined with themselves and the next one.  Two such sets share one of their rarest
    spots, as many as a set may lack plus one, so those alone are keys.  A key's left side is dealt to salts, its right
    side is repeated for each, so that a spot that many sets share is no single task.
    """

    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sets = [signatures(t).astype(np.int64) for t in batch.column(2).to_pylist()]
            digests = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(digests, pa.binary()), pa.array(sets, pa.list_(pa.int64()))], ["row", "doc_id", "digest", "spots"])

    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    sets = stored(rows.mapInArrow(signed, "row long, doc_id long, digest binary, spots array<long>"), "spots")
    reps = stored(sets.groupBy("digest").agg(F.min("row").alias("rep")), "spots-reps")
    members = sets.select("row", "doc_id", "digest").join(reps, "digest").drop("digest")
    known = stored(sets.join(reps.select(F.col("rep").alias("row")), "row").where("size(spots) > 0").select("row", "spots"), "spots-known")
    common = stored(known.select(F.explode("spots").alias("spot")).groupBy("spot").agg(F.count(F.lit(1)).alias("df")), "spots-common")
    ranked = known.select("row", F.explode("spots").alias("spot")).join(common, "spot").groupBy("row").agg(F.sort_array(F.collect_list(F.struct("df", "spot"))).alias("s"))
    n = F.size("s")
    part = F.floor(F.log(n.cast("double")) / F.lit(-math.log(threshold)) + 1e-9).cast("int")
    prefix = F.slice("s", F.lit(1), n - F.ceil(n * threshold - 1e-9).cast("int") + 1)
    keyed = stored(ranked.select("row", part.alias("part"), F.explode(prefix).alias("k")).select("row", "part", F.col("k.spot").alias("key")), "spots-keyed")
    left = keyed.select(F.col("row").alias("a"), F.col("part").alias("part_a"), "part", "key", F.pmod(F.xxhash64("row"), F.lit(salts)).alias("salt"))
    right = keyed.select(F.col("row").alias("b"), F.col("part").alias("part_b"), F.explode(F.array(F.col("part"), F.col("part") - 1)).alias("part"), "key").withColumn("salt", F.explode(F.array(*[F.lit(i).cast("long") for i in range(salts)])))
    pairs = left.join(right, ["part", "key", "salt"]).where("part_b > part_a OR a < b").select("a", "b").distinct()
    side = lambda row, spots: known.select(F.col("row").alias(row), F.col("spots").alias(spots))
    both = pairs.join(side("a", "x"), "a").join(side("b", "y"), "b").select("a", "b", "x", "y")

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            x, y = batch.column(2), batch.column(3)
            likeness = [pruned_jaccard(x[i].values.to_numpy(), y[i].values.to_numpy(), threshold) for i in range(len(batch))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(likeness, pa.float64())], ["rep", "other_rep", "likeness"])

    return both.mapInArrow(compared, "rep long, other_rep long, likeness double").where(F.col("likeness") >= threshold), members


def op7_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_next(table(spark, sf_dir, "documents"))
