"""MinHash near-dedup by a multi-index Hamming join.

1. A document's set of word shingles is hashed to 64 bits each; K minima under K hash functions, cut to b = 16 bits, are
   its signature.  Documents with equal sets are one representative, known by a 128-bit digest of the set.
2. The K positions are split into chunks of CHUNK.  If two signatures differ in at most THRESHOLD = 2 * chunks - 1
   positions, some chunk has at most one error (pigeonhole); so each chunk is keyed once for each position left out, and
   any such pair shares a key.  A pair shares no key with a probability below 1e-10 at a similarity of 0.85, below
   1e-8 at 0.8.
3. In each bucket every member is linked to the least one, or to one that is: as many rows as members, never all pairs.
   Tasks combine their buckets before the shuffle.  The components of these links hold every pair that shares a key.
4. Within a component, pairs up to COMPARED that are not connected yet are compared on their full sets, counted over an
   inverted index, from the most central signature outwards.  A component of up to BLOCK_DOCS is one task.
5. Of a larger one, each member is first compared with the leader of most of its buckets, in groups of about STAR_DOCS
   around a leader, so a group of n near copies costs n.  What is confirmed makes classes.
6. Components that still hold two classes are cut into blocks, of one class each where a class is large; every two
   blocks meet in a task of their own, but for blocks of one class.  So no pair that shares a key goes uncompared, and a
   large class costs its size for each block of others, not its square.  Blocks are dealt by hash: BLOCK_DOCS is the
   mean of their size.

Edge cases: null and empty texts have an empty set and are linked with nothing; with fewer words than a shingle, the
whole sequence is one; rows that share a doc_id are one document (its texts' links are its own), of which ``stage``
keeps every distinct text once; a row with a null doc_id is linked with nothing and kept; an empty table gives an empty
table; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import content_hash, discard, slices, stored, table, text_of
from .components import connected_components

POSITIONS, CHUNK = 70, 5
CHUNKS = POSITIONS // CHUNK
THRESHOLD = 2 * CHUNKS - 1
#: Candidates are compared up to this distance: the buckets also hold pairs beyond THRESHOLD, and at a similarity of 0.8
#: one pair in 10,000 lies there.
COMPARED = THRESHOLD + 9
#: A block: so many documents, or so many shingles.
BLOCK_DOCS, BLOCK_SHINGLES = 512, 1_500_000
#: So many documents around a leader are one group; classes follow so many links.
STAR_DOCS, STEPS = 128, 4
#: Signatures whose buckets a task combines at a time: 70 keys each, some 60 MB with their order.
COMBINED = 1 << 14

_M1, _M2, _STEP = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)
_BASE = 0x100000001B3
_RNG = np.random.default_rng(20240607)
_XOR = _RNG.integers(0, 2**64, POSITIONS, dtype=np.uint64)
_ODD = _RNG.integers(0, 2**64, POSITIONS, dtype=np.uint64) | np.uint64(1)
_POWERS = np.ones(1, np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x + _STEP) ^ ((x + _STEP) >> np.uint64(30))
    x = x * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> np.ndarray:
    global _POWERS
    if len(_POWERS) < n:
        _POWERS = np.cumprod(np.full(max(n, 64), _BASE, np.uint64)) * np.uint64(pow(_BASE, -1, 2**64))
    return _POWERS


def word_hashes(text: str) -> np.ndarray:
    """A 64-bit hash of each word, A-Z lower-cased; computed over the whole byte array at once."""
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    inside = ~((raw == 32) | ((raw >= 9) & (raw <= 13)))
    edge = np.diff(inside.astype(np.int8), prepend=0, append=0)
    lengths = np.flatnonzero(edge < 0) - np.flatnonzero(edge > 0)
    if not len(lengths):
        return np.zeros(0, np.uint64)
    body = raw[inside]
    body = body + ((body >= 65) & (body <= 90)).astype(np.uint8) * np.uint8(32)
    first = np.cumsum(lengths) - lengths
    place = np.arange(len(body)) - np.repeat(first, lengths)
    sums = np.add.reduceat((body.astype(np.uint64) + np.uint64(1)) * _powers(int(lengths.max()))[place], first)
    return mixed(sums ^ (lengths.astype(np.uint64) << np.uint64(48)))


def shingle_set(text: str, width: int) -> np.ndarray:
    """Sorted distinct hashes of the width-word shingles."""
    w = word_hashes(text)
    if not len(w):
        return w
    n = max(1, len(w) - width + 1)
    k = min(width, len(w))
    h = np.full(n, k, np.uint64)
    for i in range(k):
        h = mixed(h * _M2 + w[i : i + n])
    return np.unique(h)


def signature(shingles: np.ndarray) -> np.ndarray:
    low = np.full(POSITIONS, np.uint64(2**64 - 1))
    for at in range(0, len(shingles), 1024):
        part = shingles[at : at + 1024, None]
        np.minimum(low, ((part ^ _XOR) * _ODD).min(0), out=low)
    return (mixed(low) & np.uint64(0xFFFF)).astype("<u2")


def sign(docs: DataFrame, width: int) -> DataFrame:
    """docs (doc_id, text) to doc_id, n_shingles, d1, d2, sig."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            n, d1, d2, sig = [], [], [], []
            for text in batch.column(1).to_pylist():
                s = shingle_set(text, width)
                n.append(len(s))
                a, b = np.frombuffer(hashlib.blake2b(s.tobytes(), digest_size=16).digest(), "<i8")
                d1.append(int(a))
                d2.append(int(b))
                sig.append(signature(s).tobytes() if len(s) else None)
            columns = [batch.column(0), pa.array(n, pa.int64()), pa.array(d1, pa.int64()), pa.array(d2, pa.int64()), pa.array(sig, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_shingles", "d1", "d2", "sig"])

    return docs.mapInArrow(run, "doc_id long, n_shingles long, d1 long, d2 long, sig binary")


def bucket_keys(sigs: np.ndarray) -> np.ndarray:
    """Per signature, the key of each of its buckets: four of a chunk's five positions, and which ones these are."""
    wide = sigs.astype(np.uint64)
    keys = np.empty((len(sigs), POSITIONS), np.uint64)
    for k in range(POSITIONS):
        c, left_out = divmod(k, CHUNK)
        value = np.uint64(0)
        for p in range(CHUNK):
            if p != left_out:
                value = value << np.uint64(16) | wide[:, c * CHUNK + p]
        keys[:, k] = mixed(value ^ _XOR[k])
    return keys.astype(np.int64)


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<u2").reshape(-1, POSITIONS)


def _combined(ids: np.ndarray, sigs: np.ndarray) -> Iterator[pa.RecordBatch]:
    """What some signatures say of their buckets: each bucket's least id, and links of the others to it."""
    by_id = np.argsort(ids, kind="stable")
    ids, keys = ids[by_id], bucket_keys(sigs[by_id]).ravel()
    order = np.argsort(keys, kind="stable")
    first = np.append(True, np.diff(keys[order]) != 0)
    row = order // POSITIONS
    leader = row[first][np.cumsum(first) - 1]
    pairs, shared = np.unique((row * len(ids) + leader)[row != leader], return_counts=True)
    u, v = ids[pairs // len(ids)], ids[pairs % len(ids)]
    parts = [(False, keys[order][first], ids[row[first]], ids[row[first]], np.ones(first.sum(), np.int64)), (True, u, u, v, shared)]
    for link, *columns in parts:
        for i in range(0, len(columns[0]), 1 << 16):
            part = [pa.array(c[i : i + (1 << 16)], pa.int64()) for c in columns]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part[0]), link)), *part], ["link", "key", "u", "v", "shared"])


def bucket_links(reps: DataFrame) -> DataFrame:
    """(u, v, shared): each representative, the least one of a bucket that it is in, and in how many buckets it is that.

    Tasks combine the buckets of COMBINED signatures at a time before anything is shuffled: a bucket with very many
    members arrives as a few local leaders, and the members are linked with those.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def done() -> Iterator[pa.RecordBatch]:
            ids = np.concatenate([b.column(0).to_numpy() for b in held])
            sigs = np.concatenate([_matrix(b.column(1)) for b in held])
            held.clear()
            yield from _combined(ids, sigs)

        for batch in slices(batches, COMBINED):
            if held and sum(b.num_rows for b in held) + batch.num_rows > COMBINED:
                yield from done()
            held.append(batch)
        if held:
            yield from done()

    rows = reps.select("id", "sig").mapInArrow(run, "link boolean, key long, u long, v long, shared long")
    least = F.first("u").over(Window.partitionBy("link", "key").orderBy("u").rowsBetween(Window.unboundedPreceding, 0))
    pairs = rows.withColumn("v", F.when(F.col("link"), F.col("v")).otherwise(least)).where("u <> v")
    return stored(pairs.groupBy("u", "v").agg(F.sum("shared").alias("shared")), "dedup-bucket-links")


def confirm(classes: np.ndarray, texts: list[str], side: np.ndarray, width: int, percent: int) -> tuple[list[tuple[int, int]], np.ndarray]:
    """Links between side 1 and side 2 (or all where there is but one side), as pairs of places that join two classes of
    rows, and the class that each row is in at last, as the place of one of its rows."""
    sets = [shingle_set(t, width) for t in texts]
    g = len(sets)
    sizes = np.array([len(s) for s in sets])
    sigs = np.stack([signature(s) for s in sets])
    _, first, inverse = np.unique(classes, return_index=True, return_inverse=True)
    parent = first[inverse]
    flat = np.concatenate(sets)
    owner = np.repeat(np.arange(g), sizes)
    by_value = np.argsort(flat, kind="stable")
    values = flat[by_value]
    starts = np.flatnonzero(np.r_[True, values[1:] != values[:-1]])
    ends = np.r_[starts[1:], len(values)]
    posting = owner[by_value]
    mode = np.array([np.bincount(column).argmax() for column in sigs.T]) if g > 2 else sigs[0]
    two_sided = len(np.unique(side)) > 1
    links = []
    for x in np.argsort((sigs != mode).sum(1), kind="stable"):
        other = parent != parent[x]
        if two_sided:
            other &= side != side[x]
        other &= (np.minimum(sizes, sizes[x]) * 100 >= np.maximum(sizes, sizes[x]) * percent)
        if not other.any():
            continue
        near = np.flatnonzero(other)
        near = near[(sigs[near] != sigs[x]).sum(1) <= COMPARED]
        if not len(near):
            continue
        if len(near) <= 4:
            common = np.array([len(np.intersect1d(sets[x], sets[y], assume_unique=True)) for y in near])
        else:
            at = np.searchsorted(values[starts], sets[x])
            counts = ends[at] - starts[at]
            rows = np.repeat(starts[at] - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())
            common = np.bincount(posting[rows], minlength=g)[near]
        union = sizes[x] + sizes[near] - common
        linked = near[common * 100 >= union * percent]
        if len(linked):
            joined, at = np.unique(parent[linked], return_index=True)
            links += [(int(x), int(linked[k])) for k in at]
            parent[np.isin(parent, joined) | (parent == parent[x])] = joined[0]
    return links, parent


def _compare(width: int, percent: int):
    """For applyInArrow over (id, cls, side, text): u, v, the links that join classes."""

    def run(t: pa.Table) -> pa.Table:
        ids = t.column("id").to_numpy()
        links, _ = confirm(t.column("cls").to_numpy(), t.column("text").to_pylist(), t.column("side").to_numpy(), width, percent)
        return pa.table({"u": pa.array([ids[x] for x, _ in links], pa.int64()), "v": pa.array([ids[y] for _, y in links], pa.int64())})

    return run


def blocks_of(n_docs: Column, n_shingles: Column, docs: int | None = None) -> Column:
    return F.ceil(F.greatest(n_docs / (docs or BLOCK_DOCS), n_shingles / BLOCK_SHINGLES)).cast("int")


def star_links(big: DataFrame, links: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """(u, v): members of big (id, n, ...) that are linked with the leader of most of their buckets; v < u.

    links: (u, v, shared).  Around a leader with very many members there are many groups, each with the leader's text.
    """
    sizes = big.groupBy(F.col("id").alias("u")).agg(F.sum("n").alias("n"))
    best = links.join(sizes, "u").groupBy("u").agg(F.max(F.struct("shared", (-F.col("v")).alias("least"), "v", "n")).alias("b")).select("u", "b.v", "b.n")
    best = stored(best, "dedup-best")
    groups = stored(best.groupBy("v").agg(blocks_of(F.count(F.lit(1)), F.sum("n"), STAR_DOCS).alias("salts")), "dedup-stars")
    around = best.join(groups, "v").select("v", F.pmod(F.xxhash64("u"), F.col("salts")).cast("int").alias("salt"), F.col("u").alias("id"), F.lit(1).alias("side"))
    leader = groups.select("v", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.col("v").alias("id"), F.lit(2).alias("side"))
    whole = around.unionByName(leader).join(texts, "id").select("v", "salt", "id", F.col("id").alias("cls"), "side", "text")
    found = whole.groupBy("v", "salt").applyInArrow(_compare(width, percent), "u long, v long")
    out = stored(found.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "dedup-star-links")
    discard(best, groups)
    return out


def with_classes(big: DataFrame, links: DataFrame) -> DataFrame:
    """big with cls: where a few steps along links lead, each to the least v of u.  Members of one class are connected;
    connected members may be in several."""
    up = links.groupBy("u").agg(F.min("v").alias("v"))
    out = big.withColumn("cls", F.col("id"))
    for k in range(STEPS):
        step = up.select(F.col("u").alias("cls"), F.col("v").alias(f"__v{k}"))
        out = out.join(step, "cls", "left").withColumn("cls", F.coalesce(f"__v{k}", "cls")).drop(f"__v{k}")
    return out


def block_links(big: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """(u, v): links that join classes, of all pairs of big (id, root, cls, n) in one component and in two classes."""
    several = big.groupBy("root").agg(F.min("cls").alias("a"), F.max("cls").alias("b")).where("a <> b").select("root")
    members = big.groupBy("id").agg(F.min("root").alias("root"), F.min("cls").alias("cls"), F.sum("n").alias("n"))
    still = stored(members.join(several, "root", "left_semi"), "dedup-open")
    of_class = still.groupBy("root", "cls").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("n").alias("n"))
    of_class = of_class.withColumn("pure", blocks_of(F.col("n_docs"), F.col("n")) > 1).withColumn("own", F.when(F.col("pure"), F.col("cls")).otherwise(0))
    groups = of_class.groupBy("root", "pure", "own").agg(blocks_of(F.sum("n_docs"), F.sum("n")).alias("blocks"))
    in_order = Window.partitionBy("root").orderBy("pure", "own").rowsBetween(Window.unboundedPreceding, 0)
    groups = groups.withColumn("base", (F.sum("blocks").over(in_order) - F.col("blocks")).cast("int")).withColumn("all", F.sum("blocks").over(Window.partitionBy("root")).cast("int"))
    places = stored(of_class.select("root", "cls", "pure", "own").join(groups, ["root", "pure", "own"]).drop("own"), "dedup-places")
    dealt = still.join(places, ["root", "cls"]).withColumn("at", F.col("base") + F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("met", F.explode(F.sequence(F.lit(0), F.col("all") - 1)))
    dealt = dealt.where("NOT pure OR met < base OR met >= base + blocks")
    dealt = dealt.select("root", F.least("at", "met").alias("i"), F.greatest("at", "met").alias("j"), "id", "cls", F.when(F.col("at") <= F.col("met"), 1).otherwise(2).alias("side"))
    whole = dealt.join(texts, "id")
    out = stored(whole.groupBy("root", "i", "j").applyInArrow(_compare(width, percent), "u long, v long"), "dedup-block-links")
    discard(still, places)
    return out


def classes_of_large(big: DataFrame, links: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """(id, root) of the members of large components, big (id, root, n), that are not roots."""
    near = star_links(big, links, texts, width, percent)
    classed = stored(with_classes(big, near), "dedup-classed")
    found = block_links(classed, texts, width, percent)
    out = stored(connected_components(near.unionByName(found)), "dedup-classes")
    discard(near, classed, found)
    return out


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept.  Links are 100 * common >= percent * union."""
    if percent < 80:
        raise ValueError("the signature threshold is set for similarities of 0.8 or more")
    source = docs.select(F.col(key).cast("long").alias("doc_id"), text_of(text).alias("text"))
    signed = stored(sign(source, width), "dedup-signed")
    some = signed.where("n_shingles > 0 AND doc_id IS NOT NULL")
    reps = stored(some.groupBy("d1", "d2").agg(F.min("doc_id").alias("id"), F.max("n_shingles").alias("n"), F.max("sig").alias("sig")), "dedup-reps")
    links = bucket_links(reps)
    linked = stored(connected_components(links.select("u", "v")), "dedup-roots")
    members = linked.unionByName(linked.select(F.col("root").alias("id"), "root").distinct()).join(reps.select("id", "n"), "id")
    members = stored(members.groupBy("id", "root").agg(F.sum("n").alias("n")), "dedup-members")
    large = stored(members.groupBy("root").agg(blocks_of(F.count(F.lit(1)), F.sum("n")).alias("blocks")).where("blocks > 1").select("root"), "dedup-large")

    def of_one(t: pa.Table) -> pa.Table:
        ids = t.column("id").to_numpy()
        _, parent = confirm(ids, t.column("text").to_pylist(), np.zeros(len(ids)), width, percent)
        least = {p: ids[parent == p].min() for p in np.unique(parent)}
        found = {int(i): int(least[p]) for i, p in zip(ids, parent, strict=True) if i != least[p]}
        return pa.table({"id": pa.array(found.keys(), pa.int64()), "root": pa.array(found.values(), pa.int64())})

    # All sizes take the same way: the members are not bounded, so they are never broadcast.
    texts = stored(members.select("id", "root").hint("merge").join(source.withColumnRenamed("doc_id", "id"), "id"), "dedup-texts")
    small = texts.join(large, "root", "left_anti").select("id", "root", "text")
    classes = stored(small.groupBy("root").applyInArrow(of_one, "id long, root long"), "dedup-links")
    if not large.isEmpty():
        big = stored(members.join(large, "root", "left_semi").select("id", "root").join(reps.select("id", "n"), "id"), "dedup-big")
        classes = classes.unionByName(classes_of_large(big, links, texts.join(large, "root", "left_semi").select("id", "text"), width, percent))
        discard(big)
    named = reps.select("d1", "d2", "id").join(classes, "id", "left")
    named = stored(named.select("d1", "d2", F.coalesce("root", "id").alias("root")), "dedup-named")
    discard(reps, links, linked, members, large, texts)
    joined = signed.drop("sig").join(named, ["d1", "d2"], "left")
    alone = F.col("doc_id").isNull() | (F.col("n_shingles") == 0)
    component = F.when(alone, F.col("doc_id")).otherwise(F.col("root"))
    return joined.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def op5_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), width=3, percent=85)


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group, the one with the least doc_id; five-word shingles, similarity 0.8.

    Of rows with one doc_id, each distinct text stays once.
    """
    kept = near_duplicates(docs).where("kept").select(F.col("doc_id").alias("__id")).distinct()
    joined = docs.select(F.struct("*").alias("__row"), F.col("doc_id").alias("__of"), F.xxhash64("text").alias("__text"), content_hash(docs).alias("__content"))
    joined = joined.join(kept, F.col("__of") == F.col("__id"))
    first = F.row_number().over(Window.partitionBy("__id", "__text").orderBy("__content"))
    return joined.withColumn("__n", first).where("__n = 1").select("__row.*").unionByName(docs.where("doc_id IS NULL"))


#: DuckDB; sets are compared where they share one of their rarest shingles, components by reaching ever smaller ids.
ORACLE = r"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS rid, doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents
), s AS (
  SELECT rid, doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')]
    ELSE list_sort(list_distinct(list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2]))) END AS sh FROM d
), r AS (
  SELECT sha256(array_to_string(sh, chr(10))) AS h, min(doc_id) AS rep, max(len(sh))::BIGINT AS n, any_value(sh) AS sh FROM s WHERE len(sh) > 0 GROUP BY h
), x AS (SELECT rep, n, unnest(sh) AS w FROM r), rare AS (
  SELECT rep, n, w FROM (SELECT *, row_number() OVER (PARTITION BY rep ORDER BY c, w) AS k FROM (SELECT *, count(*) OVER (PARTITION BY w) AS c FROM x)) WHERE k <= n - (85 * n + 99) // 100 + 1
), cand AS (
  SELECT DISTINCT a.rep AS a, b.rep AS b FROM rare a JOIN rare b ON a.w = b.w AND a.rep < b.rep AND least(a.n, b.n) * 100 >= greatest(a.n, b.n) * 85
), e AS (
  SELECT a, b FROM (SELECT a, b, len(list_intersect(p.sh, q.sh)) AS i, p.n + q.n AS t FROM cand JOIN r p ON p.rep = a JOIN r q ON q.rep = b) WHERE 100 * i >= 85 * (t - i)
), ed AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e), reach AS (
  SELECT rep AS id, rep AS m FROM r UNION SELECT ed.b, reach.m FROM reach JOIN ed ON ed.a = reach.id WHERE reach.m < ed.b
), c AS (SELECT id, min(m) AS root FROM reach GROUP BY id)
SELECT s.doc_id, len(s.sh)::BIGINT AS n_shingles, coalesce(c.root, s.doc_id) AS component_id, coalesce(c.root, s.doc_id) = s.doc_id AS kept
FROM s LEFT JOIN r ON len(s.sh) > 0 AND r.h = sha256(array_to_string(s.sh, chr(10))) LEFT JOIN c ON c.id = r.rep
"""
