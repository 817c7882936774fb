"""Training-order materialisation: a keyed Feistel permutation with cycle-walking gives every sequence a global slot;
range partitions of the slots write shards of fixed stride, for sequential reads that can start anywhere.

Documents are encoded to token ids and packed end to end, each followed by SEPARATOR, into one stream in the order of
(doc_id, a hash of the text); null ids come first.  Sequence s holds the ids s * SEQUENCE .. of the stream, the last one
padded with PAD, and the permutation sends s to its slot.  So the order depends on the key and the rows alone, not on
how the input is split.  Shard k holds slots k * SHARD .. as records of STRIDE bytes, little-endian uint16: slot s
stands at byte (s % SHARD) * STRIDE of shard s // SHARD.  An index row tells where each piece of a document stands.

1. A first scan counts ids.  The counts, some 40 bytes a document, are ranged by (doc_id, hash) and summed up, and each
   scan task's own places in the stream are written as one partition of a table.
2. A second scan reads its places, encodes again and cuts the ids into pieces with their slots; it stops with an error
   if a row's count is not the one that was written.  Encoding twice costs less than a written table of ids.
3. The pieces go to range partitions of slots, are sorted there and written front to back, one batch in memory.

Edge cases: a null or empty text has no ids and stands as a separator, so that every row can be found; null ids stay
null; equal rows are interchangeable and each has a place of its own; an empty table writes nothing; other columns are
not read; texts of any length are written whole.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, remove, scratch, slices, stored, table, text_of

SEQUENCE = 1024
PAD = 0xFFFF
SHARD = 4096
KEY = b"training-order-1"
ROUNDS = 6
#: Ranges of about ROWS documents are summed up by themselves, and there are at most MOST of them; so many partitions,
#: at most, write shards.
ROWS, MOST, MOST_WRITERS = 1 << 16, 20_000, 200_000


class Feistel:
    """A keyed permutation of 0 .. n-1: a balanced network over the next even power of two, walked until inside."""

    def __init__(self, n: int, key: bytes = KEY, rounds: int = ROUNDS) -> None:
        self.n = n
        self.half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
        self.mask = np.uint64((1 << self.half) - 1)
        self.keys = [np.uint64(int.from_bytes(hashlib.blake2b(bytes([r]), key=key, digest_size=8).digest(), "little")) for r in range(rounds)]

    def _round(self, x: np.ndarray, key: np.uint64) -> np.ndarray:
        x = (x ^ key) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        return (x ^ (x >> np.uint64(29))) & self.mask

    def _once(self, x: np.ndarray) -> np.ndarray:
        left, right = x >> np.uint64(self.half), x & self.mask
        for k in self.keys:
            left, right = right, left ^ self._round(right, k)
        return left << np.uint64(self.half) | right

    def _once_back(self, x: np.ndarray) -> np.ndarray:
        left, right = x >> np.uint64(self.half), x & self.mask
        for k in reversed(self.keys):
            left, right = right ^ self._round(left, k), left
        return left << np.uint64(self.half) | right

    def _walk(self, x: np.ndarray, step) -> np.ndarray:
        out = step(np.asarray(x, np.uint64))
        while (outside := out >= np.uint64(self.n)).any():
            out[outside] = step(out[outside])
        return out.astype(np.int64)

    def slots(self, numbers: np.ndarray) -> np.ndarray:
        return self._walk(numbers, self._once)

    def numbers(self, slots: np.ndarray) -> np.ndarray:
        return self._walk(slots, self._once_back)


@lru_cache(maxsize=2)
def encoder(pattern: str, source: str):
    """An encoder of the vocabulary in a file of ranks, and the first free id.  Special tokens' strings are ordinary text."""
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in source.splitlines() if line)}
    free = max(ranks.values()) + 1
    if free >= PAD:
        raise ValueError("token ids of 16 bits are needed")
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}), free


def counted(docs: DataFrame, pattern: str, source) -> DataFrame:
    """task, pos, doc_id, hash, n of docs (doc_id, text): a row's place in the scan and its ids, the separator included."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        encode, pos, task = encoder(pattern, source.value)[0].encode_ordinary, 0, TaskContext.get().partitionId()
        for batch in slices(batches):
            texts, k = batch.column(1).to_pylist(), batch.num_rows
            hashes = np.array([xxhash.xxh3_64_intdigest(x) for x in texts], np.uint64).astype(np.int64)
            n = [len(encode(x)) + 1 for x in texts]
            yield pa.RecordBatch.from_arrays([pa.array([task] * k, pa.int32()), pa.array(np.arange(pos, pos + k)), batch.column(0), pa.array(hashes), pa.array(n, pa.int64())], ["task", "pos", "doc_id", "hash", "n"])
            pos += k

    return docs.mapInArrow(run, "task int, pos long, doc_id long, hash long, n long")


def write_places(docs: DataFrame, pattern: str, source) -> tuple[str, int]:
    """Write where each row's ids begin in the stream, by task of the scan; the folder, and the length of the stream."""
    counts = stored(counted(docs, pattern, source), "order-counts")
    order = ["doc_id", "hash", "task", "pos"]
    ranged = stored(counts.repartitionByRange(max(1, min(MOST, counts.count() // ROWS)), *order).withColumn("range", F.spark_partition_id()), "order-ranges")
    discard(counts)
    sums = dict(ranged.groupBy("range").agg(F.sum("n")).collect())
    bases, total = np.zeros(max(sums, default=0) + 1, np.int64), 0
    for r in sorted(sums):
        bases[r] = total
        total += sums[r]
    bases = [int(b) for b in bases]

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by range and order."""
        at, of = 0, None
        for batch in batches:
            ranges, n = batch.column(0).to_numpy(), batch.column(3).to_numpy()
            for part in np.split(np.arange(len(n)), np.flatnonzero(np.diff(ranges)) + 1):
                if not len(part):
                    continue
                if ranges[part[0]] != of:
                    of = ranges[part[0]]
                    at = bases[of]
                ends = at + np.cumsum(n[part])
                yield pa.RecordBatch.from_arrays([batch.column(1).take(pa.array(part)), batch.column(2).take(pa.array(part)), pa.array(n[part]), pa.array(ends - n[part])], ["task", "pos", "n", "at"])
                at = int(ends[-1])

    running = ranged.repartition("range").sortWithinPartitions("range", *order).select("range", "task", "pos", "n").mapInArrow(summed, "task int, pos long, n long, at long")
    folder = scratch(docs.sparkSession, "order-places")
    running.repartition("task").sortWithinPartitions("task", "pos").write.partitionBy("task").parquet(folder)
    discard(ranged)
    return folder, total


def _places(folder: str, task: int) -> tuple[np.ndarray, np.ndarray]:
    """(n, at) of the rows of one task, in the order of its scan."""
    fs, path = pafs.FileSystem.from_uri(folder)
    found = [f.path for f in fs.get_file_info(pafs.FileSelector(f"{path}/task={task}")) if f.path.endswith(".parquet")]
    t = pa.concat_tables([pq.ParquetFile(fs.open_input_file(f)).read() for f in found]).sort_by("pos")
    if not np.array_equal(t["pos"].to_numpy(), np.arange(len(t))):
        raise ValueError("the places of a task are incomplete")
    return t["n"].to_numpy(), t["at"].to_numpy()


def sequences(docs: DataFrame, pattern: str, source, places: tuple[str, int], sequence: int = SEQUENCE, key: bytes = KEY) -> tuple[DataFrame, int]:
    """(doc_id, part, slot, at, ids) of docs (doc_id, text), whose places are written, and the number of sequences.

    at is the place of the piece's first id in its sequence.  The row with part -1 is the padding of the last sequence.
    """
    folder, total = places
    permutation = Feistel(max(1, -(-total // sequence)), key)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec, free = encoder(pattern, source.value)
        place, done = None, 0
        for batch in slices(batches):
            if place is None:
                place = _places(folder, TaskContext.get().partitionId())
            k = batch.num_rows
            n, at = (x[done : done + k] for x in place)
            done += k
            ids = [codec.encode_ordinary(x) for x in batch.column(1).to_pylist()]
            if not np.array_equal(n, [len(x) + 1 for x in ids]):
                raise ValueError("the scan was split in another way than when it was counted")
            doc_ids = batch.column(0)
            for x in ids:
                x.append(free)
            if len(at) and (at + n).max() == total and total % sequence:
                ids.append([PAD] * (sequence - total % sequence))
                n, at = np.append(n, len(ids[-1])), np.append(at, total)
                doc_ids = pa.concat_arrays([doc_ids, pa.nulls(1, pa.int64())])
            flat = np.concatenate([np.array(x, "<u2") for x in ids])
            first = at // sequence
            parts = (at + n - 1) // sequence - first + 1
            owner = np.repeat(np.arange(len(n)), parts)
            part = np.arange(len(owner)) - np.repeat(np.cumsum(parts) - parts, parts)
            number = first[owner] + part
            begin = np.maximum(number * sequence, at[owner])
            ends = np.cumsum(np.minimum((number + 1) * sequence, (at + n)[owner]) - begin)
            part = np.where(at[owner] == total, -1, part)
            pieces = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(owner), [None, pa.py_buffer(np.append(0, 2 * ends).astype(np.int64)), pa.py_buffer(flat)])
            out = pa.RecordBatch.from_arrays([doc_ids.take(pa.array(owner)), pa.array(part, pa.int32()), pa.array(permutation.slots(number)), pa.array(begin % sequence, pa.int32()), pieces.cast(pa.binary())], ["doc_id", "part", "slot", "at", "ids"])
            for i in range(0, len(owner), 8192):
                yield out.slice(i, 8192)

    return docs.mapInArrow(run, "doc_id long, part int, slot long, at int, ids binary"), permutation.n if total else 0


INDEX = "doc_id long, part int, slot long, offset long, length int, crc long, path string"


def write_shards(pieces: DataFrame, n: int, folder: str, sequence: int = SEQUENCE, shard: int = SHARD) -> DataFrame:
    """Write what sequences() gives and return the index, one row per piece and in the order of the shards' bytes.

    A partition is a range of slots, whole shards, that arithmetic tells: no sample is drawn.  It is sorted and written
    batch by batch.  A shard is written under a name of its attempt and known by the returned rows alone.
    """
    shards = -(-n // shard)
    each = max(1, -(-shards // MOST_WRITERS))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = pafs.FileSystem.from_uri(folder)
        fs.create_dir(path, recursive=True)
        f, name, now, due = None, "", -1, 0
        for batch in batches:
            slot, at = batch.column(2).to_numpy(), batch.column(3).to_numpy()
            ids = batch.column(4)
            sizes = np.diff(np.frombuffer(ids.buffers()[1], np.int32)[ids.offset : ids.offset + len(ids) + 1])
            offset = 2 * ((slot % shard) * sequence + at)
            for rows in np.split(np.arange(len(slot)), np.flatnonzero(np.diff(slot // shard)) + 1):
                if not len(rows):
                    continue
                if slot[rows[0]] // shard != now:
                    if f:
                        f.close()
                    now, due = slot[rows[0]] // shard, 0
                    name = f"shard-{now:08d}-{uuid.uuid4().hex}.bin"
                    f = fs.open_output_stream(f"{path}/{name}")
                ends = offset[rows] + sizes[rows]
                if not np.array_equal(offset[rows], np.append(due, ends[:-1])):
                    raise ValueError(f"shard {now}: pieces are missing or overlap")
                due = ends[-1]
                part = ids.slice(rows[0], len(rows)).to_pylist()
                f.write(b"".join(part))
                own = batch.slice(rows[0], len(rows))
                yield pa.RecordBatch.from_arrays([own.column(0), own.column(1), own.column(2), pa.array(offset[rows]), pa.array(sizes[rows] // 2, pa.int32()), pa.array([zlib.crc32(x) for x in part], pa.int64()), pa.array([f"{folder}/{name}"] * len(rows), pa.string())], ["doc_id", "part", "slot", "offset", "length", "crc", "path"])
        if f:
            f.close()

    dealt = pieces.repartitionById(max(1, -(-shards // each)), F.expr(f"int(slot div {shard * each})")).sortWithinPartitions("slot", "at")
    return dealt.mapInArrow(write, INDEX)


def read_from(path: str, offset: int, length: int) -> np.ndarray:
    """Resume a sequential read of a shard at a byte: the next length ids."""
    fs, at = pafs.FileSystem.from_uri(path)
    with fs.open_input_file(at) as f:
        return np.frombuffer(f.read_at(2 * length, offset), "<u2")


def read_back(index: DataFrame, shard: int = SHARD) -> DataFrame:
    """The index with the digest of each piece's ids as they stand in the shards.

    Rows that follow each other in the index do so in the shards, so a batch is read by few ranges; nothing is shuffled.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            paths, offset, length = batch.column(6).to_pylist(), batch.column(3).to_numpy(), batch.column(4).to_numpy()
            new = [i for i in range(1, len(paths)) if paths[i] != paths[i - 1] or offset[i] != offset[i - 1] + 2 * length[i - 1]]
            data = [read_from(paths[i], int(offset[i]), int(length[i:j].sum())).tobytes() for i, j in zip([0, *new], [*new, len(paths)], strict=True) if j > i]
            whole, ends = memoryview(b"".join(data)), np.cumsum(2 * length.astype(np.int64))
            pieces = [whole[e - 2 * n : e] for e, n in zip(ends.tolist(), length.tolist(), strict=True)]
            same = [zlib.crc32(x) == c for x, c in zip(pieces, batch.column(5).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array([hashlib.sha256(x).hexdigest() for x in pieces], pa.string()), pa.array(same, pa.bool_())], ["doc_id", "part", "slot", "offset", "length", "sha256", "read_back"])

    rows = index.where("part >= 0").mapInArrow(run, "doc_id long, part int, slot long, offset long, length int, sha256 string, read_back boolean")
    return rows.select("doc_id", "part", "slot", F.expr(f"slot div {shard}").alias("shard"), "offset", "length", "sha256", "read_back")


def materialise(docs: DataFrame, pattern: str, source, folder: str, sequence: int = SEQUENCE, shard: int = SHARD, key: bytes = KEY) -> DataFrame:
    """Write the shards of docs (doc_id, text) to folder; the written index of their pieces."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    places = write_places(docs, pattern, source)
    pieces, n = sequences(docs, pattern, source, places, sequence, key)
    index = stored(write_shards(pieces, n, folder, sequence, shard), "order-index")
    remove(docs.sparkSession, places[0])
    return index


def op6_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per piece of a document in a sequence, read back from the shards: its place and the digest of its ids."""
    import public_tokenizers

    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), encoding="ascii") as f:
        source = spark.sparkContext.broadcast(f.read())
    return read_back(materialise(table(spark, sf_dir, "documents"), public_tokenizers.PATTERN, source, scratch(spark, "shards")))
