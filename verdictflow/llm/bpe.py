"""Byte-level BPE: encoding by a priority queue of merge ranks over a doubly linked symbol list; decoding by
concatenating vocabulary strings.

The vocabulary file is a parameter.  It is read once on the driver and broadcast (a vocabulary is bounded: some MB).

Edge cases: a null text counts as empty and has no tokens; texts of any length are encoded whole, a single word of n
bytes in n log n; repeated rows give repeated rows; an empty table gives an empty table; columns of the input beyond the
id and the text are not read.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import struct
import sys
from array import array
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import slices, table, text_of

#: The pre-tokenizer pattern of byte-level BPE.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
#: Bounds of the memory of encoded pieces in each Python worker, about 130 MB.
CACHE_ENTRIES = 600_000
CACHE_BYTES = 64
#: array("I") has little-endian 32-bit items here.
NATIVE = sys.byteorder == "little" and array("I").itemsize == 4


def byte_alphabet() -> dict[str, int]:
    """The printable stand-in of each byte: itself where printable, else the next free code point from 256 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Vocabulary:
    """Ids, merges and special tokens of a tokenizer file."""

    def __init__(self, source: str) -> None:
        data = json.loads(source)
        model, alphabet = data["model"], byte_alphabet()
        ids: dict[str, int] = model["vocab"]
        self.special = {t["content"]: t["id"] for t in data.get("added_tokens", [])}
        self.strings: dict[int, bytes] = {i: bytes(alphabet[c] for c in s) for s, i in ids.items()}
        self.strings |= {i: s.encode() for s, i in self.special.items()}
        self.of_byte = [0] * 256
        for s, i in ids.items():
            if len(s) == 1:
                self.of_byte[alphabet[s]] = i
        self.ranks: dict[int, int] = {}
        self.rules: list[tuple[int, int, int]] = []
        for pair in model["merges"]:
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            self.ranks.setdefault(ids[left] << 32 | ids[right], len(self.rules))
            self.rules.append((ids[left], ids[right], ids[left + right]))


def merge(symbols: list[int], ranks: dict[int, int], rules: list[tuple[int, int, int]]) -> list[int]:
    """Apply the merges in order of rank, leftmost first.

    ranks: left << 32 | right to rank; rules: (left, right, merged) by rank.  The queue holds rank << 32 | place.  A merge
    writes into its left place and unlinks the right one; entries whose symbols no longer stand at their place, next to
    each other, are stale and are skipped when popped.
    """
    n = len(symbols)
    find, push, pop = ranks.get, heapq.heappush, heapq.heappop
    queue = []
    left = symbols[0]
    for i in range(1, n):
        right = symbols[i]
        rank = find(left << 32 | right)
        if rank is not None:
            queue.append(rank << 32 | i - 1)
        left = right
    if not queue:
        return symbols
    after = [*range(1, n), -1]
    before = [*range(-1, n - 1)]
    heapq.heapify(queue)
    while queue:
        entry = pop(queue)
        i = entry & 0xFFFFFFFF
        left, right, merged = rules[entry >> 32]
        j = after[i]
        if symbols[i] != left or j < 0 or symbols[j] != right:
            continue
        symbols[i] = merged
        symbols[j] = -1
        after[i] = k = after[j]
        if k >= 0:
            before[k] = i
            rank = find(merged << 32 | symbols[k])
            if rank is not None:
                push(queue, rank << 32 | i)
        h = before[i]
        if h >= 0:
            rank = find(symbols[h] << 32 | merged)
            if rank is not None:
                push(queue, rank << 32 | h)
    return [s for s in symbols if s >= 0]


class Codec(dict):
    """Encoder and decoder; as a mapping, a bounded memory of short pieces' ids as bytes."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        super().__init__()
        import regex

        self.v = vocabulary
        self.pieces = regex.compile(PIECES).findall
        self.cut = regex.compile("|".join(regex.escape(s) for s in sorted(self.v.special, key=len, reverse=True))) if self.v.special else None

    def __missing__(self, piece: str) -> bytes:
        raw = piece.encode("utf-8", "surrogatepass")
        v = self.v
        ids = merge([v.of_byte[b] for b in raw], v.ranks, v.rules)
        out = array("I", ids).tobytes() if NATIVE else struct.pack(f"<{len(ids)}I", *ids)
        if len(raw) <= CACHE_BYTES:
            if len(self) >= CACHE_ENTRIES:
                self.clear()
            self[piece] = out
        return out

    def _plain(self, text: str) -> bytes:
        return b"".join(map(self.__getitem__, self.pieces(text)))

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers.  Special tokens' strings become their ids."""
        if self.cut is None or not self.cut.search(text):
            return self._plain(text)
        out, at = [], 0
        for m in self.cut.finditer(text):
            out += [self._plain(text[at : m.start()]), self.v.special[m[0]].to_bytes(4, "little")]
            at = m.end()
        return b"".join([*out, self._plain(text[at:])])

    def decode(self, ids: bytes) -> str:
        strings = self.v.strings
        return b"".join([strings[i] for (i,) in struct.iter_unpack("<I", ids)]).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def codec_of(source: str) -> Codec:
    """A worker keeps its codec, and the pieces that it has met, from task to task."""
    return Codec(Vocabulary(source))


def _read_all(spark: SparkSession, path: str) -> str:
    """A small file by a local path or by any path that Spark can read."""
    if "://" not in path:
        with open(path, encoding="utf-8") as f:
            return f.read()
    return spark.read.text(path, wholetext=True).first()[0]


def encode_table(docs: DataFrame, vocabulary_path: str, text: str = "text", keep_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, round_trip, and the ids themselves if asked for."""
    spark = docs.sparkSession
    source = spark.sparkContext.broadcast(_read_all(spark, vocabulary_path))

    def run(batches):
        codec = codec_of(source.value)
        for batch in slices(batches):
            out = []
            for t in batch.column(1).to_pylist():
                ids = codec.encode(t)
                decoded = codec.decode(ids)
                out.append((len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest(), decoded == t, ids))
            n, a, b, same, ids = zip(*out, strict=True) if out else ((),) * 5
            columns = [batch.column(0), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string()), pa.array(same, pa.bool_())]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "round_trip"]
            if keep_ids:
                columns.append(pa.array(ids, pa.binary()))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names)

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, round_trip boolean" + ", ids binary" * keep_ids
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of(text).alias("text")).mapInArrow(run, schema)


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_table(table(spark, sf_dir, "documents"), default_vocabulary())


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row for each document that reaches it, repeats included."""
    return encode_table(docs, default_vocabulary())
