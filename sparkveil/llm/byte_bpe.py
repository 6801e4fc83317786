"""Byte-level BPE encoding and decoding with a two-tier lookup.

Tier 1: a minimal perfect hash over the vocabulary's byte strings (hash and displace: a first hash
picks a bucket, the bucket's displacement sends its strings to free slots, as many slots as strings)
resolves pre-tokens that are in the vocabulary whole. Tier 2: other pre-tokens start as a linked list
of bytes, and a heap of (rank, position) yields the merges in order.

A worker remembers the ids of the chunks it has met (``pretokens.py``), so both tiers see each
distinct chunk about once.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkveil.llm.pretokens import Memo, chunks
from sparkveil.session import named, ship, sliced


def read_ranks(path: str) -> list[bytes]:
    """The byte strings of a rank file, in order of rank."""
    with open(path, "rb") as f:
        ranks = {int(b): base64.b64decode(a) for a, b in (line.split() for line in f if line.strip())}
    if sorted(ranks) != list(range(len(ranks))):
        raise ValueError("ranks must run from 0 without a gap")
    return [ranks[i] for i in range(len(ranks))]


class PerfectHash:
    """A minimal perfect hash from byte strings to their positions; other strings give -1."""

    def __init__(self, keys: list[bytes], load: int = 2):
        self.n, self.buckets = len(keys), max(1, -(-len(keys) // load))
        self.seed = next(seed for seed in range(100) if self._place(keys, seed))

    def _place(self, keys: list[bytes], seed: int) -> bool:
        """Find each bucket's displacement, the fullest first. A bucket of one string names its slot
        itself, as -1 - slot, so the last slots need no search."""
        self.seed, self.keys, slots, shift = seed, [b""] * self.n, [-1] * self.n, [0] * self.buckets
        pairs = [self._pair(k) for k in keys]
        by_bucket: dict[int, list[int]] = {}
        for i, (low, _) in enumerate(pairs):
            by_bucket.setdefault(low % self.buckets, []).append(i)
        free, tries = np.ones(self.n, bool), np.arange(64, dtype=np.uint64)
        single = [m[0] for m in by_bucket.values() if len(m) == 1]
        for bucket, members in sorted(by_bucket.items(), key=lambda x: -len(x[1])):
            if len(members) == 1:
                break
            for at in range(0, 1 << 16, len(tries)):
                spots = np.stack([self._spots(pairs[i], tries + np.uint64(at)) for i in members])
                ordered = np.sort(spots, axis=0)
                found = np.flatnonzero(free[spots].all(0) & (ordered[1:] != ordered[:-1]).all(0))
                if len(found):
                    break
            else:
                return False
            shift[bucket] = at + int(found[0])
            for i, spot in zip(members, spots[:, found[0]].tolist()):
                free[spot], self.keys[spot], slots[spot] = False, keys[i], i
        for i, spot in zip(single, np.flatnonzero(free).tolist()):
            shift[pairs[i][0] % self.buckets] = -1 - spot
            self.keys[spot], slots[spot] = keys[i], i
        self.shift, self.slots = shift, slots
        return True

    def _pair(self, key: bytes) -> tuple[int, int]:
        h = xxhash.xxh3_128_intdigest(key, self.seed)
        return h & 0xFFFFFFFF, h >> 64

    def _spots(self, pair: tuple[int, int], shifts: np.ndarray) -> np.ndarray:
        a, b = np.uint64(pair[1] >> 32), np.uint64((pair[1] & 0xFFFFFFFF) | 1)
        return ((a + shifts * b) % np.uint64(self.n)).astype(np.int64)

    def get(self, key: bytes) -> int:
        if not self.n:
            return -1
        h = xxhash.xxh3_128_intdigest(key, self.seed)
        shift = self.shift[(h & 0xFFFFFFFF) % self.buckets]
        spot = -1 - shift if shift < 0 else ((h >> 96) + shift * (h >> 64 & 0xFFFFFFFF | 1)) % self.n
        return self.slots[spot] if self.keys[spot] == key else -1


class _PairRanks(dict):
    """(left id << 20 | right id) to the rank of their merge, -1 if there is none."""

    def __init__(self, tokens: list[bytes], vocabulary: PerfectHash, most: int = 1_000_000):
        super().__init__()
        self.tokens, self.vocabulary, self.most = tokens, vocabulary, most

    def __missing__(self, pair: int) -> int:
        if len(self) >= self.most:
            self.clear()
        rank = self[pair] = self.vocabulary.get(self.tokens[pair >> 20] + self.tokens[pair & 0xFFFFF])
        return rank


#: Marks that end words and begin no contraction.
_MARKS = frozenset(",.;:!?)")
#: Chunks of texts whose ids a worker remembers.
CHUNKS = 400_000


class BytePairEncoder:
    """Encodes and decodes with a rank file, each match of ``pattern`` separately. Of chunks behind a
    space it remembers up to twice ``chunks``, some 200 bytes each."""

    def __init__(self, tokens: list[bytes], vocabulary: PerfectHash, pattern: str, chunks: int = CHUNKS):
        self.tokens, self.hash = tokens, vocabulary
        if len(tokens) >= 1 << 20:
            raise ValueError("over 2^20 ranks")
        self.pattern = regex.compile(pattern)
        self._letters_alone = pattern.startswith("'s|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+|")
        byte = {t[0]: i for i, t in enumerate(self.tokens) if len(t) == 1}
        self.of_byte = [byte[i] for i in range(256)]
        self.pairs = _PairRanks(tokens, vocabulary)
        # A worker keeps these for as long as it lives.
        self._piece = Memo(self._piece_ids, most=60_000)
        self._chunk = Memo(self._ids, most=30_000)
        self._spaced = Memo(self._spaced_ids, most=chunks)

    def merge(self, data: bytes) -> list[int]:
        """The ids of one pre-token by the heap of possible merges over its linked bytes.

        A heap entry is rank << 32 | position; it is stale if the pair at that position has another
        rank by now.
        """
        n, pairs, of_byte, pop, push = len(data), self.pairs, self.of_byte, heapq.heappop, heapq.heappush
        ids, nxt, prev = [of_byte[x] for x in data], list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [r << 32 | i for i, (a, b) in enumerate(zip(ids, ids[1:])) if (r := pairs[a << 20 | b]) >= 0]
        heapq.heapify(heap)
        while heap:
            top = pop(heap)
            i, rank = top & 0xFFFFFFFF, top >> 32
            left, j = ids[i], nxt[i]
            if left < 0 or j >= n or pairs[left << 20 | ids[j]] != rank:
                continue
            ids[i], ids[j] = rank, -1
            k, h = nxt[j], prev[i]
            nxt[i] = k
            if k < n:
                prev[k] = i
                if (r := pairs[rank << 20 | ids[k]]) >= 0:
                    push(heap, r << 32 | i)
            if h >= 0 and (r := pairs[ids[h] << 20 | rank]) >= 0:
                push(heap, r << 32 | h)
        return [x for x in ids if x >= 0]

    def _piece_ids(self, piece: str) -> bytes:
        data = piece.encode("utf-8")
        rank = self.hash.get(data)
        ids = [rank] if rank >= 0 else self.merge(data)
        return struct.pack(f"<{len(ids)}I", *ids)

    def _spaced_ids(self, chunk: str) -> bytes:
        """A chunk behind a space: letters alone are one pre-token, and a mark behind them is another."""
        if self._letters_alone:
            if chunk.isalpha():
                return self._piece_ids(" " + chunk)
            if chunk[-1:] in _MARKS and chunk[:-1].isalpha():
                return self._spaced[chunk[:-1]] + self._piece[chunk[-1]]
        return self._ids(" " + chunk)

    def _ids(self, chunk: str) -> bytes:
        return b"".join(map(self._piece.__getitem__, self.pattern.findall(chunk)))

    def encode_bytes(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        first, rest = chunks(text)
        if first is None:
            return b"".join(map(self._chunk.__getitem__, rest))
        return (self._chunk[first] if first else b"") + b"".join(map(self._spaced.__getitem__, rest))

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.encode_bytes(text), "<u4").tolist()

    def decode_bytes(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))

    def decode(self, ids: list[int]) -> bytes:
        return self.decode_bytes(np.array(ids, "<u4").tobytes())


    @classmethod
    def from_file(cls, path: str, pattern: str) -> BytePairEncoder:
        tokens = read_ranks(path)
        return cls(tokens, PerfectHash(tokens), pattern)


_ENCODERS: dict[tuple[str, str, int], BytePairEncoder] = {}


def _on_workers(spark: SparkSession, path: str, pattern: str, chunks: int = CHUNKS):
    """A function that gives a Python worker its encoder. The perfect hash is built here and
    broadcast: it is as large as the vocabulary, under 2^20 strings."""
    ship(spark)
    tokens = read_ranks(path)
    built = spark.sparkContext.broadcast((tokens, PerfectHash(tokens)))

    def get() -> BytePairEncoder:
        if (path, pattern, chunks) not in _ENCODERS:
            _ENCODERS[path, pattern, chunks] = BytePairEncoder(*built.value, pattern, chunks)
        return _ENCODERS[path, pattern, chunks]

    return get


def encode_column(df: DataFrame, ranks_path: str, pattern: str, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """``df`` with the ids of each text as an array of integers in ``ids_col``.

    Defined cases: a null text counts as empty, with no ids; a text of any length gives one array;
    repeated rows are returned as often as they came; an empty table gives an empty result; the other
    columns, of any names, pass through unchanged, and one named ``ids_col`` is replaced.
    """
    encoder = _on_workers(df.sparkSession, ranks_path, pattern)

    @F.pandas_udf("array<int>")
    def ids(texts):
        enc = encoder()
        return texts.map(lambda t: enc.encode(t or ""))

    return df.withColumn(ids_col, ids(F.coalesce(named(text_col), F.lit(""))))


def encoded_digests(df: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", chunks: int = CHUNKS) -> DataFrame:
    """One row per input row: ``doc_id, n_tokens, ids_sha256, decoded_sha256``, the latter of the
    bytes that the ids decode to.

    Defined cases: a null text counts as empty, with no ids; repeated rows are returned as often as
    they came; an empty table gives an empty result; other columns are ignored. A pre-token of any
    length is one linked list, so memory follows the longest pre-token and text. ``chunks`` bounds what
    a worker remembers, and changes no result.
    """
    encoder = _on_workers(df.sparkSession, ranks_path, pattern, chunks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder()
        for batch in sliced(batches):
            n, ids, decoded = [], [], []
            for x in batch.column(1):
                data = enc.encode_bytes(x.as_py() or "")
                n.append(len(data) // 4)
                ids.append(hashlib.sha256(data).hexdigest())
                decoded.append(hashlib.sha256(enc.decode_bytes(data)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())], ["id", "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = df.select(F.col(id_col)).schema[0].dataType.simpleString()
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string").withColumnRenamed("id", id_col)
