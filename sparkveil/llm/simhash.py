"""SimHash near-dedup: 64-bit fingerprints linked by Hamming distance through pigeonring filtering.

Fingerprint: a text's A-Z are lower-cased, its words are the maximal runs other than ASCII white
space, every run of ``width`` words is a shingle (repeats included; a shorter text is one shingle;
no word gives fingerprint 0) and a bit is set if it is set in over half of the shingles' XXH64.

Pigeonring (Qin and Xiao, VLDB 2018): lay the m = 8 bytes of a fingerprint on a ring. If two
fingerprints differ in at most t = 3 bits, some byte i starts a chain whose first l bytes differ in
at most floor(l * 3 / 8) bits for every l: the bytes i and i+1 are equal, the bytes up to i+4 differ
in one bit at most, the bytes up to i+6 in two at most. So of the bytes i+2, i+3 and i+4 two are
equal as well, and the 8 x 3 choices give 24 keys of four equal bytes: any pair within 3 bits shares
one of them, and a random pair shares one with a probability of about 24 / 2^32.

Rows that share a key are compared with growing chains (5 bytes, 7 bytes, then the whole distance).
Inside a key the comparison walks outwards from one fingerprint after another and looks only at
those not reached yet, so it writes a spanning forest and never all pairs of a group. Keys with more
than ``cap`` distinct fingerprints are cut into parts that are compared part by part, which loses no
link and bounds a task's memory. Links become components in ``components.py``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkveil.llm.components import connected_components, one_row_each, row_key
from sparkveil.session import materialize, ship, sliced

RADIUS, BYTES = 3, 8
#: Distinct fingerprints of one key that are compared at once.
CAP = 4096
_CHUNK = 1 << 20
_SPACE = b" \t\n\x0b\x0c\r"


def _words(data: bytes) -> Iterator[list[bytes]]:
    """The words of a text, about a megabyte at a time. bytes.split() cuts at the six ASCII spaces."""
    at, n = 0, len(data)
    while at < n:
        end = min(n, at + _CHUNK)
        while end < n and data[end] not in _SPACE:
            end += 1
        yield data[at:end].split()
        at = end


def shingle_hashes(text: str | None, width: int = 3, seed: int = 42) -> Iterator[bytes]:
    """The XXH64 of a text's shingles, 8 bytes each, in order and with repeats, a chunk of the text at
    a time. A shorter text is one shingle; a text without words has none."""
    rest, long_enough, digest = [], False, xxhash.xxh64_digest
    for words in _words((text or "").encode("utf-8", "surrogatepass").lower()):
        words = rest + words
        if len(words) >= width:
            joined = b" ".join(words)
            ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
            starts = np.concatenate(([0], ends[: len(words) - width])).tolist()
            yield b"".join([digest(joined[s:e], seed) for s, e in zip(starts, (ends[width - 1 :] - 1).tolist())])
            rest, long_enough = words[len(words) - width + 1 :], True
        else:
            rest = words
    if rest and not long_enough:
        yield digest(b" ".join(rest), seed)


def majority(counts: np.ndarray, total: int) -> int:
    """The fingerprint whose bits are set in over half of ``total`` hashes."""
    return int.from_bytes(np.packbits(2 * counts > total).tobytes(), "big")


def fingerprint(text: str | None, width: int = 3, seed: int = 42) -> int:
    """The unsigned 64-bit fingerprint of one text; 0 if it has no word."""
    counts, total = np.zeros(64, np.int64), 0
    for hashes in shingle_hashes(text, width, seed):
        counts += bit_counts(hashes)
        total += len(hashes) // 8
    return majority(counts, total)


def bit_counts(hashes: bytes) -> np.ndarray:
    """How many of the 8-byte hashes have each bit set."""
    out = np.zeros(64, np.int64)
    rows = np.frombuffer(hashes, np.uint8).reshape(-1, 8)
    for at in range(0, len(rows), 65_536):
        bits = np.unpackbits(rows[at : at + 65_536], axis=1)
        full = len(bits) // 255 * 255
        if full:  # sums of 255 bits fit in a byte
            out += bits[:full].reshape(-1, 255, 64).sum(1, dtype=np.uint8).sum(0, dtype=np.int64)
        out += bits[full:].sum(0, dtype=np.int64)
    return out


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, seed: int = 42) -> DataFrame:
    """``id, fp`` for every row, the 64 bits as a signed long."""
    ship(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            fps = np.fromiter((fingerprint(x.as_py(), width, seed) for x in batch.column(1)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], ["id", "fp"])

    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "id long, fp long")


def _fingerprint_rows(df: DataFrame, id_col: str, text_col: str, width: int, seed: int) -> DataFrame:
    """``id, key, fp`` for every row, the key being ``row_key``."""
    ship(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            fps = np.fromiter((fingerprint(x.as_py(), width, seed) for x in batch.column(2)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(fps.view(np.int64))], ["id", "key", "fp"])

    rows = df.select(F.col(id_col).cast("long").alias("id"), row_key(F.col(text_col)).alias("key"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "id long, key string, fp long")


def _keys(fp: str = "fp"):
    """The 24 keys of a fingerprint: which bytes, in the upper bits, and the four bytes."""
    byte = [F.shiftrightunsigned(F.col(fp), 56 - 8 * i).bitwiseAND(255) for i in range(BYTES)]
    out = []
    for i in range(BYTES):
        for left_out in (2, 3, 4):
            key = F.lit(i * 3 + left_out - 2).cast("long")
            for j in [k for k in range(5) if k != left_out]:
                key = F.shiftleft(key, 8).bitwiseOR(byte[(i + j) % BYTES])
            out.append(key)
    return F.array(*out)


def _chain_masks(kind: int) -> list[tuple[np.uint64, int]]:
    start, masks = kind // 3, []
    for length in (5, 7, 8):
        mask = 0
        for j in range(length):
            mask |= 0xFF << (56 - 8 * ((start + j) % BYTES))
        masks.append((np.uint64(mask), length * RADIUS // BYTES))
    return masks


def spanning_links(fps: np.ndarray, kind: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links among distinct fingerprints that share a key of this kind."""
    masks, left, right, rest = _chain_masks(kind), [], [], np.sort(fps)
    while len(rest) > 1:
        front, rest = [rest[0]], rest[1:]
        root = front[0]
        while front and len(rest):
            diff = rest ^ front.pop()
            near = np.flatnonzero(np.bitwise_count(diff & masks[0][0]) <= masks[0][1])
            for mask, budget in masks[1:]:
                near = near[np.bitwise_count(diff[near] & mask) <= budget]
            if len(near):
                found = rest[near]
                left.append(np.full(len(found), root))
                right.append(found)
                front.extend(found)
                keep = np.ones(len(rest), bool)
                keep[near] = False
                rest = rest[keep]
    if not left:
        return np.empty(0, np.uint64), np.empty(0, np.uint64)
    return np.concatenate(left), np.concatenate(right)


def _link_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (key, lo, hi) in; links out. A group has at most two parts of a key."""
    held: list[np.ndarray] = []
    buffer: list[tuple[np.ndarray, np.ndarray]] = []

    def flush(rows: np.ndarray) -> None:
        cuts = np.flatnonzero(np.any(rows[1:, :3] != rows[:-1, :3], axis=1)) + 1
        bounds = np.concatenate(([0], cuts, [len(rows)]))
        for s, e in zip(bounds[:-1], bounds[1:]):
            if e - s > 1:
                buffer.append(spanning_links(np.unique(rows[s:e, 3]).view(np.uint64), int(rows[s, 0] >> 32)))

    def out() -> Iterator[pa.RecordBatch]:
        links = [x for x in buffer if len(x[0])]
        buffer.clear()
        if links:
            a, b = (np.concatenate(x).view(np.int64) for x in zip(*links))
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    for batch in batches:
        if not batch.num_rows:
            continue
        rows = np.stack([np.asarray(batch.column(i)) for i in range(4)], axis=1)
        if held and np.array_equal(held[-1][-1, :3], rows[-1, :3]) and np.array_equal(held[0][0, :3], rows[-1, :3]):
            held.append(rows)
            continue
        rows = np.concatenate([*held, rows])
        same = np.all(rows[:, :3] == rows[-1, :3], axis=1)
        first = len(rows) - int(np.argmin(same[::-1])) if not same.all() else 0
        if first:
            flush(rows[:first])
        held = [rows[first:]]
        yield from out()
    if held:
        flush(np.concatenate(held))
        yield from out()


def near_links(classes: DataFrame, cap: int = CAP) -> DataFrame:
    """``a, b``: links within 3 bits that connect what is connected, from distinct ``fp`` values."""
    ship(classes.sparkSession)
    keys = classes.select("fp", F.explode(_keys()).alias("key"))
    shared = keys.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    parts = F.ceil(F.col("n") / F.lit(cap)).cast("int")
    rows = (
        keys.join(shared, "key")
        .withColumn("parts", parts)
        .withColumn("own", F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        .select("key", F.least("own", "other").cast("long").alias("lo"), F.greatest("own", "other").cast("long").alias("hi"), "fp")
    )
    return rows.repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi").mapInArrow(_link_groups, "a long, b long").distinct()


def _rooted(fps: DataFrame, cap: int) -> DataFrame:
    """``fp, least, root`` of the distinct fingerprints: their smallest id and their component."""
    classes = materialize(fps.groupBy("fp").agg(F.min("id").alias("least")), "fingerprint-classes")
    roots = connected_components(near_links(classes, cap))
    return classes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))


def near_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, seed: int = 42, cap: int = CAP) -> DataFrame:
    """One row per input row: ``doc_id, fingerprint`` (16 hex digits) and ``component_id``, the
    smallest id that links of at most 3 differing bits reach, itself included.

    Defined cases: a null text counts as empty; all texts without words have fingerprint 0 and are
    linked like any other; a text of any length is read whole, a chunk at a time; a null id never becomes a component's id unless all its ids are null;
    repeated rows are returned as often as they came; an empty table gives an empty result; other
    columns are ignored.
    """
    fps = materialize(fingerprints(df, id_col, text_col, width, seed), "fingerprints")
    classes = _rooted(fps, cap)
    least = classes.groupBy("root").agg(F.min("least").alias("component_id"))
    labels = classes.select("fp", "root").join(least, "root").select("fp", "component_id")
    return fps.join(labels, "fp").select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def one_of_each(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, seed: int = 42, cap: int = CAP) -> DataFrame:
    """The rows of ``df`` without those whose component has a row that ranks before them, see
    ``components.one_row_each``; columns may have any names. Other cases are those of ``near_dedup``."""
    rows = materialize(_fingerprint_rows(df, id_col, text_col, width, seed), "fingerprints")
    members = rows.join(_rooted(rows, cap).select("fp", "root"), "fp").select("id", "key", "root")
    return one_row_each(df, members, id_col, text_col)
