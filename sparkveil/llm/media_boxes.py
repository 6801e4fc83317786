"""ISO base media files: writing samples into nested boxes, and reading media columns back.

``read_media`` walks the nested boxes (32-bit, 64-bit and to-the-end sizes), decodes the sample
tables (stts, stsc, stsz or stz2, stco or co64, stss), follows fragments (trex, tfhd, trun), and gives
codec, duration and the byte ranges of the samples and of the keyframes without decoding any payload.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkveil.session import ship, sliced

#: Boxes that only hold boxes.
CONTAINERS = {b"moov", b"trak", b"mdia", b"minf", b"stbl", b"edts", b"dinf", b"udta", b"mvex"}
CODEC, RATE, SAMPLE, KEY_EVERY = b"raw ", 8000, 576, 8
MAX_DEPTH = 16


class BadMedia(ValueError):
    """The boxes are cut short or contradict each other."""


@dataclass
class Track:
    """The tables of one track; ranges are (offset, size) in the file."""

    track_id: int = 0
    handler: str = ""
    codec: str = ""
    timescale: int = 0
    duration: int = 0
    samples: list[tuple[int, int]] = field(default_factory=list)
    keyframes: list[tuple[int, int]] = field(default_factory=list)


def boxes(data: memoryview, start: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    """(type, first byte of the content, end) of each box in a range."""
    while start < end:
        if end - start < 8:
            raise BadMedia("box header cut short")
        size, kind = struct.unpack_from(">I4s", data, start)
        head = 8
        if size == 1:
            if end - start < 16:
                raise BadMedia("box header cut short")
            size, head = struct.unpack_from(">Q", data, start + 8)[0], 16
        elif size == 0:
            size = end - start
        if kind == b"uuid":
            head += 16
        if size < head or size > end - start:
            raise BadMedia(f"box {kind!r} of {size} bytes")
        yield kind, start + head, start + size
        start += size


def _table(data: memoryview, at: int, end: int, row: str, skip: int = 0) -> list[tuple[int, ...]]:
    """The rows of a full box with a count."""
    if end - at < 8 + skip:
        raise BadMedia("table cut short")
    n = struct.unpack_from(">I", data, at + 4 + skip)[0]
    step = struct.calcsize(row)
    if n * step > end - at - 8 - skip:
        raise BadMedia("table cut short")
    return list(struct.iter_unpack(row, data[at + 8 + skip : at + 8 + skip + n * step]))


def _sizes(data: memoryview, kind: bytes, at: int, end: int) -> list[int]:
    if end - at < 12:
        raise BadMedia("table cut short")
    if kind == b"stsz":
        same, n = struct.unpack_from(">II", data, at + 4)
        if same:
            if n * same > len(data):
                raise BadMedia("samples outside the file")
            return [same] * n
        return [x for (x,) in _table(data, at, end, ">I", 4)]
    bits, n = data[at + 7], struct.unpack_from(">I", data, at + 8)[0]
    body = bytes(data[at + 12 : end])
    if bits not in (4, 8, 16) or n * bits > len(body) * 8:
        raise BadMedia("stz2 cut short")
    if bits == 4:
        return [x for b in body for x in (b >> 4, b & 15)][:n]
    return [x for (x,) in struct.iter_unpack(">H" if bits == 16 else ">B", body[: n * bits // 8])]


#: What a fragment falls back to: sample duration, size and flags.
_DEFAULTS = (0, 0, 0)
_NOT_SYNC = 0x10000


@dataclass
class _File:
    """What the walk has seen: tracks with their tables, defaults of fragments by track, and fragments
    as (track id, first byte, (duration, size, flags) of each sample)."""

    tracks: list[tuple[Track, dict]] = field(default_factory=list)
    defaults: dict[int, tuple[int, int, int]] = field(default_factory=dict)
    runs: list[tuple[int, int, list[tuple[int, int, int]]]] = field(default_factory=list)


def _ints(data: memoryview, at: int, end: int, form: str) -> tuple:
    if struct.calcsize(form) > end - at:
        raise BadMedia("box cut short")
    return struct.unpack_from(form, data, at)


def _walk(data: memoryview, start: int, end: int, found: _File, depth: int = 0) -> None:
    if depth > MAX_DEPTH:
        raise BadMedia("boxes nested too deep")
    for kind, at, stop in boxes(data, start, end):
        if kind == b"moof":
            _fragment(data, at, stop, start, found)
        elif kind == b"trex":
            _, track_id, _, duration, size, flags = _ints(data, at, stop, ">6I")
            found.defaults[track_id] = (duration, size, flags)
        elif kind in CONTAINERS:
            if kind == b"trak":
                found.tracks.append((Track(), {}))
            _walk(data, at, stop, found, depth + 1)
        elif found.tracks:
            _track_box(data, kind, at, stop, *found.tracks[-1])
        start = stop


def _track_box(data: memoryview, kind: bytes, at: int, stop: int, track: Track, tables: dict) -> None:
    if kind == b"tkhd":
        (track.track_id,) = _ints(data, at + (20 if stop > at and data[at] == 1 else 12), stop, ">I")
    elif kind == b"mdhd" and stop - at >= 24:
        wide = data[at] == 1
        track.timescale, track.duration = _ints(data, at + (20 if wide else 12), stop, ">IQ" if wide else ">II")
    elif kind == b"hdlr" and stop - at >= 12:
        track.handler = bytes(data[at + 8 : at + 12]).decode("latin-1")
    elif kind == b"stsd":
        entries = list(boxes(data, at + 8, stop))
        track.codec = entries[0][0].decode("latin-1") if entries else ""
    elif kind == b"stts":
        tables["stts"] = _table(data, at, stop, ">II")
    elif kind == b"stsc":
        tables["stsc"] = _table(data, at, stop, ">III")
    elif kind in (b"stsz", b"stz2"):
        tables["size"] = _sizes(data, kind, at, stop)
    elif kind in (b"stco", b"co64"):
        tables["chunk"] = [x for (x,) in _table(data, at, stop, ">I" if kind == b"stco" else ">Q")]
    elif kind == b"stss":
        tables["sync"] = [x for (x,) in _table(data, at, stop, ">I")]


def _fragment(data: memoryview, at: int, stop: int, moof: int, found: _File) -> None:
    """A movie fragment that begins at ``moof``: where a track fragment's data begin is stated, or they
    follow those of the one before, the first ones the fragment's own start."""
    after = moof
    for kind, s, e in boxes(data, at, stop):
        if kind != b"traf":
            continue
        track_id, base, given = 0, after, list(_DEFAULTS)
        for inner, a, b in boxes(data, s, e):
            if inner == b"tfhd":
                flags, track_id = _ints(data, a, b, ">II")
                a, given = a + 8, list(found.defaults.get(track_id, _DEFAULTS))
                if flags & 0x1:
                    (base,) = _ints(data, a, b, ">Q")
                    a += 8
                elif flags & 0x20000:
                    base = moof
                a += 4 * bool(flags & 0x2)
                for i, bit in enumerate((0x8, 0x10, 0x20)):
                    if flags & bit:
                        (given[i],) = _ints(data, a, b, ">I")
                        a += 4
                after = base
            elif inner == b"trun":
                after = _run(data, a, b, track_id, base, after, given, found)


def _run(data: memoryview, at: int, end: int, track_id: int, base: int, after: int, given: list[int], found: _File) -> int:
    """One run of samples; returns the byte behind them."""
    flags, n = _ints(data, at, end, ">II")
    flags &= 0xFFFFFF
    at += 8
    first = after
    if flags & 0x1:
        first = base + _ints(data, at, end, ">i")[0]
        at += 4
    opening = None
    if flags & 0x4:
        (opening,) = _ints(data, at, end, ">I")
        at += 4
    fields = [bit for bit in (0x100, 0x200, 0x400, 0x800) if flags & bit]
    if n * 4 * len(fields) > end - at or n > len(data):
        raise BadMedia("run cut short")
    rows, samples = struct.iter_unpack(f">{len(fields)}I", data[at : at + 4 * n * len(fields)]) if fields else iter([()] * n), []
    for i, row in enumerate(rows):
        own = dict(zip(fields, row))
        sample_flags = own.get(0x400, opening if i == 0 and opening is not None else given[2])
        samples.append((own.get(0x100, given[0]), own.get(0x200, given[1]), sample_flags))
    stop = first + sum(size for _, size, _ in samples)
    if first < 0 or stop > len(data):
        raise BadMedia("samples outside the file")
    found.runs.append((track_id, first, samples))
    return stop


def _samples(track: Track, tables: dict, size: int) -> None:
    sizes, chunks, runs = tables.get("size", []), tables.get("chunk", []), tables.get("stsc", [])
    at = 0
    for i, (first, per_chunk, _) in enumerate(runs):
        last = runs[i + 1][0] - 1 if i + 1 < len(runs) else len(chunks)
        if first < 1 or last > len(chunks):
            raise BadMedia("stsc outside the chunks")
        for offset in chunks[first - 1 : last]:
            for n in sizes[at : at + per_chunk]:
                if offset + n > size:
                    raise BadMedia("samples outside the file")
                track.samples.append((offset, n))
                offset += n
            at += per_chunk
    if len(track.samples) != len(sizes):
        raise BadMedia("samples without a chunk")
    if "stts" in tables and sum(n for n, _ in tables["stts"]) != len(sizes):
        raise BadMedia("times without a sample")
    if not track.duration:
        track.duration = sum(n * d for n, d in tables.get("stts", []))
    if "sync" not in tables:  # all samples are keyframes
        track.keyframes = list(track.samples)
    else:
        if any(not 1 <= x <= len(sizes) for x in tables["sync"]):
            raise BadMedia("keyframe outside the samples")
        track.keyframes = [track.samples[x - 1] for x in tables["sync"]]


def _add_run(track: Track, first: int, samples: list[tuple[int, int, int]]) -> None:
    for duration, size, flags in samples:
        track.samples.append((first, size))
        if not flags & _NOT_SYNC:
            track.keyframes.append((first, size))
        track.duration += duration
        first += size


def read_media(data: bytes) -> list[Track]:
    """The tracks of a file, fragments included. Raises BadMedia if the boxes don't hold together."""
    view, found = memoryview(data), _File()
    _walk(view, 0, len(view), found)
    for track, tables in found.tracks:
        _samples(track, tables, len(view))
    of = {t.track_id: t for t, _ in found.tracks}
    fragmented = {track_id for track_id, _, _ in found.runs}
    for track, tables in found.tracks:  # a header's duration may or may not count the fragments
        if track.track_id in fragmented:
            track.duration = sum(n * d for n, d in tables.get("stts", []))
    for track_id, first, samples in found.runs:
        if track_id not in of:
            raise BadMedia(f"fragment of an unknown track {track_id}")
        _add_run(of[track_id], first, samples)
    return [t for t, _ in found.tracks]


def _box(kind: bytes, *parts: bytes) -> bytes:
    size = 8 + sum(map(len, parts))
    if size > 0xFFFFFFFF:
        return struct.pack(">I4sQ", 1, kind, size + 8) + b"".join(parts)
    return struct.pack(">I4s", size, kind) + b"".join(parts)


def _full(kind: bytes, *parts: bytes, flags: int = 0) -> bytes:
    return _box(kind, struct.pack(">I", flags), *parts)


def write_media(payload: bytes, sample: int = SAMPLE, key_every: int = KEY_EVERY, rate: int = RATE) -> bytes:
    """A file with one track of 8-bit samples: blocks of ``sample`` bytes, every ``key_every``-th
    of them marked as a keyframe. ``payload`` is a positive multiple of ``sample`` bytes."""
    n, rest = divmod(len(payload), sample)
    if rest or not n:
        raise ValueError("the payload must be a positive multiple of the sample size")
    matrix = struct.pack(">9I", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)
    keys = range(1, n + 1, key_every)
    wide = len(payload) > 0xF0000000
    ftyp = _box(b"ftyp", b"isom", struct.pack(">I", 0x200), b"isom", b"mp42")
    entry = _box(CODEC, bytes(6), struct.pack(">H", 1), bytes(8), struct.pack(">HHHHI", 1, 8, 0, 0, rate << 16))

    def moov(offset: int) -> bytes:
        stbl = _box(
            b"stbl",
            _full(b"stsd", struct.pack(">I", 1), entry),
            _full(b"stts", struct.pack(">III", 1, n, sample)),
            _full(b"stss", struct.pack(f">I{len(keys)}I", len(keys), *keys)),
            _full(b"stsc", struct.pack(">IIII", 1, 1, n, 1)),
            _full(b"stsz", struct.pack(">II", sample, n)),
            _full(b"co64" if wide else b"stco", struct.pack(">IQ" if wide else ">II", 1, offset)),
        )
        dinf = _box(b"dinf", _full(b"dref", struct.pack(">I", 1), _full(b"url ", flags=1)))
        minf = _box(b"minf", _full(b"smhd", bytes(4)), dinf, stbl)
        mdhd = _box(b"mdhd", struct.pack(">IQQIQHH", 1 << 24, 0, 0, rate, len(payload), 0x55C4, 0))
        hdlr = _full(b"hdlr", bytes(4), b"soun", bytes(12), b"bytes\0")
        tkhd = _box(b"tkhd", struct.pack(">IQQIIQ", 1 << 24 | 3, 0, 0, 1, 0, len(payload)), bytes(8), struct.pack(">HHHH", 0, 0, 0x100, 0), matrix, bytes(8))
        mvhd = _box(b"mvhd", struct.pack(">IQQIQIH", 1 << 24, 0, 0, rate, len(payload), 0x10000, 0x100), bytes(10), matrix, bytes(24), struct.pack(">I", 2))
        return _box(b"moov", mvhd, _box(b"trak", tkhd, _box(b"mdia", mdhd, hdlr, minf)))

    head = 16 if len(payload) + 8 > 0xFFFFFFFF else 8
    offset = len(ftyp) + len(moov(0)) + head
    return ftyp + moov(offset) + _box(b"mdat", payload)


def padded(data: bytes, sample: int = SAMPLE) -> bytes:
    """``data`` with bytes 255 up to a positive multiple of ``sample``."""
    return data + b"\xff" * (-len(data) % sample if data else sample)


def payload_of(data: bytes, track: Track) -> bytes:
    """The bytes of a track's samples, in order."""
    view = memoryview(data)
    return b"".join(view[a : a + n] for a, n in track.samples)


_TRACK = "handler:string,codec:string,timescale:bigint,duration:bigint,n_samples:bigint,keyframes:array<struct<offset:bigint,size:bigint>>"
MEDIA = f"codec string, handler string, timescale long, duration long, n_samples long, keyframes array<struct<offset:bigint,size:bigint>>, tracks array<struct<{_TRACK}>>, error string"


def media_columns(df: DataFrame, content_col: str, id_col: str) -> DataFrame:
    """``id``, the media columns of the first track with pictures, or of the first one, of each file in
    ``content_col``, and ``tracks``, all of them in the file's order.

    Defined cases: a null or empty file, one without a track, and one whose boxes don't hold together
    give nulls and the reason in ``error``; a file of any length is read in place, and only its tables
    are copied; repeated rows are returned as often as they came; an empty table gives an empty result;
    other columns are ignored.
    """
    ship(df.sparkSession)
    names = ("codec", "handler", "timescale", "duration", "n_samples", "keyframes")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            rows = [_media_row(x.as_py()) for x in batch.column(1)]
            best = [_main(r[0]) for r in rows]
            cols = [pa.array([t and t[n] for t in best], _MEDIA_TYPES[n]) for n in names]
            cols += [pa.array([r[0] for r in rows], pa.list_(pa.struct([(n, _MEDIA_TYPES[n]) for n in ("handler", "codec", *names[2:])]))), pa.array([r[1] for r in rows], pa.string())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *cols], ["id", *names, "tracks", "error"])

    kind = df.select(F.col(id_col)).schema[0].dataType.simpleString()
    return df.select(F.col(id_col).alias("id"), F.col(content_col).cast("binary").alias("c")).mapInArrow(run, f"id {kind}, {MEDIA}").withColumnRenamed("id", id_col)


_MEDIA_TYPES = {"codec": pa.string(), "handler": pa.string(), "timescale": pa.int64(), "duration": pa.int64(), "n_samples": pa.int64(), "keyframes": pa.list_(pa.struct([("offset", pa.int64()), ("size", pa.int64())]))}


def _media_row(data: bytes | None) -> tuple[list[dict] | None, str | None]:
    try:
        tracks = read_media(data or b"")
        if not tracks:
            raise BadMedia("no track")
    except (BadMedia, struct.error) as e:
        return None, str(e)
    return [{"handler": t.handler, "codec": t.codec, "timescale": t.timescale, "duration": t.duration, "n_samples": len(t.samples), "keyframes": [{"offset": a, "size": n} for a, n in t.keyframes]} for t in tracks], None


def _main(tracks: list[dict] | None) -> dict | None:
    return next((t for t in tracks if t["handler"] == "vide"), tracks[0]) if tracks else None


DIGESTS = "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, codec string, duration_s double, n_keyframes long, keyframe_bytes long, keyframes string, feature string"


def media_digests(text: str | None) -> tuple:
    """Store one text as a media file, read the file back and derive its digests."""
    data = (text or "").encode("utf-8", "surrogatepass")
    media = write_media(padded(data))
    track = read_media(media)[0]
    payload = payload_of(media, track)
    ranges = b"".join(struct.pack(">QQ", *r) for r in track.keyframes)
    feature = f"codec={track.codec.strip()};timescale={track.timescale};duration={track.duration};samples={len(track.samples)};keyframes={len(track.keyframes)};first={track.keyframes[0][0]}+{track.keyframes[0][1]};last={track.keyframes[-1][0]}+{track.keyframes[-1][1]};ranges_crc32={zlib.crc32(ranges)}"
    return (len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(media), hashlib.sha256(media).hexdigest(), track.codec, track.duration / track.timescale, len(track.keyframes), sum(n for _, n in track.keyframes), ",".join(f"{a}+{n}" for a, n in track.keyframes), feature)


def stored_digests(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row with the digests of its text stored as a media file and read back, and
    the byte ranges of its keyframes (``offset+size``, comma-joined).

    Defined cases: a null text counts as empty, stored as one sample of bytes 255; a text of any length
    is one track, beyond 4 GB with 64-bit boxes; repeated rows are returned as often as they came; an
    empty table gives an empty result; other columns are ignored.
    """
    ship(df.sparkSession)
    names = [x.split()[0] for x in DIGESTS.split(", ")]
    types = [{"long": pa.int64(), "string": pa.string(), "double": pa.float64()}[x.split()[1]] for x in DIGESTS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            rows = [media_digests(x.as_py()) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array([r[i] for r in rows], t) for i, t in enumerate(types)]], ["id", *names])

    kind = df.select(F.col(id_col)).schema[0].dataType.simpleString()
    return df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("t")).mapInArrow(run, f"id {kind}, {DIGESTS}").withColumnRenamed("id", id_col)
