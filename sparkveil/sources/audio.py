"""Audio files as rows, and protected audio back to files.

WAV is decoded here with the standard library; other containers need a decoder that this environment
lacks, and their rows carry the reason in ``error`` unless a ``decode`` function is given.
"""

from __future__ import annotations

import hashlib
import io
import time
import wave
from collections.abc import Callable, Iterator
from math import gcd

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkveil.session import ship

#: Suffixes that the audio source accepts.
SUFFIXES = ("wav", "mp3", "flac", "m4a", "ogg", "aac", "mp4", "webm", "mov")
RATE = 16_000


class BadAudio(ValueError):
    """The file can't be decoded, or holds no sound."""


def decode_wav(data: bytes) -> tuple[np.ndarray, int]:
    """Mono samples between -1 and 1, and their rate."""
    try:
        with wave.open(io.BytesIO(data)) as w:
            channels, width, rate, raw = w.getnchannels(), w.getsampwidth(), w.getframerate(), w.readframes(w.getnframes())
    except (wave.Error, EOFError) as e:
        raise BadAudio(f"not a PCM WAV file: {e}") from e
    if width == 1:
        x = (np.frombuffer(raw, np.uint8).astype(np.float32) - 128) / 128
    elif width == 3:
        b = np.frombuffer(raw[: len(raw) // 3 * 3], np.uint8).reshape(-1, 3).astype(np.int32)
        x = ((b[:, 0] | b[:, 1] << 8 | b[:, 2] << 16) - ((b[:, 2] >> 7) << 24)).astype(np.float32) / (1 << 23)
    else:
        x = np.frombuffer(raw, "<i2" if width == 2 else "<i4").astype(np.float32) / (1 << (8 * width - 1))
    return x[: len(x) // channels * channels].reshape(-1, channels).mean(1), rate


def resample(x: np.ndarray, rate: int, to: int) -> np.ndarray:
    """Band-limited resampling: the spectrum is cut or padded in blocks that fade into each other."""
    if rate == to or not len(x):
        return x
    n = max(1, round(len(x) * to / rate))
    unit = rate // gcd(rate, to)  # blocks begin at whole samples of either rate
    block = 2 * unit * max(1, (1 << 15) // unit)
    if len(x) <= block:
        spectrum = np.fft.rfft(x)
        keep = np.zeros(n // 2 + 1, complex)
        m = min(len(keep), len(spectrum))
        keep[:m] = spectrum[:m]
        return (np.fft.irfft(keep, n) * (n / len(x))).astype(np.float32)
    half, out, weight = block // 2, np.zeros(n + 2 * block, np.float32), np.zeros(n + 2 * block, np.float32)
    for at in range(0, len(x), half):
        part = x[at : at + block]
        made = resample(part, rate, to)
        fade = np.hanning(len(made) + 2)[1:-1].astype(np.float32) + 1e-4
        s = round(at * to / rate)
        out[s : s + len(made)] += made * fade
        weight[s : s + len(made)] += fade
    return out[:n] / np.maximum(weight[:n], 1e-6)


def load(data: bytes, suffix: str, rate: int = RATE, decode: Callable[[bytes, str], tuple[np.ndarray, int]] | None = None) -> np.ndarray:
    """The samples of a file at ``rate``, without NaN. Raises BadAudio."""
    if suffix.lower() not in SUFFIXES:
        raise BadAudio(f"unsupported format: {suffix}")
    if suffix.lower() == "wav" and decode is None:
        x, own = decode_wav(data)
    elif decode is not None:
        x, own = decode(data, suffix)
    else:
        raise BadAudio(f"no decoder for {suffix} here")
    if not len(x):
        raise BadAudio("decoded audio is empty")
    return np.nan_to_num(resample(x.astype(np.float32), own, rate))


def encode_wav(x: np.ndarray, rate: int) -> bytes:
    """16-bit PCM."""
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(2)
        w.setframerate(rate)
        w.writeframes((np.clip(x, -1, 1 - 1 / 32768) * 32768).round().astype("<i2").tobytes())
    return out.getvalue()


def read_audio(spark: SparkSession, path: str, recursive: bool = True) -> DataFrame:
    """``path, suffix, content`` of the audio files under a path."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", recursive).option("pathGlobFilter", "*.{" + ",".join(SUFFIXES) + "}").load(path)
    return files.select("path", F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).alias("suffix"), "content")


METRICS = "path string, duration_s double, quality struct<score:double,snr_db_proxy:double,silence_ratio:double,clipping_ratio:double,zero_crossing_rate:double,issues:array<string>>, stress struct<score:double,level:string>, tamper struct<risk:string,score:double,signals:array<string>>, error string"


def audio_metrics(files: DataFrame) -> DataFrame:
    """Signal metrics of audio files, decoded once inside an Arrow batch."""
    from sparkveil.operators.signal import acoustics, tamper

    ship(files.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, suffix, content in batch[["path", "suffix", "content"]].itertuples(index=False):
                try:
                    x = load(bytes(content), suffix)
                    quality, stress = acoustics(x, RATE)
                    rows.append((path, len(x) / RATE, quality, stress, tamper(x, RATE), None))
                except BadAudio as e:
                    rows.append((path, None, None, None, None, str(e)))
            yield pd.DataFrame(rows, columns=["path", "duration_s", "quality", "stress", "tamper", "error"])

    return files.mapInPandas(run, METRICS)


def protect_audio(files: DataFrame, method: str = "beep") -> DataFrame:
    """``files`` (with ``intervals``, an array of structs start and end) and their protected WAV in
    ``protected``; ``error`` says why there is none."""
    from sparkveil.operators.signal import redact

    if method not in ("beep", "mute"):
        raise ValueError("audio is protected by 'beep' or 'mute'")
    ship(files.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, suffix, content, intervals in batch[["path", "suffix", "content", "intervals"]].itertuples(index=False):
                try:
                    x = load(bytes(content), suffix)
                    safe = redact(x, RATE, [(i["start"], i["end"]) for i in (intervals if intervals is not None else [])], method)
                    rows.append((path, encode_wav(safe, RATE), len(x) / RATE, None))
                except BadAudio as e:
                    rows.append((path, None, None, str(e)))
            yield pd.DataFrame(rows, columns=["path", "protected", "duration_s", "error"])

    return files.mapInPandas(run, "path string, protected binary, duration_s double, error string")


def write_protected(protected: DataFrame, folder: str) -> DataFrame:
    """The protected WAV of each row of ``protect_audio`` as a file of its own under ``folder``, any
    place that pyarrow can write to: ``path, protected_path, error``. A name is the source's, with a
    digest of its path, so a task that runs twice writes the same file."""
    ship(protected.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(folder if "://" in folder else "file://" + folder)
        store.create_dir(root, recursive=True)
        for batch in batches:
            rows = []
            for path, data, error in batch[["path", "protected", "error"]].itertuples(index=False):
                if data is None:
                    rows.append((path, None, error))
                    continue
                stem = path.rsplit("/", 1)[-1].rsplit(".", 1)[0]
                name = f"{stem}-{hashlib.sha256(path.encode()).hexdigest()[:16]}.protected.wav"
                with store.open_output_stream(f"{root}/{name}") as f:
                    f.write(bytes(data))
                rows.append((path, f"{folder.rstrip('/')}/{name}", None))
            yield pd.DataFrame(rows, columns=["path", "protected_path", "error"])

    return protected.select("path", "protected", "error").mapInPandas(run, "path string, protected_path string, error string")


def profile(data: bytes, suffix: str = "wav") -> dict[str, float]:
    """Milliseconds that one file takes to load, to analyse and to screen, and its seconds of sound."""
    from sparkveil.operators.signal import acoustics, tamper

    took, at = {}, time.perf_counter()
    x = load(data, suffix)
    for name, step in (("load_ms", None), ("acoustic_ms", acoustics), ("tamper_ms", tamper)):
        if step is not None:
            step(x, RATE)
        took[name], at = round((time.perf_counter() - at) * 1000, 3), time.perf_counter()
    return took | {"duration_s": len(x) / RATE}
