"""Audio source, metrics and redaction on made sounds."""

import numpy as np
import pytest

from sparkveil.operators import signal
from sparkveil.sources import audio


def tone(seconds=2.0, rate=16_000, hz=440.0, loud=0.3):
    return (loud * np.sin(2 * np.pi * hz * np.arange(int(seconds * rate)) / rate)).astype(np.float32)


def test_wav_round_trip_and_resampling():
    x = tone()
    y, rate = audio.decode_wav(audio.encode_wav(x, 16_000))
    assert rate == 16_000 and np.abs(x - y).max() < 1e-4
    z = audio.load(audio.encode_wav(tone(rate=48_000, seconds=5), 48_000), "wav")
    assert abs(len(z) - 5 * 16_000) <= 1 and np.abs(z[8000:-8000] - tone(seconds=5)[8000:-8000]).max() < 0.02


def test_bad_files():
    for data, suffix in ((b"", "wav"), (b"RIFFxxxx", "wav"), (audio.encode_wav(np.zeros(0, np.float32), 16_000), "wav"), (b"x", "txt"), (b"x", "mp3")):
        with pytest.raises(audio.BadAudio):
            audio.load(data, suffix)


def test_redaction():
    x = tone()
    quiet = signal.redact(x, 16_000, [(0.5, 1.0)], "mute")
    assert not quiet[8000:16000].any() and np.array_equal(quiet[:8000], x[:8000])
    beep = signal.redact(x, 16_000, [(0.5, 1.0), (1.9, 9.0), (5, 6)])
    assert 0.1 <= np.abs(beep[8000:16000]).max() <= 0.22 and np.array_equal(beep[16001:30000], x[16001:30000])


def test_metrics():
    rng = np.random.default_rng(0)
    noise = rng.normal(0, 0.1, 32_000).astype(np.float32)
    noise[:12_000] *= 0.01
    quality, stress = signal.acoustics(noise, 16_000)
    assert 0 <= quality["score"] <= 1 and quality["snr_db_proxy"] > 8 and stress["level"] in ("low", "medium", "high")
    assert signal.acoustics(np.zeros(0, np.float32), 16_000)[0]["issues"] == ["empty_audio"]
    assert signal.tamper(np.tile(noise[:8000], 6), 16_000)["signals"] == ["repeated_audio_blocks"]
    assert signal.tamper(noise[:100], 16_000)["risk"] == "UNKNOWN"


def test_files_as_rows(spark, tmp_path):
    (tmp_path / "a.wav").write_bytes(audio.encode_wav(tone(), 16_000))
    (tmp_path / "b.mp3").write_bytes(b"junk")
    (tmp_path / "c.txt").write_bytes(b"junk")
    files = audio.read_audio(spark, str(tmp_path))
    out = {r.path.rsplit("/", 1)[1]: r for r in audio.audio_metrics(files).collect()}
    assert set(out) == {"a.wav", "b.mp3"} and out["a.wav"].duration_s == 2 and "no decoder" in out["b.mp3"].error
    from pyspark.sql import functions as F

    hidden = audio.protect_audio(files.withColumn("intervals", F.array(F.struct(F.lit(0.5).alias("start"), F.lit(1.0).alias("end")))), "mute").where("error is null").first()
    x, _ = audio.decode_wav(bytes(hidden.protected))
    assert not x[8000:16000].any() and x[:8000].any()
