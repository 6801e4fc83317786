"""Case files, bundles and files of protected audio."""

import os
import stat

import pytest
from pyspark.sql import functions as F

from sparkveil.sources import audio, cases


def test_bad_lines_are_errors(spark, tmp_path):
    good = tmp_path / "good.jsonl"
    good.write_text('{"id": "1", "text": "a", "expected": []}\n\n   \n{"id": "2", "expected": [{"type": "OTP", "value": "12"}]}\n{"text": "no id"}\n')
    assert [(r.id, r.text) for r in cases.read_cases(spark, str(good)).collect()] == [("1", "a"), ("2", None), (None, "no id")]
    bad = tmp_path / "bad.jsonl"
    bad.write_text('{"id": "1", "text": "a", "expected": []}\n{"id": "2", "text": \n')
    with pytest.raises(Exception, match="(?i)malformed"):
        cases.read_cases(spark, str(bad)).collect()


def test_bundles_belong_to_their_owner(spark, tmp_path):
    df = spark.createDataFrame([("my secret", "my [X]"), (None, "")], "raw string, safe string")
    path = cases.write_bundle(df, str(tmp_path), "7", "raw", "safe")
    assert stat.S_IMODE(os.stat(path).st_mode) == 0o700
    assert all(stat.S_IMODE(os.stat(os.path.join(path, f)).st_mode) == 0o600 for f in os.listdir(path) if not f.startswith("."))
    rows = spark.read.json(path)
    assert "raw" not in rows.columns and rows.agg(F.sum("raw_chars")).first()[0] == 9


def test_fingerprint(spark):
    now = cases.runtime_fingerprint({"asr": "1"}, ("pyspark", "no-such-package"))
    assert now["model:asr"] == "1" and now["pyspark"] and now["no-such-package"] is None
    out = {r.name: (r.before, r.now) for r in cases.fingerprint_drift(spark, {"a": "1", "b": "1"}, {"a": "2", "c": "1"}).collect()}
    assert out == {"a": ('"1"', '"2"'), "b": ('"1"', None), "c": (None, '"1"')}


def test_report_and_summary(spark, tmp_path):
    rows = spark.createDataFrame([("pii", "1", 1)], "suite string, id string, tp int")
    cases.write_report(rows, str(tmp_path / "r"), rows.groupBy("suite").count())
    assert spark.read.option("header", True).csv(str(tmp_path / "r")).columns == ["suite", "id", "tp"]
    assert spark.read.json(str(tmp_path / "r-summary")).first()["count"] == 1


def test_protected_files(spark, tmp_path):
    import numpy as np

    wav = audio.encode_wav(np.ones(16_000, "float32") * 0.5, 16_000)
    files = spark.createDataFrame([("x/a.wav", "wav", bytearray(wav)), ("y/a.wav", "wav", bytearray(b"junk"))], "path string, suffix string, content binary").withColumn("intervals", F.expr("array(named_struct('start', 0.0D, 'end', 0.5D))"))
    out = {r.path: r for r in audio.write_protected(audio.protect_audio(files, "mute"), str(tmp_path / "safe")).collect()}
    x, rate = audio.decode_wav(open(out["x/a.wav"].protected_path, "rb").read())
    assert rate == 16_000 and (x[:8000] == 0).all() and (x[8000:] > 0.4).all()
    assert out["y/a.wav"].protected_path is None and out["y/a.wav"].error
    took = audio.profile(wav)
    assert set(took) == {"load_ms", "acoustic_ms", "tamper_ms", "duration_s"} and took["duration_s"] == 1.0
