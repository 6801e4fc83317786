"""Whole analyses and the command line."""

import datetime

import pytest
from pyspark.sql import functions as F

from sparkveil.__main__ import main
from sparkveil.plans.analyze import Options, analyze_calls, analyze_texts
from test_timeline import call


def test_texts(spark):
    df = spark.createDataFrame([(1, "My phone number is 9876543210. I will pay Rs 500 tomorrow.", datetime.date(2026, 1, 5)), (2, None, None)], "call_id int, text string, call_date date")
    out = {r.call_id: r for r in analyze_texts(df).collect()}
    assert out[1].safe_text.startswith("My phone number is [PHONE REDACTED].") and out[1].pii[0].masked_value == "[PHONE REDACTED]"
    assert out[1].obligations[0].due_date == datetime.date(2026, 1, 6) and out[1].intent.label == "payment commitment"
    assert out[2].safe_text == "" and out[2].pii_confidence == 1.0 and out[2].regulatory.risk_level == "low"


def test_calls(spark):
    text = "My phone number is 9876543210 9123456789. Please tell me your CVV. Mine ID, hello."
    seg, words = call(spark, text, "9876543210")
    out = analyze_calls(seg, words)
    (s,) = out["segments"].collect()
    assert s.safe_text == "My phone number is 9876543210 [PHONE REDACTED]. Please tell me your CVV.Mine is [CVV AUDIO PROTECTED]. hello." or "9123456789" not in s.safe_text
    assert [(w.type, w.source) for w in out["windows"].collect()] == [("CVV", "followup_expectation")]
    spans = out["spans"].collect()
    assert [x.type for x in spans] == ["PHONE"] and "value" not in out["spans"].columns
    assert len(out["intervals"].collect()) == 2
    assert analyze_calls(seg, words, options=Options(conservative_guard=False))["intervals"].count() == 1


def test_command_line(spark, tmp_path):
    src, dst = str(tmp_path / "in"), str(tmp_path / "out")
    spark.createDataFrame([(1, "My OTP is 638291.", "2026-01-05")], "call_id int, text string, day string").write.parquet(src)
    main(["protect", src, dst])
    assert spark.read.parquet(dst).first().text == "My OTP is [OTP REDACTED]."
    main(["analyze", src, dst, "--date", "day"])
    assert spark.read.parquet(dst).select(F.size("pii")).first()[0] == 1


def test_recovery_is_part_of_the_analysis(spark):
    seg, words = call(spark, "My OTP is blah. I made a mistake. 124981.")
    out = analyze_calls(seg, words)
    assert out["segments"].first().safe_text == "My OTP is [OTP AUDIO PROTECTED] I made a mistake. [OTP AUDIO PROTECTED]."
    assert sorted((r.source, r.status) for r in out["recovery"].collect()) == [("correction_continuation", "guarded"), ("owned_field", "guarded")]
    total = out["telemetry"].where("type is null").first()
    assert (total.planned, total.guarded, total.corrections) == (1, 2, 1) and out["intervals"].count() == 2
    heard = spark.createDataFrame([(1, 1, "it is 638291", [("it", 0.7, 0.8, 0.9), ("is", 0.8, 0.9, 0.9), ("638291", 0.9, 1.2, 0.8)])], "call_id int, rank int, text string, words array<struct<word:string,start:double,end:double,confidence:double>>")
    sure = analyze_calls(seg, words, heard=heard)
    assert [r.status for r in sure["recovery"].collect()] == ["confirmed"] and "AUDIO PROTECTED" not in sure["segments"].first().safe_text


def test_calls_and_fingerprint_commands(spark, tmp_path, capsys):
    seg, words = call(spark, "My phone number is 9876543210.")
    seg.write.parquet(str(tmp_path / "segs"))
    words.write.parquet(str(tmp_path / "words"))
    assert main(["calls", str(tmp_path / "segs"), str(tmp_path / "words"), str(tmp_path / "out"), "--max-windows", "2"]) == 0
    assert spark.read.parquet(str(tmp_path / "out" / "segments")).first().safe_text == "My phone number is [PHONE REDACTED]."
    seg.select("call_id", "text").write.parquet(str(tmp_path / "texts"))
    assert main(["protect", str(tmp_path / "texts"), str(tmp_path / "p"), "--types", "OTP", "--include-raw"]) == 0
    assert spark.read.parquet(str(tmp_path / "p")).first().raw_text == "My phone number is 9876543210."
    file = tmp_path / "versions.json"
    assert main(["fingerprint", str(file), "--strict"]) == 0
    assert main(["fingerprint", str(file), "--strict", "--model", "asr=2"]) == 3
    assert main(["fingerprint", str(file), "--strict", "--model", "asr=2"]) == 0


def test_options_from_variables():
    o = Options.from_env({"SPARKVEIL_PROFILE": "high_recall", "SPARKVEIL_IDS": "Yes", "SPARKVEIL_SWEARS": "off", "SPARKVEIL_WINDOWS": "2", "SPARKVEIL_TYPES": "OTP, PAN", "OTHER": "1"})
    assert (o.profile, o.ids, o.swears, o.windows, o.types, o.mode) == ("high_recall", True, False, 2, frozenset(["OTP", "PAN"]), "full")
    assert Options.from_env({}) == Options()
    with pytest.raises(ValueError, match="neither"):
        Options.from_env({"SPARKVEIL_IDS": "maybe"})
