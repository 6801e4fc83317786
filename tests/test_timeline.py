"""Timed operators on hand-made calls."""

import pytest
from pyspark.sql import functions as F

from sparkveil.functions.spans import find, greedy, render
from sparkveil.operators import evaluation, timeline, understanding


def call(spark, text, pause_after=None, pause=0.65, confidence=0.95):
    """One segment; each word lasts 0.22 s, with 0.05 s between words or ``pause`` after one of them."""
    at, words = 0.0, []
    for i, w in enumerate(text.split()):
        words.append((1, 0, i, w, at, at + 0.22, confidence))
        at += 0.22 + (pause if w == pause_after else 0.05)
    seg = spark.createDataFrame([(1, 0, 0.0, at, text, "A")], "call_id int, seg_id int, start double, end double, text string, speaker string")
    return seg, spark.createDataFrame(words, "call_id int, seg_id int, word_idx int, word string, start double, end double, confidence double")


def spans_of(spark, text, values, kind="PHONE"):
    rows = [(1, i, kind, text.index(v), text.index(v) + len(v), v, 0.98, 4) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "call_id int, span_id int, type string, start int, end int, value string, confidence double, ownership int")


@pytest.mark.parametrize(("pause", "confidence", "kept", "by"), [(0.65, 0.95, ["9123456789"], ["silent_restart"]), (0.10, 0.95, ["9876543210", "9123456789"], [None, None]), (0.65, 0.40, ["9876543210", "9123456789"], [None, None])])
def test_timed_corrections(spark, pause, confidence, kept, by):
    text = "My phone number is 9876543210 9123456789."
    seg, words = call(spark, text, "9876543210", pause, confidence)
    aligned = timeline.attach_tokens(spans_of(spark, text, ["9876543210", "9123456789"]), timeline.word_map(seg, words))
    out = timeline.timed_corrections(aligned, timeline.call_text(seg)).orderBy("start").collect()
    assert [r["value"] for r in out] == kept and [r["corrected_by"] for r in out] == by


def test_a_value_said_again_is_kept(spark):
    text = "My phone number is 9876543210 9123456789. My phone number is 9876543210."
    seg, words = call(spark, text, "9876543210")
    rows = spans_of(spark, text, ["9876543210", "9123456789"]).union(spark.createDataFrame([(1, 2, "PHONE", text.rindex("9876543210"), text.rindex("9876543210") + 10, "9876543210", 0.98, 4)], "call_id int, span_id int, type string, start int, end int, value string, confidence double, ownership int"))
    out = timeline.timed_corrections(timeline.attach_tokens(rows, timeline.word_map(seg, words)), timeline.call_text(seg))
    assert out.count() == 3


def test_unresolved_spans_still_get_an_interval(spark):
    seg, words = call(spark, "hello there caller")
    spans = spark.createDataFrame([(1, 0, "OTP", 500, 506, "123456", 0.9, 4)], "call_id int, span_id int, type string, start int, end int, value string, confidence double, ownership int")
    aligned = timeline.attach_tokens(spans, timeline.word_map(seg, words))
    assert aligned.first()["alignment_method"] == "unresolved"
    out = timeline.fallback_intervals(aligned, timeline.segment_offsets(seg)).collect()
    assert [r["alignment_method"] for r in out] == ["nearest_segment_guard"] and out[0]["end"] > out[0]["start"]


def test_place_words():
    assert timeline.place_words("My «OTP» is 12.", ["My", "OTP", "is,", "12."]) == [(0, 2), (4, 7), (9, 11), (12, 15)]
    assert timeline.place_words("a", ["zz", "b"]) == [(0, 1), None]


def test_span_algebra(spark):
    df = spark.createDataFrame([("é🙂 a1 b22",), (None,), ("",)], "t string")
    t = F.coalesce("t", F.lit(""))
    rows = df.select(find(t, "[a-z][0-9]+").alias("s"), render(t, find(t, "[0-9]+"), lambda m: F.lit("#")).alias("r")).collect()
    assert [(s["start"], s["end"], s["value"]) for s in rows[0]["s"]] == [(3, 5, "a1"), (6, 9, "b22")]
    assert [r["r"] for r in rows] == ["é🙂 a# b#", "", ""] and rows[1]["s"] == []
    kind = "array<struct<start:int,end:int>>"
    row = spark.sql("select cast(array(struct(0, 5), struct(4, 6), struct(6, 9)) as array<struct<start:int,end:int>>) as s").select(greedy(F.col("s"), kind, lambda x: [x["start"]]).alias("k")).first()
    assert [(x["start"], x["end"]) for x in row["k"]] == [(0, 5), (6, 9)]


def test_word_error_rate():
    assert evaluation.word_error_rate("a b c", "a x c") == pytest.approx(1 / 3)
    assert evaluation.word_error_rate("", "") == 0 and evaluation.word_error_rate("", "a") == 1


def test_regulatory_levels(spark):
    df = spark.createDataFrame([("You are useless.",), ("you will be arrested",), (None,)], "t string")
    assert [r["l"] for r in df.select(understanding.regulatory(F.col("t"))["risk_level"].alias("l")).collect()] == ["medium", "high", "low"]


def test_large_span_ids_are_ids_like_any_other(spark):
    text = "My phone number is 9876543210 please."
    seg, words = call(spark, text)
    spans = spans_of(spark, text, ["9876543210"]).withColumn("span_id", F.lit(1_000_000))
    (r,) = timeline.correct_calls(spans, timeline.word_map(seg, words), timeline.call_text(seg)).collect()
    assert (r.span_id, r.origin, r.value) == (1_000_000, timeline.FOUND, "9876543210")


def test_late_words(spark):
    seg, words = call(spark, "my code is 123456 thanks")
    span = spark.createDataFrame([(1, 0, "OTP", 11, 17, "123456", 0.9, 4)], "call_id int, span_id int, type string, start int, end int, value string, confidence double, ownership int")
    offsets = timeline.segment_offsets(seg)
    (late,) = timeline.fallback_intervals(span, offsets, words).collect()
    (ratio,) = timeline.fallback_intervals(span, offsets, words.limit(0)).collect()
    assert late.alignment_method == "late_word_alignment" and late.start == pytest.approx(3 * 0.27 - 0.13) and late.alignment_confidence == 0.95
    assert ratio.alignment_method == "character_ratio_fallback"


def test_nearest_rank(spark):
    values = [3, 1, 4, 1, 5, 9, 2, 6, 5, 3, 5]
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "v int")
    out = {r.share: r.value for r in evaluation.nearest_rank(df, "v", [0.0, 0.25, 0.5, 0.95, 1.0]).collect()}
    assert out == {s: sorted(values)[round((len(values) - 1) * s)] for s in out} and len(out) == 5
    assert evaluation.nearest_rank(df.limit(0), "v", [0.5]).count() == 0


def test_case_summary(spark):
    kind = "array<struct<type:string,value:string>>"
    rows = [(1, [("OTP", "12 34")], [("OTP", "1234")], "[OTP REDACTED]"), (2, [], [("PAN", "X")], ""), (3, [("OTP", "9"), ("OTP", "9")], [("OTP", "9")], "still 9"), (4, [], [], "")]
    cases = evaluation.case_rows(spark.createDataFrame(rows, f"id int, expected {kind}, found {kind}, safe_text string"))
    assert [(r.tp, r.fp, r.fn, r.leaked, r.passed) for r in cases.orderBy("id").collect()] == [(1, 0, 0, False, True), (0, 1, 0, False, False), (1, 0, 1, True, False), (0, 0, 0, False, True)]
    s = evaluation.case_summary(cases).first()
    assert (s.tp, s.fp, s.fn, s.negative_cases, s.negative_case_false_positive_rate, s.mask_failure_cases) == (2, 1, 1, 2, 0.5, 1)
    empty = evaluation.case_summary(cases.limit(0)).first()
    assert (empty.tp, empty.precision, empty.recall, empty.f1) == (0, 1.0, 1.0, 1.0)
