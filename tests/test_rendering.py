"""Safe segments, markers, rediscovery and suffix corrections on hand-made calls."""

from pyspark.sql import functions as F

from sparkveil.operators import privacy, recovery, rendering, timeline
from test_timeline import call


def detected(texts):
    return privacy.detect(texts).select("call_id", F.posexplode("pii").alias("span_id", "s")).select("call_id", "span_id", "s.type", "s.start", "s.end", "s.value", "s.confidence", "s.ownership")


def test_segments_show_the_decisions_on_the_whole_text(spark):
    segs = spark.createDataFrame([(1, 0, 0.0, 2.0, "My phone number is 98765", "A"), (1, 1, 2.0, 4.0, "43210, damn sh1t.", "A"), (1, 2, 4.0, 5.0, "bye", "A"), (2, 0, 0.0, 1.0, None, "A")], "call_id int, seg_id int, start double, end double, text string, speaker string")
    texts = timeline.call_text(segs)
    parts = rendering.replacements(privacy.protect_documents(texts))
    out = {(r.call_id, r.seg_id): r.safe_text for r in rendering.safe_segments(timeline.segment_offsets(segs), parts).collect()}
    assert out == {(1, 0): "My phone number is [PHONE REDACTED]", (1, 1): "[PHONE REDACTED], damn [BLEEP].", (1, 2): "bye", (2, 0): ""}
    whole = {r.call_id: r.safe_text for r in rendering.safe_texts(texts, parts).collect()}
    assert whole == {1: "My phone number is [PHONE REDACTED], damn [BLEEP]. bye", 2: ""}


def test_markers(spark):
    text = "The CVV is located on the back of the card. Mine ID, address is available."
    seg, words = call(spark, text)
    texts = timeline.call_text(seg)
    none = spark.createDataFrame([], "call_id int, type string, start int, end int")
    windows = recovery.plan_recovery(texts, none, timeline.word_map(seg, words))
    (r,) = rendering.safe_texts(texts, rendering.guard_markers(windows, texts)).collect()
    assert r.safe_text == "The CVV is located on the back of the card.Mine is [CVV AUDIO PROTECTED]. address is available."


def test_a_value_cut_off_by_punctuation_is_found_again(spark):
    text = "My OTP is 638291... 638292."
    seg, words = call(spark, text, "638291...")
    texts = timeline.call_text(seg)
    tokens = timeline.word_map(seg, words)
    out = timeline.correct_calls(detected(texts), tokens, texts).collect()
    assert [(r.value, r.corrected_by) for r in out] == [("638292", "timed_punctuation_restart_rediscovered")]
    quick, quick_words = call(spark, text)
    kept = timeline.correct_calls(detected(texts), timeline.word_map(quick, quick_words), texts).collect()
    assert [(r.value, r.corrected_by) for r in kept] == [("638291", None)]


def test_suffix_corrections(spark):
    text = "My phone is 9876543210. Last two digits are 42."
    for confidence, shown in ((0.95, True), (0.4, False)):
        seg, words = call(spark, text, confidence=confidence)
        texts = timeline.call_text(seg)
        (r,) = timeline.suffix_corrections(detected(texts), timeline.word_map(seg, words), texts).collect()
        assert (text[r.start : r.end], r.digits, r.expose_old) == ("42", 2, shown)
