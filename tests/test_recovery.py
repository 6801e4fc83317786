"""Recovery windows, suffix edits and the streaming form."""

from sparkveil.functions import engine as E
from sparkveil.operators import recovery, timeline
from sparkveil.streaming import protect as stream
from test_timeline import call

ASKED = "The CVV is located on the back of the card. Mine ID, address is available."


def planned(text):
    return [(p[0], text[p[1] : p[2]]) for p in recovery.plan(text, [(s.type, s.start, s.end) for s in E.detect(text)])]


def test_plans():
    assert [k for k, _ in planned(ASKED)] == ["CVV"]
    assert planned("My registered name is 2210.") == [("NAME", "2210.")]
    assert planned("My phone number is 9876543210.") == []
    assert planned("My email is not available.") == []
    assert [k for k, _ in planned("My PAN is hotel delta. Foxtrot nine.")] == ["PAN"]


def test_windows_and_guards(spark):
    seg, words = call(spark, ASKED)
    texts, tokens = timeline.call_text(seg), timeline.word_map(seg, words)
    none = spark.createDataFrame([], "call_id int, type string, start int, end int")
    (w,) = recovery.plan_recovery(texts, none, tokens).collect()
    assert w["type"] == "CVV" and w["time_end"] - w["time_start"] <= 1.4 + 0.7 + 0.4 + 1e-9
    (g,) = recovery.guard_intervals(recovery.plan_recovery(texts, none, tokens)).collect()
    assert g["end"] - g["start"] <= 1.4 + 1e-9 and g["confidence"] == 0.72
    audit = spark.createDataFrame([("CVV", "guarded"), ("CVV", "confirmed"), ("OTP", "guarded")], "type string, status string")
    assert {r["type"]: (r["planned"], r["confirmed"], r["guarded"]) for r in recovery.telemetry(audit).collect()} == {None: (3, 1, 2), "CVV": (2, 1, 1), "OTP": (1, 0, 1)}


def test_suffix_edits():
    text = "My phone is 9876543210. Last two digits are 42."
    spans = [("PHONE", 12, 22, "9876543210", 4)]
    assert [(text[s:e], n) for _, s, e, n in recovery.suffix_edits(text, spans)] == [("42", 2)]
    assert recovery.suffix_edits(text.replace("two", "three"), spans) == []
    assert recovery.suffix_edits(text.replace("Last", "In the sample the last"), spans) == []
    assert len(recovery.suffix_edits(text.replace("two digits are 42", "digit is nine"), spans)) == 1


def test_stream(spark, tmp_path):
    rows = [(1, "2024-01-01 00:00:01", "My phone number is 9876543210."), (2, "2024-01-01 00:03:00", "My OTP is 638291."), (3, "2024-01-01 00:20:00", "hello")]
    spark.createDataFrame(rows, "call_id long, ts string, text string").write.json(str(tmp_path / "in"))
    source = spark.readStream.schema("call_id long, ts timestamp, text string").json(str(tmp_path / "in"))
    q = stream.hidden_by_window(stream.protect_stream(source)).writeStream.format("memory").queryName("hidden").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    q.awaitTermination(120)
    assert {(r["type"], r["hidden"]) for r in spark.table("hidden").collect()} == {("PHONE", 1), ("OTP", 1)}


def test_recover(spark):
    windows = spark.createDataFrame([(1, 1, "CVV", 1.0, 3.0, 1.4), (1, 2, "OTP", 5.0, 7.0, 1.8), (2, 1, "PAN", 0.0, 2.0, 2.4)], "call_id int, rank int, type string, time_start double, time_end double, longest double")
    windows = windows.selectExpr("*", "0 as char_start", "5 as char_end", "0.9D as alignment_confidence", "'r' as reason", "'s' as source")
    heard = spark.createDataFrame([(1, 1, "it is 391", [("it", 1.0, 1.2, 0.9), ("is", 1.2, 1.4, 0.9), ("391", 1.5, 2.1, 0.8)]), (1, 2, "sorry what", [("sorry", 5.0, 5.5, 0.9)])], "call_id int, rank int, text string, words array<struct<word:string,start:double,end:double,confidence:double>>")
    intervals, audit = recovery.recover(windows, heard)
    assert {(r.call_id, r["rank"]): r.status for r in audit.collect()} == {(1, 1): "confirmed", (1, 2): "guarded", (2, 1): "guarded"}
    got = {tuple(r.types): (round(r.start, 2), round(r.end, 2)) for r in intervals.collect()}
    assert got == {("CVV",): (1.4, 2.22), ("OTP",): (5.0, 6.8), ("PAN",): (0.0, 2.0)}
    assert recovery.recover(windows, heard, guard=False)[0].count() == 1


def test_a_window_without_words_is_timed_by_its_segment(spark):
    seg, words = call(spark, "My registered name is 2210.")
    texts, tokens = timeline.call_text(seg), timeline.word_map(seg, words.limit(0))
    none = spark.createDataFrame([], "call_id int, type string, start int, end int")
    assert recovery.plan_recovery(texts, none, tokens).count() == 0
    (w,) = recovery.plan_recovery(texts, none, tokens, offsets=timeline.segment_offsets(seg)).collect()
    assert (w.type, w.time_start, w.alignment_confidence) == ("NAME", 0.0, 0.0) and w.time_end > 0


def corrected(text, guards, accepted=()):
    return [(i, r, text[s:e]) for i, r, s, e, _ in recovery.later_values(text, guards, list(accepted))]


def test_values_after_a_guard():
    text = "My OTP is blah. I made a mistake. 124981."
    assert corrected(text, [("OTP", 15)]) == [(0, 1, "124981")]
    assert corrected(text, [("OTP", 15)], [("OTP", 34, 40)]) == []
    assert corrected(text.replace("I made a mistake", "The order is late"), [("OTP", 15)]) == []
    assert corrected(text.replace("mistake.", "mistake about the reference."), [("OTP", 15)]) == []
    assert corrected("My OTP is blah. Sorry, my email is a@b.in. 124981.", [("OTP", 15)]) == []
    assert corrected("My phone is noise. Last two digits are four two.", [("PHONE", 18)]) == [(0, 0, "four two")]
    assert corrected("My phone is noise. Last two digits are 421.", [("PHONE", 18)]) == []
    assert corrected("My name is 22. Last digit is 4.", [("NAME", 14)]) == []


def test_corrections_need_a_sure_time(spark):
    text = "My OTP is blah. I made a mistake. 124981."
    for confidence, found in ((0.95, 1), (0.40, 0)):
        seg, words = call(spark, text, confidence=confidence)
        guards = spark.createDataFrame([(1, 1, "OTP", 15)], "call_id int, rank int, type string, char_end int")
        none = spark.createDataFrame([], "call_id int, type string, start int, end int")
        out = recovery.corrections_after_guards(guards, timeline.call_text(seg), none, timeline.word_map(seg, words))
        assert out.count() == found
