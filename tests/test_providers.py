"""Models as plain functions, and the rules without them."""

from pyspark.sql import functions as F

from sparkveil.functions import engine as E
from sparkveil.operators import providers, understanding


def test_fusion_and_fallback():
    base = "ABCDE1234F appears here"
    assert E.detect(base) == []
    sure = E.detect(base, review=providers.with_models(lambda t, spans: [0.99] * len(spans)))
    assert [(s.type, s.method) for s in sure] == [("PAN", "hybrid_semantic_batched")] and abs(sure[0].confidence - 0.905) < 1e-9
    assert E.detect(base, review=providers.with_models(lambda t, spans: 1 / 0)) == []
    (failed,) = E.detect("Send it to a@b.in", review=providers.with_models(lambda t, spans: 1 / 0))
    assert failed.method == "rules_fallback" and failed.evidence.endswith("+model_failed")
    named = E.detect("My name is Asha Rao.", review=providers.with_models(names=lambda t, spans: [0.9] * len(spans)))
    assert named[0].evidence.endswith("+ner") and named[0].confidence == 0.995


def test_embed_and_rank(spark):
    df = spark.createDataFrame([(1, "a"), (2, "a"), (3, None)], "id int, text string")
    out = {r.id: r.vector for r in providers.embed(df, "text", lambda ts: [[3.0, 4.0] if t else [0.0, 0.0] for t in ts]).collect()}
    assert [round(x, 3) for x in out[1]] == [0.6, 0.8] and out[3] == [0.0, 0.0]
    row = spark.range(1).select(providers.rank_labels(F.array(*[F.struct(F.lit(s).alias("score"), F.lit(n).alias("label")) for s, n in ((0.2, "x"), (0.9, "y"), (0.5, "z"))])).alias("r"), providers.tone_level(F.lit(0.7)).alias("t")).first()
    assert row.r.label == "y" and row.r.alternatives == ["z", "x"] and row.t == "medium"


def test_language_and_intent(spark):
    segs = spark.createDataFrame([("hello there",), ("a",)], "text string")
    assert {r.text_language.method for r in providers.language_hints(segs).collect()} == {"unavailable"}
    assert [r.text_language.code for r in providers.language_hints(segs, lambda t: ("en", 1.0)).collect()] == ["en", "unknown"]
    df = spark.createDataFrame([("I will pay tomorrow",)], "text string").withColumn("rule", understanding.intent(F.col("text")))
    model = F.struct(F.lit("payment commitment").alias("label"), F.lit(0.8).alias("confidence"))
    out = df.select(understanding.arbitrate_intent(F.col("rule"), model).alias("i")).first().i
    assert out.method == "semantic+rule_agreement" and 0.8 < out.confidence <= 0.98


def test_name_model_tokens_are_grouped():
    tokens = [(0, 4, "B-GIVENNAME", 0.9), (5, 8, "I-SURNAME", 0.7), (9, 11, "O", 0.9), (12, 14, "I-CITY", 0.8), (20, 24, "I-CITY", 0.6), (25, 29, "B-CITY", 0.5), (30, 30, "B-CITY", 0.9), (31, 35, "PHONENUMBER", 0.4), (36, 40, "COLOUR", 0.9)]
    assert [(k, s, e, round(c, 3)) for k, s, e, c in providers.grouped_entities(tokens)] == [("NAME", 0, 8, 0.8), ("ADDRESS", 12, 14, 0.8), ("ADDRESS", 20, 24, 0.6), ("ADDRESS", 25, 29, 0.5), ("PHONE", 31, 35, 0.4)]


def test_prototype_judge():
    text = "The order is 123456 while my code is 123456, but the meeting is late."
    seen = []

    def embedder(texts):
        seen.extend(texts)
        return [[1.0, 0.0] if "my" in t else [0.0, 2.0] for t in texts]

    judge = providers.prototype_judge(embedder, {"OTP": (["my <VALUE>"], ["order <VALUE>"])})
    spans = [E.Span("OTP", 13, 19, "123456", 0.7, ""), E.Span("OTP", 37, 43, "123456", 0.7, ""), E.Span("PAN", 0, 3, "The", 0.7, "")]
    low, high, none = judge(text, spans)
    assert low < 0.001 and high > 0.999 and none is None
    assert seen[2:] == ["The order is  <VALUE>", "my code is  <VALUE> ,"]


def test_recognition_and_speakers(spark):
    import numpy as np

    from sparkveil.operators import timeline
    from sparkveil.sources import audio

    def recognize(x, rate):
        if x.max() > 0.9:
            raise RuntimeError("too loud")
        return [{"start": 0, "end": 1.23456, "text": " hello there ", "words": [{"word": " hello", "start": 0, "end": 0.5, "probability": 0.8}, {"word": "there", "start": 0.5, "end": 1, "probability": 0.6}]}, {"start": 2, "end": 3, "text": "bye", "avg_logprob": -0.5}]

    wav = lambda a: bytearray(audio.encode_wav(np.full(16_000, a, "float32"), 16_000))
    files = spark.createDataFrame([("a", "wav", wav(0.1)), ("b", "wav", wav(0.99)), ("c", "mp3", bytearray(b"x"))], "path string, suffix string, content binary")
    segments, words, errors = providers.transcribe(files, recognize)
    assert [(r.call_id, r.seg_id, r.end, r.text, r.confidence) for r in segments.orderBy("seg_id").collect()] == [("a", 0, 1.235, "hello there", 0.7), ("a", 1, 3.0, "bye", 0.6065)]
    assert [r.word for r in words.orderBy("word_idx").collect()] == ["hello", "there"]
    assert {r.call_id: r.error.split(":")[0] for r in errors.collect()} == {"b": "RuntimeError", "c": "BadAudio"}
    turns = providers.diarize(files.where("path = 'a'"), lambda x, rate: [("S0", 0, 1.5), ("S1", 1.5, 4)])
    spoken = timeline.assign_speakers(segments, turns)
    assert {r.seg_id: r.speaker for r in spoken.collect()} == {0: "S0", 1: "S1"} and timeline.word_map(spoken, words).count() == 2
    assert providers.status(names=None, asr=recognize)["names"] == "rules"


def test_windows_are_heard_again(spark):
    import numpy as np

    from sparkveil.sources import audio

    def again(x, rate):
        if len(x) < rate:
            raise RuntimeError("too short")
        return [{"start": 0, "end": len(x) / rate, "text": f"it is {391 if x.max() > 0.4 else 0}", "words": [{"word": "391", "start": 0.25, "end": 0.5, "probability": 0.8}]}]

    wave = np.zeros(64_000, "float32")
    wave[32_000:] = 0.5
    files = spark.createDataFrame([("a", "wav", bytearray(audio.encode_wav(wave, 16_000))), ("b", "wav", bytearray(b"junk")), ("c", "wav", bytearray(b""))], "path string, suffix string, content binary")
    windows = spark.createDataFrame([("a", 1, 2.0, 3.5), ("a", 2, 0.0, 1.5), ("a", 3, 3.0, 3.5), ("a", 4, 9.0, 9.5), ("b", 1, 0.0, 1.0)], "call_id string, rank int, time_start double, time_end double")
    out = {(r.call_id, r["rank"]): r for r in providers.decode_windows(windows, files, again).collect()}
    assert len(out) == 5 and out["a", 3].error == "RuntimeError: too short" and out["a", 4].error == "window too short"
    assert out["a", 1].text == "it is 391" and out["a", 2].text == "it is 0"
    assert (out["a", 1].words[0].start, out["a", 1].words[0].end) == (2.25, 2.5) and out["b", 1].error.startswith("BadAudio")
