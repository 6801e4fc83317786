"""Optional models: what a provider must offer, how scores join the rules, and what happens without one.

No model files are part of this repository. A provider is a plain function; operators that take one
work without it by rules alone and say so in ``method``.
"""

from __future__ import annotations

import logging
import math
from collections.abc import Callable, Iterator
from dataclasses import replace

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from sparkveil.functions import patterns as P
from sparkveil.functions.engine import Reader, Span, rx
from sparkveil.functions.spans import let
from sparkveil.operators import evaluation, timeline
from sparkveil.session import materialize, ship
from sparkveil.sources import audio

log = logging.getLogger(__name__)

#: (text, spans) to a score between 0 and 1 for each span, or None where the model has no view.
Judge = Callable[[str, list[Span]], list]
#: The score of a model that raised an error.
FAILED = object()
#: Samples and their rate to segments: dicts with start, end, text, avg_logprob and words (word, start, end, probability).
Recognizer = Callable[[np.ndarray, int], list[dict]]
#: Samples and their rate to turns: (speaker, start, end).
Diarizer = Callable[[np.ndarray, int], list[tuple[str, float, float]]]
#: Texts to vectors.
Embedder = Callable[[list[str]], list[list[float]]]


def with_models(semantic: Judge | None = None, names: Judge | None = None) -> Callable[[str, list[Span]], list[Span]]:
    """A ``review`` for the span engine: a name model's support is added to candidates that asked for
    it, then a semantic score is averaged with the rules' confidence. A model that has no view, or
    fails, leaves the rules' decision; a failure is logged, and the spans say ``model_failed`` in their
    evidence."""

    def scores(judge: Judge, text: str, spans: list[Span]) -> list[float | None]:
        try:
            return judge(text, spans) if spans else []
        except Exception:  # a model's failure must not stop the protection by rules
            log.exception("a model failed on a text of %d characters", len(text))
            return [FAILED] * len(spans)

    def review(text: str, spans: list[Span]) -> list[Span]:
        out = list(spans)
        if names is not None:
            asked = [i for i, x in enumerate(out) if x.ner_review]
            for i, s in zip(asked, scores(names, text, [out[i] for i in asked])):
                if s is FAILED:
                    out[i] = replace(out[i], evidence=out[i].evidence + "+model_failed")
                elif s is not None and s >= 0.70:
                    out[i] = replace(out[i], confidence=round(min(0.995, out[i].confidence + 0.07 * s), 3), evidence=out[i].evidence + "+ner")
        if semantic is not None:
            asked = [i for i, x in enumerate(out) if x.ai_review]
            for i, s in zip(asked, scores(semantic, text, [out[i] for i in asked])):
                if s is None or s is FAILED:
                    out[i] = replace(out[i], method="rules_fallback", evidence=out[i].evidence + ("+model_failed" if s is FAILED else ""))
                else:
                    fused = min(0.995, max(0.0, 0.5 * out[i].confidence + 0.5 * s + 0.08))
                    out[i] = replace(out[i], confidence=round(fused, 3), method="hybrid_semantic_batched", evidence=out[i].evidence + "+semantic")
        return out

    return review


#: Seconds that a window must have to be heard again.
SHORTEST = 0.05
SEGMENT = "struct<seg_id:int,start:double,end:double,text:string,avg_logprob:double,words:array<struct<word:string,start:double,end:double,confidence:double>>>"


def transcribe(files: DataFrame, recognizer: Recognizer, decode=None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(segments, words, errors) of audio files (path, suffix, content), each decoded and recognised
    once; the result is written, as both tables read it. ``call_id`` is the file's path. Times have three
    decimals and confidences four; a segment's confidence is that of its words, see
    ``timeline.segment_confidence``. A file that can't be decoded, or fails, is a row of ``errors``."""
    ship(files.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, suffix, content in batch[["path", "suffix", "content"]].itertuples(index=False):
                try:
                    rows.append((path, [_segment(i, x) for i, x in enumerate(recognizer(audio.load(bytes(content), suffix, decode=decode), audio.RATE))], None))
                except Exception as e:  # one bad file must not stop the others; it is reported
                    rows.append((path, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=["call_id", "segments", "error"])

    heard = materialize(files.mapInPandas(run, f"call_id string, segments array<{SEGMENT}>, error string"), "heard")
    rows = heard.select("call_id", F.explode("segments").alias("s"))
    words = rows.select("call_id", "s.seg_id", F.posexplode("s.words").alias("word_idx", "w")).select("call_id", "seg_id", "word_idx", "w.*")
    segments = timeline.segment_confidence(rows.select("call_id", "s.seg_id", "s.start", "s.end", "s.text", "s.avg_logprob"), words).drop("avg_logprob")
    return segments.withColumn("speaker", F.lit(None).cast("string")), words, heard.where("error is not null").select("call_id", "error")


def _segment(i: int, x: dict) -> dict:
    words = [{"word": w["word"].strip(), "start": round(float(w["start"]), 3), "end": round(float(w["end"]), 3), "confidence": round(float(w["probability"]), 4)} for w in x.get("words") or []]
    return {"seg_id": i, "start": round(float(x["start"]), 3), "end": round(float(x["end"]), 3), "text": x["text"].strip(), "avg_logprob": x.get("avg_logprob"), "words": words}


def decode_windows(windows: DataFrame, files: DataFrame, recognizer: Recognizer, decode=None) -> DataFrame:
    """``call_id, rank, text, words, error``: the second decoding of windows (call_id, rank, time_start,
    time_end) for ``recovery.recover``, words in the call's time. ``files`` (path, suffix, content) have
    the call_id as their path. A call's audio is loaded once for all of its windows, which are few."""
    ship(files.sparkSession)
    kind = "call_id string, rank int, text string, words array<struct<word:string,start:double,end:double,confidence:double>>, error string"

    def again(x: np.ndarray, low: float, high: float) -> tuple[str, list[dict], str | None]:
        part = x[max(0, math.floor(low * audio.RATE)) : min(len(x), math.ceil(high * audio.RATE))]
        if len(part) < SHORTEST * audio.RATE:
            return "", [], "window too short"
        try:
            heard = [_segment(i, s) for i, s in enumerate(recognizer(part, audio.RATE))]
        except Exception as e:  # the window stays guarded; the reason is reported
            return "", [], f"{type(e).__name__}: {e}"
        words = [w | {"start": round(low + w["start"], 3), "end": round(low + w["end"], 3)} for s in heard for w in s["words"]]
        return " ".join(s["text"] for s in heard).strip(), words, None

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, suffix, content, asked in batch[["path", "suffix", "content", "w"]].itertuples(index=False):
                try:
                    x = audio.load(bytes(content), suffix, decode=decode)
                except audio.BadAudio as e:
                    rows += [(path, int(w["rank"]), "", [], f"BadAudio: {e}") for w in asked]
                    continue
                rows += [(path, int(w["rank"]), *again(x, w["time_start"], w["time_end"])) for w in asked]
            yield pd.DataFrame(rows, columns=["call_id", "rank", "text", "words", "error"])

    asked = windows.groupBy(F.col("call_id").cast("string").alias("path")).agg(F.collect_list(F.struct("rank", "time_start", "time_end")).alias("w"))
    return files.join(asked, "path").mapInPandas(run, kind)


def diarize(files: DataFrame, diarizer: Diarizer, decode=None) -> DataFrame:
    """``call_id, turn_idx, speaker, start, end``: the speaker turns of audio files."""
    ship(files.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, suffix, content in batch[["path", "suffix", "content"]].itertuples(index=False):
                turns = diarizer(audio.load(bytes(content), suffix, decode=decode), audio.RATE)
                rows += [(path, i, speaker, float(start), float(end)) for i, (speaker, start, end) in enumerate(turns)]
            yield pd.DataFrame(rows, columns=["call_id", "turn_idx", "speaker", "start", "end"])

    return files.mapInPandas(run, "call_id string, turn_idx int, speaker string, start double, end double")


def status(**given: Callable | None) -> dict[str, str]:
    """Which providers are in use, by the name of their function; the rules stand in for the others."""
    return {name: "rules" if f is None else f"{f.__module__}:{f.__qualname__}" for name, f in given.items()}


def model_type(label: str) -> str | None:
    """The type that a name model's label stands for."""
    name = label.upper().replace("-", "_")
    return next((kind for kind, words in P.MODEL_LABELS if any(w in name for w in words)), None)


def grouped_entities(pieces: list[tuple[int, int, str, float]]) -> list[tuple[str, int, int, float]]:
    """(type, start, end, confidence) from a name model's best label of each token (start, end, label,
    probability). A token goes on with the one before it if its label says so, is of the same type and
    follows it directly; confidences are averaged pair by pair."""
    out: list[list] = []
    for start, end, label, p in pieces:
        marked = label[:2] in ("B-", "I-")
        kind = model_type(label[2:] if marked else label)
        if end <= start or label.upper() == "O" or kind is None:
            continue
        if out and label.startswith("I-") and out[-1][0] == kind and start <= out[-1][2] + 1:
            out[-1][2:] = [end, (out[-1][3] + p) / 2]
        else:
            out.append([kind, start, end, p])
    return [tuple(x) for x in out]


def name_support(candidates: DataFrame, proposals: DataFrame) -> DataFrame:
    """``candidates`` (call_id, span_id, type, start, end) with ``support``: the highest confidence of a
    proposal (call_id, type, start, end, confidence) that touches it and has its type, names and
    addresses standing for each other; 0 without one."""
    c, p = candidates.alias("c"), proposals.alias("p")
    family = F.col("c.type").isin("NAME", "ADDRESS") & F.col("p.type").isin("NAME", "ADDRESS")
    touch = (F.col("p.start") < F.col("c.end")) & (F.col("c.start") < F.col("p.end"))
    hits = c.join(p, (F.col("c.call_id") == F.col("p.call_id")) & touch & ((F.col("c.type") == F.col("p.type")) | family))
    best = hits.groupBy("c.call_id", "c.span_id").agg(F.round(F.max("p.confidence"), 4).alias("support"))
    return candidates.join(best, ["call_id", "span_id"], "left").withColumn("support", F.coalesce("support", F.lit(0.0)))


def judged_context(text: str, x: Span, radius: int = 72) -> str:
    """What a semantic model sees of a span: its clause without the value, between the nearest changes
    of role on both sides."""
    low, high = Reader(text).clause(x.start, x.end, radius)
    low = max([low, *(low + m.end() for m in rx(P.JUDGE_RESET).finditer(text[low : x.start]))])
    if m := rx(P.JUDGE_RESET).search(text[x.end : high]):
        high = x.end + m.start()
    return f"{text[low : x.start]} <VALUE> {text[x.end : high]}".strip()


def prototype_judge(embedder: Embedder, banks: dict[str, tuple[list[str], list[str]]]) -> Judge:
    """A judge from an embedder and, by type, positive and negative example sentences with ``<VALUE>``:
    how much nearer a span's context is to its best positive one, through a logistic of slope 10. Types
    without examples get no view. The examples are embedded once."""
    unit: dict[str, list[float]] = {}

    def vectors(texts: list[str]) -> list[list[float]]:
        made = [[float(v) for v in vec] for vec in embedder(texts)]
        return [[v / max(1e-12, math.sqrt(sum(u * u for u in vec))) for v in vec] for vec in made]

    def judge(text: str, spans: list[Span]) -> list[float | None]:
        if not unit:
            known = list(dict.fromkeys(t for bank in banks.values() for side in bank for t in side))
            unit.update(zip(known, vectors(known)))
        asked = [i for i, x in enumerate(spans) if x.type in banks]
        out: list[float | None] = [None] * len(spans)
        for i, v in zip(asked, vectors([judged_context(text, spans[i]) for i in asked]) if asked else ()):
            near = lambda side: max((sum(a * b for a, b in zip(v, unit[t])) for t in side), default=0.0)  # noqa: B023, E731
            positive, negative = banks[spans[i].type]
            out[i] = round(1 / (1 + math.exp(-10 * (near(positive) - near(negative)))), 4)
        return out

    return judge


def embed(df: DataFrame, text_col: str, embedder: Embedder, out: str = "vector") -> DataFrame:
    """``df`` with an L2-normalised vector of each text. Each distinct text is embedded once: texts
    are grouped first (combined in the map tasks) and joined back."""
    ship(df.sparkSession)

    @pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(embedder(list(texts)))

    size = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda n, x: n + x.cast("double") * x))
    distinct = df.select(F.coalesce(text_col, F.lit("")).alias("_t")).groupBy("_t").agg(F.count(F.lit(1)).alias("_n"))
    vectors = distinct.select("_t", run("_t").alias("_v"))
    vectors = vectors.select("_t", F.transform("_v", lambda x: (x / F.greatest(size(F.col("_v")), F.lit(1e-12))).cast("float")).alias(out))
    return df.join(vectors, F.coalesce(text_col, F.lit("")) == F.col("_t"), "left").drop("_t")


def rank_labels(scores: Column, top: int = 3) -> Column:
    """From an array of structs ``score, label``: the best label, how far it leads, and the next ones."""
    best = F.slice(F.array_sort(scores, lambda a, b: F.when(a["score"] > b["score"], -1).when(a["score"] < b["score"], 1).otherwise(0)), 1, top + 1)
    return F.struct(F.get(best, F.lit(0))["label"].alias("label"), F.get(best, F.lit(0))["score"].alias("confidence"), (F.get(best, F.lit(0))["score"] - F.coalesce(F.get(best, F.lit(1))["score"], F.lit(0.0))).alias("runner_up_margin"), F.transform(F.slice(best, 2, top), lambda x: x["label"]).alias("alternatives"))


def utterance(vector: Column, intents: dict[str, list[list[float]]], tone: tuple[list[list[float]], list[list[float]]]) -> Column:
    """``intent`` (label, confidence, runner_up_margin, alternatives with scores) and ``abusive_tone``
    (score, level) of a text's vector. An intent's examples count for it and against all others; the
    confidence of the best takes its lead into account. Of equal scores the last label by name is first."""
    others = lambda label: [v for k, vs in intents.items() if k != label for v in vs]
    scores = F.array(*[F.struct(evaluation.prototype_score(vector, vs, others(label)).alias("score"), F.lit(label).alias("label")) for label, vs in intents.items()])

    def ranked(best: Column) -> Column:
        top, second = best[0]["score"], F.coalesce(F.get(best, F.lit(1))["score"], F.lit(0.0))
        apart = F.least(F.lit(1.0), F.greatest(F.lit(0.0), 0.5 + (top - second)))
        confidence = F.round(F.greatest(F.lit(0.45), F.least(F.lit(0.97), 0.58 * top + 0.42 * apart)), 4)
        more = F.transform(F.slice(best, 2, 3), lambda x: F.struct(x["label"].alias("label"), x["score"].alias("score")))
        return F.struct(best[0]["label"].alias("label"), confidence.alias("confidence"), F.round(top - second, 4).alias("runner_up_margin"), more.alias("alternatives"))

    abuse = evaluation.prototype_score(vector, *tone)
    return F.struct(let(F.reverse(F.array_sort(scores)), ranked).alias("intent"), let(abuse, lambda s: F.struct(s.alias("score"), tone_level(s).alias("level"))).alias("abusive_tone"))


def tone_level(score: Column) -> Column:
    """The level of an abusive-tone score; without one it was not run."""
    return F.when(score.isNull(), "not_run").when(score >= 0.78, "high").when(score >= 0.60, "medium").otherwise("low")


def language_hints(segments: DataFrame, identify: Callable[[str], tuple[str, float]] | None = None) -> DataFrame:
    """``segments`` with ``text_language`` (code, raw_score, method); short texts are unknown."""
    if identify is None:
        return segments.withColumn("text_language", F.struct(F.lit("unknown").alias("code"), F.lit(0.0).alias("raw_score"), F.lit("unavailable").alias("method")))
    ship(segments.sparkSession)

    @pandas_udf("struct<code:string,raw_score:double,method:string>")
    def run(texts: pd.Series) -> pd.DataFrame:
        rows = [identify(t.strip()) if len((t or "").strip()) >= 3 else ("unknown", 0.0) for t in texts]
        return pd.DataFrame({"code": [r[0] for r in rows], "raw_score": [round(float(r[1]), 3) for r in rows], "method": "text_hint"})

    return segments.withColumn("text_language", run(F.coalesce("text", F.lit(""))))
