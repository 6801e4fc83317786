"""Words, segments, speakers and audio intervals: the interval algebra of timed transcripts.

Tables: ``segments(call_id, seg_id, start, end, text, speaker)``, ``words(call_id, seg_id, word_idx,
word, start, end, confidence)``, ``spans(call_id, span_id, type, start, end, confidence)`` with
character offsets, ``turns(call_id, turn_idx, speaker, start, end)``. Every join has ``call_id`` as an
equality key, so it is one shuffle by call with the overlap as a residual condition.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from sparkveil.functions import engine
from sparkveil.functions import patterns as P
from sparkveil.functions.scalars import normal_value
from sparkveil.operators.understanding import says
from sparkveil.session import by_key, ship

#: Seconds: the pad around a span, what an unsure alignment adds, and the gap that merging closes.
PAD, LOW_PAD, LOW_BELOW, MERGE_GAP = 0.09, 0.06, 0.72, 0.06
LATE_PAD, RATIO_PAD = 0.04, 0.12


def segment_offsets(segments: DataFrame) -> DataFrame:
    """``segments`` with ``char_start`` and ``char_end`` in the call's text, in which one space
    stands between segments."""
    order = Window.partitionBy("call_id").orderBy("seg_id").rowsBetween(Window.unboundedPreceding, -1)
    size = F.char_length(F.coalesce("text", F.lit("")))
    out = segments.withColumn("char_start", F.coalesce(F.sum(size + 1).over(order), F.lit(0)).cast("int"))
    return out.withColumn("char_end", (F.col("char_start") + size).cast("int"))


def call_text(segments: DataFrame) -> DataFrame:
    """``call_id, text``: the segments joined by spaces. A call's segments are one conversation, so
    their number is bounded by its length. The texts are dealt out to all tasks for what follows."""
    rows = by_key(segments, "call_id").groupBy("call_id").agg(F.array_sort(F.collect_list(F.struct("seg_id", F.coalesce("text", F.lit("")).alias("text")))).alias("s"))
    return rows.select("call_id", F.array_join(F.transform("s", lambda x: x["text"]), " ").alias("text"))


def place_words(text: str, words: list[str]) -> list[tuple[int, int] | None]:
    """Character ranges of the words of a segment: each is looked for after the one before it, as it
    stands and without outer marks; one that isn't found takes the next run of characters. Lower case
    keeps the length of the text, which case folding would not."""
    low, at, out = text.lower() if len(text.lower()) == len(text) else text, 0, []
    for word in words:
        token = (word or "").strip()
        bare = re.sub(r"^[^\w@+]+|[^\w@.%+\-]+$", "", token)
        hit = next(((p, p + len(t)) for t in dict.fromkeys((token, bare)) if t and (p := low.find(t.lower(), at)) >= 0), None)
        if hit is None and token and (run := re.search(r"\S+", text[at:])):
            hit = (at + run.start(), at + run.end())
        out.append(hit)
        if hit:
            at = max(at, hit[1])
    return out


def word_map(segments: DataFrame, words: DataFrame) -> DataFrame:
    """``call_id, token_id, seg_id, word_idx, speaker, char_start, char_end, time_start, time_end,
    confidence``: each word's place in the call's text and time.

    Words are placed one after another inside a segment, which is sequential. So a call's segments and
    words, which are as long as the call, meet in one row, behind one shuffle of either side, and are
    numbered there.
    """
    ship(segments.sparkSession)

    @pandas_udf("array<struct<i:int,s:int,e:int>>")
    def place(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for parts, lists in batches:
            yield pd.Series([_placed(s, w) for s, w in zip(parts, lists)])

    text = F.coalesce("text", F.lit("")).alias("text")
    parts = by_key(segments, "call_id").groupBy("call_id").agg(F.array_sort(F.collect_list(F.struct("seg_id", text, "start", "end", "speaker"))).alias("s"))
    spoken = by_key(words, "call_id").groupBy("call_id").agg(F.array_sort(F.collect_list(F.struct("seg_id", "word_idx", "word", "start", "end", "confidence"))).alias("w"))
    small = lambda xs, *names: F.transform(xs, lambda x: F.struct(*[x[n].alias(n) for n in names]))
    rows = parts.join(spoken, "call_id").withColumn("p", place(small("s", "seg_id", "text"), small("w", "seg_id", "word")))
    rows = rows.select("call_id", "s", F.posexplode(F.filter(F.arrays_zip("w", "p"), lambda x: x["p"].isNotNull())).alias("token_id", "x")).withColumn("g", F.get("s", F.col("x.p.i")))
    begin = F.coalesce("x.w.start", "g.start", F.lit(0.0))
    return rows.select(
        "call_id", F.col("x.w.seg_id").alias("seg_id"), F.col("x.w.word_idx").alias("word_idx"), "g.speaker", F.col("x.p.s").alias("char_start"), F.col("x.p.e").alias("char_end"),
        begin.alias("time_start"), F.coalesce("x.w.end", "g.end", begin).alias("time_end"), F.coalesce("x.w.confidence", F.lit(0.0)).alias("confidence"), "token_id",
    )


def _placed(segments: list[dict], words: list[dict]) -> list[dict | None]:
    """For each word of a call the number of its segment and its range in the call's text; both lists
    are in order, and words of no segment have no place."""
    by_segment: dict[int, list[str]] = {}
    for w in words:
        by_segment.setdefault(w["seg_id"], []).append(w["word"] or "")
    out, at = {}, 0
    for i, s in enumerate(segments):
        found = place_words(s["text"], by_segment.get(s["seg_id"], []))
        out[s["seg_id"]] = iter([None if p is None else {"i": i, "s": at + p[0], "e": at + p[1]} for p in found])
        at += len(s["text"]) + 1
    return [next(out[w["seg_id"]], None) if w["seg_id"] in out else None for w in words]


def attach_tokens(spans: DataFrame, tokens: DataFrame) -> DataFrame:
    """``spans`` with the words that they touch: ``token_ids, time_start, time_end,
    alignment_confidence, alignment_method, speakers``. A span without a word is ``unresolved``. No two
    spans agree in all columns."""
    s, t = spans.alias("s"), tokens.alias("t")
    touch = (F.col("s.call_id") == F.col("t.call_id")) & (F.col("t.char_start") < F.col("s.end")) & (F.col("s.start") < F.col("t.char_end"))
    named = F.when(F.col("t.speaker").isNotNull() & ~F.col("t.speaker").isin("", "UNKNOWN"), F.col("t.speaker"))
    # Grouped by whole spans behind one join by call, which leaves nothing to shuffle or join again.
    hits = (
        s.join(t, touch, "left")
        .groupBy(*[F.col(f"s.{c}").alias(c) for c in spans.columns])
        .agg(
            F.array_sort(F.collect_list("t.token_id")).alias("token_ids"),
            F.min("t.time_start").alias("time_start"),
            F.max("t.time_end").alias("time_end"),
            F.coalesce(F.round(F.avg("t.confidence"), 4), F.lit(0.0)).alias("alignment_confidence"),
            F.array_sort(F.collect_set(named)).alias("speakers"),
        )
    )
    return hits.withColumn("alignment_method", F.when(F.size("token_ids") == 0, "unresolved").otherwise("whisper_word_tokens"))


def assign_speakers(segments: DataFrame, turns: DataFrame) -> DataFrame:
    """``segments`` with the speaker of the turn that shares most seconds with each, of ties the
    first; none: UNKNOWN."""
    s, t = segments.drop("speaker").alias("s"), turns.alias("t")
    shared = F.least("s.end", "t.end") - F.greatest("s.start", "t.start")
    best = s.join(t, (F.col("s.call_id") == F.col("t.call_id")) & (shared > 0)).groupBy("s.call_id", "s.seg_id").agg(F.max_by("t.speaker", F.struct(shared, -F.col("t.turn_idx"))).alias("speaker"))
    return segments.drop("speaker").join(best, ["call_id", "seg_id"], "left").withColumn("speaker", F.coalesce("speaker", F.lit("UNKNOWN")))


def nearest_segment(spans: DataFrame, offsets: DataFrame) -> DataFrame:
    """``call_id, span_id, seg_id, distance``: the segment with the fewest characters between, 0
    inside, of ties the first."""
    s, g = spans.alias("s"), offsets.alias("g")
    end = F.greatest(F.col("s.end"), F.col("s.start") + 1)
    distance = F.when(end < F.col("g.char_start"), F.col("g.char_start") - end).when(F.col("s.start") > F.col("g.char_end"), F.col("s.start") - F.col("g.char_end")).otherwise(0)
    return s.join(g, F.col("s.call_id") == F.col("g.call_id")).groupBy("s.call_id", "s.span_id").agg(F.min_by("g.seg_id", F.struct(distance, "g.seg_id")).alias("seg_id"), F.min(distance).alias("distance"))


def audio_intervals(aligned: DataFrame) -> DataFrame:
    """``call_id, start, end, types, confidence, alignment_method, alignment_confidence``: the padded
    time of each aligned span; an unsure alignment gets a wider pad."""
    pad = F.lit(PAD) + F.when((F.col("alignment_confidence") > 0) & (F.col("alignment_confidence") < LOW_BELOW), LOW_PAD).otherwise(0.0)
    ok = F.col("time_start").isNotNull() & (F.col("time_end") >= F.col("time_start"))
    return aligned.where(ok).select(
        "call_id", F.greatest(F.lit(0.0), F.col("time_start") - pad).alias("start"), F.greatest("time_start", F.col("time_end") + pad).alias("end"),
        F.array("type").alias("types"), F.round("confidence", 4).alias("confidence"), "alignment_method", "alignment_confidence",
    )


def late_words(unresolved: DataFrame, offsets: DataFrame, words: DataFrame) -> DataFrame:
    """``call_id, span_id, seg_id, from, to, sure``: times of unresolved spans from the words of each
    segment that they touch, placed in the segment's text anew. For words that came after the spans
    were aligned."""
    ship(unresolved.sparkSession)

    @pandas_udf("array<struct<s:int,e:int>>")
    def place(texts: pd.Series, lists: pd.Series) -> pd.Series:
        return pd.Series([[None if p is None else {"s": p[0], "e": p[1]} for p in place_words(t or "", list(w))] for t, w in zip(texts, lists)])

    grouped = words.groupBy("call_id", "seg_id").agg(F.array_sort(F.collect_list(F.struct("word_idx", "word", "start", "end", "confidence"))).alias("w"))
    s, g = unresolved.alias("s"), offsets.join(grouped, ["call_id", "seg_id"]).alias("g")
    rows = s.join(g, (F.col("s.call_id") == F.col("g.call_id")) & (F.col("s.start") < F.col("g.char_end")) & (F.col("s.end") > F.col("g.char_start")))
    low, high = F.greatest(F.col("s.start") - F.col("g.char_start"), F.lit(0)), F.least(F.col("s.end"), F.col("g.char_end")) - F.col("g.char_start")
    rows = rows.select("s.call_id", "s.span_id", "g.seg_id", low.alias("low"), high.alias("high"), F.col("g.start").alias("seg_start"), F.col("g.end").alias("seg_end"), F.arrays_zip("w", place("text", F.transform("w", lambda x: F.coalesce(x["word"], F.lit("")))).alias("p")).alias("x"))
    hits = rows.select("*", F.explode("x").alias("y")).where("y.p is not null and y.p.s < high and low < y.p.e")
    begin = F.coalesce("y.w.start", "seg_start", F.lit(0.0))
    return hits.groupBy("call_id", "span_id", "seg_id").agg(F.min(begin).alias("from"), F.max(F.coalesce("y.w.end", "seg_end", begin)).alias("to"), F.avg(F.coalesce("y.w.confidence", F.lit(0.0))).alias("sure"))


def segment_confidence(segments: DataFrame, words: DataFrame) -> DataFrame:
    """``segments`` with ``confidence``: the mean of its words', else the exponential of
    ``avg_logprob``, between 0 and 1; four decimals. ``segments`` may have no avg_logprob: then null."""
    mean = words.groupBy("call_id", "seg_id").agg(F.avg(F.coalesce("confidence", F.lit(0.0))).alias("_mean"))
    spoken = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.exp("avg_logprob"))) if "avg_logprob" in segments.columns else F.lit(None).cast("double")
    return segments.drop("confidence").join(mean, ["call_id", "seg_id"], "left").withColumn("confidence", F.round(F.coalesce("_mean", spoken), 4)).drop("_mean")


def fallback_intervals(unresolved: DataFrame, offsets: DataFrame, words: DataFrame | None = None) -> DataFrame:
    """Intervals for spans without tokens: by the words of each segment they touch, if ``words`` has
    any there, else by their characters' share of it, with a wide pad, and for a span outside all
    segments a short guard in the nearest one, so that no accepted span stays audible."""
    late = None if words is None else late_words(unresolved, offsets, words)
    s, g = unresolved.alias("s"), offsets.alias("g")
    inside = s.join(g, (F.col("s.call_id") == F.col("g.call_id")) & (F.col("s.start") < F.col("g.char_end")) & (F.col("s.end") > F.col("g.char_start")))
    if late is not None:
        by_ratio = late.select(*[F.col(c).alias(f"_{c}") for c in ("call_id", "span_id", "seg_id")])
        inside = inside.join(by_ratio, (F.col("s.call_id") == F.col("_call_id")) & (F.col("s.span_id") == F.col("_span_id")) & (F.col("g.seg_id") == F.col("_seg_id")), "left_anti")
    length = F.greatest(F.col("g.char_end") - F.col("g.char_start"), F.lit(1))
    seconds = F.greatest(F.lit(0.0), F.col("g.end") - F.col("g.start"))
    at = lambda c: F.col("g.start") + seconds * c / length
    low = at(F.greatest(F.col("s.start") - F.col("g.char_start"), F.lit(0)))
    high = at(F.least(F.col("s.end") - F.col("g.char_start"), F.col("g.char_end") - F.col("g.char_start")))
    pad = PAD + RATIO_PAD
    fields = lambda start, end, method: [F.col("s.call_id").alias("call_id"), F.col("s.span_id").alias("span_id"), start.alias("start"), end.alias("end"), F.array("s.type").alias("types"), F.round("s.confidence", 4).alias("confidence"), F.lit(method).alias("alignment_method"), F.lit(0.0).alias("alignment_confidence")]
    ratio = inside.select(*fields(F.greatest(F.lit(0.0), low - pad), F.greatest(low, high + pad), "character_ratio_fallback"))
    if late is not None:
        own = late.join(unresolved.select("call_id", "span_id", "type", "confidence"), ["call_id", "span_id"])
        pad = PAD + LATE_PAD
        timed = [F.greatest(F.lit(0.0), F.col("from") - pad).alias("start"), F.greatest("from", F.col("to") + pad).alias("end")]
        ratio = ratio.unionByName(own.select("call_id", "span_id", *timed, F.array("type").alias("types"), F.round("confidence", 4).alias("confidence"), F.lit("late_word_alignment").alias("alignment_method"), F.round("sure", 4).alias("alignment_confidence")))
    near = nearest_segment(unresolved.join(ratio.select("call_id", "span_id").distinct(), ["call_id", "span_id"], "left_anti"), offsets).select("call_id", "span_id", "seg_id")
    lost = unresolved.join(near, ["call_id", "span_id"]).alias("s").join(offsets.alias("g"), (F.col("s.call_id") == F.col("g.call_id")) & (F.col("s.seg_id") == F.col("g.seg_id"))).where(seconds > 0)
    centre = at(F.least(F.greatest(F.col("s.start") - F.col("g.char_start"), F.lit(0)), F.col("g.char_end") - F.col("g.char_start")))
    half = F.least(F.lit(0.70), F.greatest(F.lit(0.28), seconds * 0.18))
    guard = lost.select(*fields(F.greatest(F.col("g.start"), centre - half - PAD - 0.10), F.least(F.col("g.end"), F.greatest(centre + half + PAD + 0.10, centre + 0.20)), "nearest_segment_guard"))
    return ratio.unionByName(guard).drop("span_id")


def merge_intervals(intervals: DataFrame, keys: list[str] = ["call_id"], gap: float = MERGE_GAP) -> DataFrame:  # noqa: B006
    """Intervals that overlap or leave at most ``gap`` seconds become one: the union of their types,
    the highest confidence, the lowest alignment confidence, and ``mixed`` for several methods. Equal
    intervals are peers of one island, so their order doesn't matter."""
    order = Window.partitionBy(*keys).orderBy("start", "end")
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    islands = intervals.withColumn("_new", F.coalesce((F.col("start") > reach + gap).cast("int"), F.lit(1))).withColumn("_island", F.sum("_new").over(order.rangeBetween(Window.unboundedPreceding, Window.currentRow)))
    merged = islands.groupBy(*keys, "_island").agg(
        F.min("start").alias("start"),
        F.max("end").alias("end"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("types")))).alias("types"),
        F.max("confidence").alias("confidence"),
        F.when(F.countDistinct("alignment_method") > 1, "mixed").otherwise(F.min("alignment_method")).alias("alignment_method"),
        F.min("alignment_confidence").alias("alignment_confidence"),
    )
    return merged.drop("_island")


# ---- corrections by timing ----

#: The least alignment confidence for a decision that makes a value audible, and limits of the pause.
SAFE_ALIGNMENT, GAP_LOW, GAP_HIGH = 0.68, -0.08, 2.2
PAUSE_MARK, PAUSE_SILENT, PAUSE_COMMA = 0.10, 0.42, 0.32


def timed_corrections(aligned: DataFrame, texts: DataFrame) -> DataFrame:
    """``aligned`` without the values that the speaker corrected after a pause, with ``corrected_by``
    (the method) on those that stay for them. Anything unsure keeps both values.

    Neighbours of a type are one window over (call, type); a value said again elsewhere as the
    speaker's own is found by a join on the value itself.
    """
    rows = aligned.join(texts, "call_id").withColumn("_norm", normal_value(F.col("type"), F.col("value")))
    order = Window.partitionBy("call_id", "type").orderBy("start", "end", "span_id")
    said = Window.partitionBy("call_id", "type", "_norm")
    strong = F.coalesce(F.col("ownership"), F.lit(0)) >= 3
    rows = rows.withColumn("_strong", F.sum(strong.cast("int")).over(said))
    next_ = lambda c: F.lead(c).over(order)
    rows = rows.withColumns({"_start": next_("start"), "_norm2": next_("_norm"), "_time": next_("time_start"), "_conf": next_("alignment_confidence"), "_tokens": next_("token_ids"), "_method": next_("alignment_method"), "_who": next_("speakers")})
    bridge = F.substring(F.col("text"), F.col("end") + 1, F.col("_start") - F.col("end"))
    rows = rows.withColumn("_bridge", bridge).withColumn("_gap", F.col("_time") - F.col("time_end"))
    b, gap = F.col("_bridge"), F.col("_gap")
    words = F.size(F.regexp_extract_all(b, F.lit("[A-Za-z]+"), F.lit(0)))
    episode = strong & F.col("type").isin(P.CORRECTABLE) & (F.col("_start") - F.col("end")).between(1, 72) & (F.col("_norm") != F.col("_norm2")) & ~says(b, P.REPAIR_NEW_FIELD) & ~says(b, P.REPAIR_PARALLEL) & ~says(b, P.REPAIR_LIST) & ((words <= 3) | says(b, P.REPAIR_FILLER))
    methods = ["whisper_word_tokens", "late_word_alignment", "mixed"]
    sure = lambda conf, tokens, method: (F.col(conf) >= SAFE_ALIGNMENT) & (F.size(tokens) > 0) & F.col(method).isin(methods)
    one_voice = (F.size("speakers") == 0) | (F.size("_who") == 0) | F.arrays_overlap("speakers", "_who")
    safe = sure("alignment_confidence", "token_ids", "alignment_method") & sure("_conf", "_tokens", "_method") & one_voice
    # said once as the speaker's own, here: elsewhere would be a second time
    alone = F.col("_strong") - strong.cast("int") == 0
    marked = (says(b, P.REPAIR_FILLER) & says(b, P.REPAIR_WORD)) | says(b, P.REPAIR_ELLIPSIS)
    signal = F.when(marked, F.when(gap >= PAUSE_MARK, "timed_punctuation_restart")).when((F.trim(b) == "") & (gap >= PAUSE_SILENT), "silent_restart").when(b.rlike(r"^\s*,?\s*$") & (gap >= PAUSE_COMMA), "pause_restart")
    rows = rows.withColumn("_by", F.when(episode & safe & alone & gap.between(GAP_LOW, GAP_HIGH), signal))
    rows = rows.withColumn("corrected_by", F.lag("_by").over(order)).where("_by is null")
    return rows.select(*aligned.columns, "corrected_by")


def rediscovered(spans: DataFrame, texts: DataFrame) -> DataFrame:
    """Proposals for values that follow an owned one without a context of their own, in the columns of
    ``spans``, with the id of the span that they follow: only for spans without a later one of their
    type within 72 characters. Add them to the spans, align all, let ``timed_corrections`` decide, and
    keep those with ``corrected_by``."""
    ship(spans.sparkSession)

    @pandas_udf("struct<start:int,end:int,value:string,confidence:double>")
    def propose(text: pd.Series, kind: pd.Series, start: pd.Series, end: pd.Series, value: pd.Series, own: pd.Series) -> pd.DataFrame:
        rows = []
        for t, k, s, e, v, o in zip(text, kind, start, end, value, own):
            y = engine.said_again(t or "", engine.Span(k, int(s), int(e), v, 1.0, "", ownership=int(o)))
            rows.append((y.start, y.end, y.value, y.confidence) if y else (None, None, None, None))
        return pd.DataFrame(rows, columns=["start", "end", "value", "confidence"]).astype({"start": "Int32", "end": "Int32"})

    order = Window.partitionBy("call_id", "type").orderBy("start", "end", "span_id")
    last = spans.withColumn("_next", F.lead("start").over(order)).where("(_next is null or _next > end + 72) and ownership >= 3").drop("_next")
    rows = last.join(texts, "call_id").withColumn("_p", propose("text", "type", "start", "end", "value", F.col("ownership").cast("int"))).where("_p.start is not null")
    made = {"start": F.col("_p.start"), "end": F.col("_p.end"), "value": F.col("_p.value"), "confidence": F.col("_p.confidence")}
    return rows.select(*[made.get(c, F.col(c)).alias(c) for c in spans.columns])


#: Where a span comes from: the detector, a value said again, or an edit of another's last digits.
FOUND, AGAIN, EDIT = "found", "again", "edit"


def correct_calls(spans: DataFrame, tokens: DataFrame, texts: DataFrame) -> DataFrame:
    """Spans after all timed corrections, with their ``origin``: accepted values first, then proposals
    that timing confirms (``corrected_by`` ends with ``_rediscovered``)."""
    both = spans.withColumn("origin", F.lit(FOUND)).unionByName(rediscovered(spans, texts).withColumn("origin", F.lit(AGAIN)))
    out = timed_corrections(attach_tokens(both, tokens), texts)
    new = F.col("origin") == AGAIN
    return out.where(~new | F.col("corrected_by").isNotNull()).withColumn("corrected_by", F.when(new, F.concat("corrected_by", F.lit("_rediscovered"))).otherwise(F.col("corrected_by")))


def suffix_corrections(spans: DataFrame, tokens: DataFrame, texts: DataFrame) -> DataFrame:
    """Edits of last digits: ``call_id, span_id`` (of the number), ``start, end, digits`` of the new
    digits, and ``expose_old``, whether timing and voices are sure enough to show the old number."""
    from sparkveil.operators import recovery

    ship(spans.sparkSession)

    @pandas_udf("array<struct<i:int,s:int,e:int,n:int>>")
    def edits(text: pd.Series, found: pd.Series) -> pd.Series:
        return pd.Series([[dict(zip("isen", x)) for x in recovery.suffix_edits(t or "", [(f["type"], f["start"], f["end"], f["value"], f["ownership"] or 0) for f in fs])] for t, fs in zip(text, found)])

    grouped = spans.groupBy("call_id").agg(F.array_sort(F.collect_list(F.struct("start", "end", "type", "value", "ownership", "span_id"))).alias("f"))
    rows = grouped.join(texts, "call_id").select("call_id", "f", F.explode(edits("text", "f")).alias("x"))
    rows = rows.select("call_id", F.get("f", F.col("x.i"))["span_id"].alias("span_id"), F.col("x.s").alias("start"), F.col("x.e").alias("end"), F.col("x.n").alias("digits"))
    said = Window.partitionBy("call_id", "type", normal_value(F.col("type"), F.col("value")))
    counted = spans.withColumn("_times", F.sum((F.col("ownership") >= 3).cast("int")).over(said))
    old = attach_tokens(counted.join(rows.select("call_id", "span_id"), ["call_id", "span_id"], "left_semi"), tokens)
    new = attach_tokens(rows, tokens)
    sure = lambda d: (F.col(f"{d}.alignment_confidence") >= SAFE_ALIGNMENT) & (F.size(f"{d}.token_ids") > 0)
    voices = (F.size("o.speakers") == 0) | (F.size("n.speakers") == 0) | F.arrays_overlap("o.speakers", "n.speakers")
    out = new.alias("n").join(old.alias("o"), (F.col("n.call_id") == F.col("o.call_id")) & (F.col("n.span_id") == F.col("o.span_id")))
    return out.select(F.col("n.call_id").alias("call_id"), F.col("n.span_id").alias("span_id"), F.col("n.start").alias("start"), F.col("n.end").alias("end"), "digits", (sure("o") & sure("n") & voices & (F.col("o._times") == 1)).alias("expose_old"))
