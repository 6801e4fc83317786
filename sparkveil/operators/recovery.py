"""Recovery of sensitive values that recognition lost: which windows of a call to decode again, what
to do when that fails, and edits of a value's last digits.

Planning reads a call's text and accepted spans once in an Arrow batch; timing, ranking and telemetry
are joins, windows and aggregations. Decoding again is a provider's work, whose texts and words come as
a table; without them every window becomes a conservative guard. A value that the speaker corrects
after such a guard is hidden where the correction is heard.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from sparkveil.functions import engine as E
from sparkveil.functions import patterns as P
from sparkveil.functions.engine import rx, says
from sparkveil.operators import timeline
from sparkveil.session import by_key, ship

WINDOW_PAD, WINDOW_EXTRA, MAX_WINDOWS, GUARD_CONFIDENCE = 0.20, 0.7, 4, 0.72
#: A second decoding's and a later correction's time is padded by so many seconds before and behind.
HEARD_PAD, HEARD_END, CORRECTION_CONFIDENCE, CORRECTION_ALIGNMENT = 0.10, 0.12, 0.90, 0.55


def owned_starts(text: str, start: int, end: int) -> list[tuple[str, int]]:
    """(type, place of the value) of each owned label in a part of a text, in order of the labels."""
    found = []
    for kind, pattern in P.OWNED_START:
        for m in rx(pattern).finditer(text[start:end]):
            label = start + m.start()
            if kind != "CARD" or not says(text[max(start, label - 36) : label], P.CARD_CVV_BEFORE):
                found.append((label, kind, start + m.end()))
    return [(kind, value) for _, kind, value in sorted(found, key=lambda x: x[0])]


def value_end(text: str, start: int, end: int) -> int:
    """Where an owned value must end: the next field, a documentation clause or the sentence's end."""
    for pattern in (P.RECOVERY_NEXT, P.RAW_HARD_STOP):
        if m := rx(pattern).search(text, start, end):
            end = min(end, m.start())
    return max(start, end)


def plan(text: str, accepted: list[tuple[str, int, int]]) -> list[tuple[str, int, int, str, str]]:
    """(type, start, end, reason, source) of the parts of a text that should hold a value and don't.

    A question may be answered in the next sentence without a value that was understood, and an owned
    label may be followed by none.
    """
    has = lambda kind, s, e: any(k == kind and a < e and s < b for k, a, b in accepted)
    sentences, out = E.Reader(text).sentences(), []

    def add(kind: str, s: int, e: int, reason: str, source: str) -> None:
        if e <= s:
            return
        same = next((i for i, p in enumerate(out) if p[0] == kind and s < p[2] and p[1] < e), None)
        if same is None:
            out.append((kind, s, e, reason, source))
        elif e - s > out[same][2] - out[same][1]:
            out[same] = (kind, s, e, reason, source)

    for (a, b), (s, e) in zip(sentences, sentences[1:]):
        kind = E.asked_type(text[a:b])
        if not kind or has(kind, a, b) or any(k == kind for k, _ in owned_starts(text, a, b)):
            continue
        stop = value_end(text, s, e)
        if says(text[s:e], P.RECOVERY_ANSWER) and not says(text[s:e], P.NO_VALUE) and not has(kind, s, stop):
            add(kind, s, stop, "one_shot_expected_field_missing", "followup_expectation")
    for kind, s in owned_starts(text, 0, len(text)):
        i = next((i for i, (a, b) in enumerate(sentences) if a <= s <= b), None)
        if i is None:
            continue
        e, reason = value_end(text, s, sentences[i][1]), "owned_field_unresolved_primary_asr"
        if says(text[s:e], P.NO_VALUE) or has(kind, s, e):
            continue
        if kind in P.SPELLED_KINDS and i + 1 < len(sentences):
            a, b = sentences[i + 1]
            if says(text[a:b], P.SPELLING_GOES_ON) and not rx(P.RECOVERY_NEXT).match(text[a:b]):
                e, reason = max(e, value_end(text, a, b)), "owned_field_cross_punctuation_unresolved"
        add(kind, s, e, reason, "owned_field")
    return out


def _times(places: DataFrame, tokens: DataFrame, offsets: DataFrame | None, keys: list[str]) -> DataFrame:
    """``call_id`` and ``keys`` of ``places`` (s and e among them) with ``a, b, alignment_confidence``:
    the times of the words that each touches, or else of the first segment; those without either are
    left out."""
    words = tokens.select("call_id", "char_start", "char_end", F.lit(None).cast("int").alias("seg"), F.col("time_start").alias("from"), F.col("time_end").alias("to"), "confidence")
    if offsets is not None:
        sure = F.col("confidence") if "confidence" in offsets.columns else F.lit(0.0)
        words = words.unionByName(offsets.select("call_id", "char_start", "char_end", F.col("seg_id").cast("int").alias("seg"), F.coalesce("start", F.lit(0.0)).alias("from"), F.coalesce("end", "start", F.lit(0.0)).alias("to"), F.coalesce(sure, F.lit(0.0)).alias("confidence")))
    p, w = places.alias("p"), words.alias("w")
    touch = (F.col("p.call_id") == F.col("w.call_id")) & (F.col("w.char_start") < F.col("p.e")) & (F.col("p.s") < F.col("w.char_end"))
    word = lambda c: F.when(F.col("w.seg").isNull(), F.col(c))
    hits = p.join(w, touch).groupBy(*[F.col(f"p.{c}").alias(c) for c in ("call_id", *keys)]).agg(
        F.min(word("w.from")).alias("a"), F.max(word("w.to")).alias("b"), F.avg(word("w.confidence")).alias("sure"),
        F.min_by(F.struct("w.from", "w.to", "w.confidence"), "w.seg").alias("segment"),
    )
    part = lambda own, field: F.coalesce(F.col(own), F.col(f"segment.{field}"))
    return hits.select("call_id", *keys, part("a", "from").alias("a"), part("b", "to").alias("b"), F.round(part("sure", "confidence"), 4).alias("alignment_confidence"))


def plan_recovery(texts: DataFrame, accepted: DataFrame, tokens: DataFrame, most: int = MAX_WINDOWS, offsets: DataFrame | None = None) -> DataFrame:
    """``call_id, type, char_start, char_end, time_start, time_end, alignment_confidence, reason,
    source, longest, rank``: at most ``most`` windows of a call, the riskiest and shortest first. A
    part of the text without a word is timed by its segment, from ``offsets``."""
    ship(texts.sparkSession)

    @pandas_udf("array<struct<type:string,s:int,e:int,reason:string,source:string>>")
    def plans(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for text, spans in batches:
            yield pd.Series([[dict(zip(("type", "s", "e", "reason", "source"), p)) for p in plan(t or "", [(x["type"], x["start"], x["end"]) for x in a])] for t, a in zip(text, spans)])

    rows = _with_accepted(by_key(texts, "call_id"), accepted)
    places = rows.select("call_id", F.posexplode(plans("text", "spans")).alias("i", "p")).select("call_id", "i", "p.*")
    # A call has few places, and a word or segment few of them, so the join is no larger than the text.
    timed = _times(places.select("call_id", "i", "s", "e", "type", "reason", "source"), tokens, offsets, ["i", "s", "e", "type", "reason", "source"])
    longest = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for pair in P.MAX_UNCERTAIN_S.items() for x in pair]), F.col("type")), F.lit(3.0))
    risk = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for pair in P.RECOVERY_RISK.items() for x in pair]), F.col("type")), F.lit(9))
    stop = F.least("b", F.col("a") + longest + WINDOW_EXTRA)
    timed = timed.select("call_id", "i", "type", F.col("s").alias("char_start"), F.col("e").alias("char_end"), F.greatest(F.lit(0.0), F.col("a") - WINDOW_PAD).alias("time_start"), F.greatest(F.col("a"), stop + WINDOW_PAD).alias("time_end"), "alignment_confidence", "reason", "source", risk.alias("risk"), longest.alias("longest"))
    order = Window.partitionBy("call_id").orderBy("risk", F.col("time_end") - F.col("time_start"), "time_start", "i")
    return timed.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most).drop("i", "risk")


def _with_accepted(texts: DataFrame, accepted: DataFrame) -> DataFrame:
    """``texts`` with ``spans``, an array of the call's accepted (type, start, end)."""
    kind = "array<struct<type:string,start:int,end:int>>"
    spans = accepted.groupBy("call_id").agg(F.array_sort(F.collect_list(F.struct("type", "start", "end"))).cast(kind).alias("spans"))
    return texts.join(spans, "call_id", "left").withColumn("spans", F.coalesce("spans", F.array().cast(kind)))


def guard_intervals(windows: DataFrame) -> DataFrame:
    """Audio intervals for windows that no second decoding confirmed: from the window's start, as long
    as a value of the type may be."""
    end = F.least("time_end", F.col("time_start") + F.col("longest"))
    return windows.select("call_id", F.col("time_start").alias("start"), end.alias("end"), F.array("type").alias("types"), F.lit(GUARD_CONFIDENCE).alias("confidence"), F.lit("conservative_guard").alias("alignment_method"), "alignment_confidence")


def telemetry(audit: DataFrame) -> DataFrame:
    """Windows planned, confirmed, guarded and left unresolved, by type and in all (type null). What
    was guarded as a later correction is among the guarded ones and counted in ``corrections``."""
    later = F.col("source") == "correction_continuation" if "source" in audit.columns else F.lit(False)
    count = lambda c: F.sum(c.cast("long"))
    status = lambda s: count(F.col("status") == s).alias(s)
    return audit.rollup("type").agg(count(~later).alias("planned"), status("confirmed"), status("guarded"), status("unresolved"), count(later).alias("corrections"))


def edited_digits(m: re.Match) -> int | None:
    """How many digits an edit of a value's end replaces, if it says as many as it announces."""
    new = re.sub(r"\D", "", m[2]) or "".join(P.DIGIT_WORDS[w] for w in re.findall("[a-z]+", m[2].casefold()))
    told = m[1].casefold() if m[1] else None
    count = (int(told) if told.isdigit() else P.SUFFIX_COUNT[told]) if told else (1 if len(new) == 1 else None)
    return count if count == len(new) and count <= 4 else None


def suffix_edits(text: str, spans: list[tuple[str, int, int, str, int]]) -> list[tuple[int, int, int, int]]:
    """(index of the span, start, end, digits) of edits like ``last two digits are 42`` that follow an
    owned number. The new digits are always hidden; the whole new value is never put together."""
    out = []
    for i, (kind, _, end, value, ownership) in enumerate(spans):
        number = E.normal_value(kind, value)
        if kind not in P.SUFFIX_KINDS or ownership < 3 or not number.isdigit():
            continue
        tail = text[end : end + 150]
        if m := rx(P.REPAIR_NEW_FIELD).search(tail):
            tail = tail[: m.start()]
        m = None if says(tail, P.SUFFIX_VETO) else rx(P.SUFFIX_EDIT).search(tail)
        if not m:
            continue
        before = tail[: m.start()]
        if len(re.findall("[A-Za-z]+", before)) > 6 or says(before, P.REPAIR_PARALLEL) or says(before, P.REPAIR_LIST):
            continue
        count = edited_digits(m)
        if count and count <= len(number):
            out.append((i, end + m.start(2), end + m.end(2), count))
    return out


def _repaired(text: str, kind: str, start: int, accepted: list[tuple[str, int, int]]) -> tuple[int, int] | None:
    """The value of a type that directly follows the words of a repair."""
    prefix = P.OWNER_SAYS.get(kind)
    tail = text[start : start + 72]
    if m := rx(P.RECOVERY_NEXT).search(tail):
        tail = tail[: m.start()]
    if prefix is None or says(tail, P.GUARD_BLOCK):
        return None
    lead = rx(P.REPAIR_LEAD).match(tail).end()
    body = tail[lead:]
    found = [x for x in E.detect(prefix + body, P.PROFILES["high_recall"]) if x.type == kind] if body else []
    if not found:
        return None
    s, e = (start + lead + max(0, p - len(prefix)) for p in (found[0].start, found[0].end))
    bridge = text[start:s]
    if e <= s or any(k == kind and a < e and s < b for k, a, b in accepted):
        return None
    if len(re.findall("[A-Za-z]+", bridge)) > 3 or says(bridge, P.GUARD_BLOCK) or says(bridge, P.RECOVERY_NEXT):
        return None
    return s, e


def later_values(text: str, guards: list[tuple[str, int]], accepted: list[tuple[str, int, int]]) -> list[tuple[int, int, int, int, str]]:
    """(index of the guard, rank, start, end, method) of what corrects a value whose audio is hidden,
    (type, end): an edit of its last digits, and a whole value after the words of a repair. The first
    whose time is known counts."""
    out = []
    for i, (kind, end) in enumerate(guards):
        if not 0 < end < len(text):
            continue
        tail = text[end : end + 180]
        m = rx(P.SUFFIX_EDIT).search(tail) if kind in P.SUFFIX_KINDS and not says(tail, P.GUARD_BLOCK) else None
        if m and edited_digits(m):
            out.append((i, 0, end + m.start(2), end + m.end(2), "post_guard_partial_correction_alignment"))
        m = rx(P.GUARD_REPAIR).search(tail)
        if m and not says(tail[: m.start()], P.RECOVERY_NEXT) and not says(tail[: m.start()], P.GUARD_BLOCK):
            if found := _repaired(text, kind, end + m.end(), accepted):
                out.append((i, 1, *found, "post_guard_correction_primary_alignment"))
    return out


def corrections_after_guards(guarded: DataFrame, texts: DataFrame, accepted: DataFrame, tokens: DataFrame, offsets: DataFrame | None = None) -> DataFrame:
    """What speakers correct after ``guarded`` windows (call_id, rank, type, char_end), in the columns
    of windows and with ``alignment_method``: parts of the text whose audio is hidden, too, if their
    time is sure enough."""
    ship(texts.sparkSession)

    @pandas_udf("array<struct<i:int,first:int,s:int,e:int,method:string>>")
    def found(text: pd.Series, guards: pd.Series, spans: pd.Series) -> pd.Series:
        return pd.Series([[dict(zip(("i", "first", "s", "e", "method"), x)) for x in later_values(t or "", [(g["type"], g["char_end"]) for g in gs], [(x["type"], x["start"], x["end"]) for x in a])] for t, gs, a in zip(text, guards, spans)])

    grouped = guarded.groupBy("call_id").agg(F.array_sort(F.collect_list(F.struct("rank", "type", "char_end"))).alias("g"))
    rows = _with_accepted(texts.join(grouped, "call_id"), accepted)
    places = rows.select("call_id", "g", F.explode(found("text", "g", "spans")).alias("x"))
    places = places.select("call_id", F.get("g", F.col("x.i"))["rank"].alias("rank"), F.get("g", F.col("x.i"))["type"].alias("type"), "x.first", "x.s", "x.e", "x.method")
    timed = _times(places, tokens, offsets, ["rank", "type", "first", "s", "e", "method"]).where(F.col("alignment_confidence") >= CORRECTION_ALIGNMENT)
    timed = timed.withColumn("_n", F.row_number().over(Window.partitionBy("call_id", "rank").orderBy("first", "s"))).where("_n = 1")
    return timed.select(
        "call_id", "rank", "type", F.col("s").alias("char_start"), F.col("e").alias("char_end"), F.greatest(F.lit(0.0), F.col("a") - HEARD_PAD).alias("time_start"), F.greatest("a", F.col("b") + HEARD_END).alias("time_end"),
        "alignment_confidence", F.lit("validated_value_after_guarded_self_repair").alias("reason"), F.lit("correction_continuation").alias("source"), F.col("method").alias("alignment_method"),
    )


def confirm(kind: str, heard: str, words: list[dict]) -> tuple[float, float, float, float] | None:
    """(start, end, alignment, confidence) of a value of a type in a second decoding, from its words'
    times. The text is read as if its owner had begun to say the value."""
    heard, prefix = heard.strip(), P.OWNER_SAYS.get(kind, f"My {kind} is ")
    found = [x for x in E.detect(prefix + heard, P.PROFILES["high_recall"]) if x.type == kind] if heard else []
    if not found:
        return None
    x = max(found, key=lambda x: (x.ownership or 0, x.confidence, x.end - x.start))
    s = max(0, x.start - len(prefix))
    e = max(s, x.end - len(prefix))
    places = timeline.place_words(heard, [w["word"] for w in words])
    hits = [w for w, p in zip(words, places) if p and p[0] < e and s < p[1]]
    if not hits:
        return None
    return min(w["start"] for w in hits), max(w["end"] for w in hits), sum(w["confidence"] or 0.0 for w in hits) / len(hits), x.confidence


def recover(windows: DataFrame, heard: DataFrame | None, guard: bool = True, after: tuple[DataFrame, DataFrame, DataFrame, DataFrame | None] | None = None) -> tuple[DataFrame, DataFrame]:
    """(intervals, audit) of windows that a provider decoded again. ``heard`` has call_id, rank, text
    and words (array of structs word, start, end, confidence; times of the call), or is None where
    there is no second decoding. A window whose value is confirmed hides that value's time; any other
    is guarded from its start, or left open if ``guard`` is off. With ``after`` (texts, accepted spans,
    tokens, segment offsets) what corrects a guarded value is hidden and in the audit as well. Neither
    table holds a value."""
    ship(windows.sparkSession)

    @pandas_udf("struct<start:double,end:double,aligned:double,confidence:double>")
    def confirmed(kind: pd.Series, text: pd.Series, words: pd.Series) -> pd.DataFrame:
        found = [confirm(k, t, list(w)) if isinstance(t, str) and w is not None else None for k, t, w in zip(kind, text, words)]
        return pd.DataFrame([f or (None, None, None, None) for f in found], columns=["start", "end", "aligned", "confidence"]).astype(float)

    if heard is None:
        rows = windows.withColumn("_c", F.lit(None).cast("struct<start:double,end:double,aligned:double,confidence:double>"))
    else:
        rows = windows.join(heard.select("call_id", "rank", "text", "words"), ["call_id", "rank"], "left").withColumn("_c", confirmed("type", "text", "words"))
    sure = F.col("_c.start").isNotNull()
    rows = rows.withColumn("status", F.when(sure, "confirmed").otherwise("guarded" if guard else "unresolved"))
    end = F.greatest("time_start", F.least("time_end", F.col("time_start") + F.col("longest")))
    intervals = rows.where("status != 'unresolved'").select(
        "call_id", F.when(sure, F.greatest(F.lit(0.0), F.col("_c.start") - HEARD_PAD)).otherwise(F.col("time_start")).alias("start"), F.when(sure, F.col("_c.end") + HEARD_END).otherwise(end).alias("end"),
        F.array("type").alias("types"), F.when(sure, F.round("_c.confidence", 4)).otherwise(GUARD_CONFIDENCE).alias("confidence"),
        F.when(sure, "privacy_recovery").otherwise("conservative_guard").alias("alignment_method"), F.when(sure, F.round("_c.aligned", 4)).otherwise(F.col("alignment_confidence")).alias("alignment_confidence"),
    )
    audit = rows.select("call_id", "rank", "type", "char_start", "char_end", "reason", "source", "status")
    if after is None or not guard:
        return intervals, audit
    later = corrections_after_guards(audit.where("status = 'guarded'"), *after)
    intervals = intervals.unionByName(later.select("call_id", F.col("time_start").alias("start"), F.col("time_end").alias("end"), F.array("type").alias("types"), F.lit(CORRECTION_CONFIDENCE).alias("confidence"), "alignment_method", "alignment_confidence"))
    return intervals, audit.unionByName(later.withColumn("status", F.lit("guarded")).select(*audit.columns))
