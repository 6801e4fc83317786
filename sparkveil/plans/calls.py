"""Queries over timed calls, evaluation reports, facts and sources, each with what must come out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from sparkveil.operators import evaluation, privacy, providers, recovery, timeline, understanding
from sparkveil.plans import analyze
from sparkveil.plans import transcripts as T
from sparkveil.plans.register import query
from sparkveil.plans.sentences import FIELDS, made, said
from sparkveil.session import drop_path, materialize, shared_path, ship, spread, table
from sparkveil.sources import audio, cases

#: Added before rounding, so that no made value lies half way between two results.
_OFF = 1.234e-5
_r4 = lambda c: F.round(c + _OFF, 4)
_r4_sql = lambda c: f"round({c} + {_OFF}, 4)"


def _texts_sql(texts: list[str]) -> str:
    return f"CASE c_custkey % {len(texts)} " + " ".join(f"WHEN {i} THEN {made(t)}" for i, t in enumerate(texts)) + " END"


def _calls(spark: SparkSession, sf_dir: str, text: str, confidence: str = "0.95", pause_at: int = 1000, pause: str = "0.0") -> tuple[DataFrame, DataFrame]:
    """One segment of a minute for each customer, and its words: each lasts 0.22 s and follows the one
    before after 0.05 s, the one at ``pause_at`` after ``pause`` (SQL over the key) more."""
    segs = said(spark, sf_dir, text).select("call_id", F.lit(0).alias("seg_id"), F.lit(0.0).alias("start"), F.lit(60.0).alias("end"), "text", F.lit("A").alias("speaker"))
    words = segs.select("call_id", F.col("call_id").alias("c_custkey"), "seg_id", F.posexplode(F.split("text", " ")).alias("word_idx", "word"))
    begin = F.col("word_idx") * 0.27 + F.when(F.col("word_idx") >= pause_at, F.expr(f"cast({pause} as double)")).otherwise(0.0)
    return segs, words.select("call_id", "seg_id", "word_idx", "word", begin.alias("start"), (begin + 0.22).alias("end"), F.expr(f"cast({confidence} as double)").alias("confidence"))


def _spans(texts: DataFrame) -> DataFrame:
    found = privacy.detect(texts).select("call_id", F.posexplode("pii").alias("span_id", "s"))
    return found.select("call_id", "span_id", "s.type", "s.start", "s.end", "s.value", "s.confidence", "s.ownership")


# ---- recovery: windows, second decodings, guards and what is corrected after them ----

#: What recognition lost, and the one window that each text must give: type, source, times of its first
#: and last word, and the place of a later correction's word.
_LOST = [
    "Please tell me your CVV. Mine ID, hello.",
    "My registered name is 2210.",
    "My OTP is blah. I made a mistake. 124981.",
    "My phone number is garbled. Last digit is 1.",
    "My phone number is {phone}.",
    "My PAN is hotel delta. Foxtrot nine.",
    "My registered name is 2211.",  # a call without words
]
_PLANNED = [(0, "CVV", "followup_expectation", 5, 7, 1.4), (1, "NAME", "owned_field", 4, 4, 2.5), (2, "OTP", "owned_field", 3, 3, 1.8), (3, "PHONE", "owned_field", 4, 4, 2.8), (5, "PAN", "owned_field", 3, 6, 2.4)]
_CORRECTED = [(2, "OTP", 8), (3, "PHONE", 8)]
_N = len(_LOST)


def _lost(spark: SparkSession, sf_dir: str):
    """texts, accepted spans, tokens, segment offsets and second decodings; the latter hold the CVV of
    every other call, and a refusal for as many names."""
    segs, words = _calls(spark, sf_dir, _texts_sql(_LOST))
    words = words.where(F.col("call_id") % _N != 6)
    texts, offsets, tokens = timeline.call_text(segs), timeline.segment_offsets(segs), materialize(timeline.word_map(segs, words), "lost-tokens")
    heard = segs.where((F.col("call_id") % (2 * _N)).isin(0, 1)).select("call_id", F.lit(1).alias("rank"), F.when(F.col("call_id") % _N == 0, "it is 391").otherwise("not available").alias("text"), F.expr("array(named_struct('word', 'it', 'start', 1.5D, 'end', 1.6D, 'confidence', 0.9D), named_struct('word', 'is', 'start', 1.6D, 'end', 1.7D, 'confidence', 0.9D), named_struct('word', '391', 'start', 1.7D, 'end', 2.0D, 'confidence', 0.8D))").alias("words"))
    return texts, materialize(_spans(texts), "lost-spans"), tokens, offsets, heard


def _window_sql(case: int, kind: str, source: str, first: int, last: int, longest: float) -> str:
    a, b = first * 0.27, last * 0.27 + 0.22
    low, high = max(0.0, a - 0.2), max(a, min(b, a + longest + 0.7) + 0.2)
    return f"SELECT c_custkey AS call_id, '{kind}' AS type, '{source}' AS source, {low!r}::DOUBLE AS low, {high!r}::DOUBLE AS high, {longest}::DOUBLE AS longest, 0.95::DOUBLE AS sure FROM customer WHERE c_custkey % {_N} = {case}"


_WINDOWS_SQL = "\nUNION ALL ".join([_window_sql(*p) for p in _PLANNED] + [f"SELECT c_custkey, 'NAME', 'owned_field', 0.0::DOUBLE, 3.4::DOUBLE, 2.5::DOUBLE, 0.0::DOUBLE FROM customer WHERE c_custkey % {_N} = 6"])
_CONFIRMED_SQL = f"(type = 'CVV' AND call_id % {2 * _N} = 0)"
_LATER_SQL = "\nUNION ALL ".join(f"SELECT c_custkey AS call_id, '{kind}' AS type, {at * 0.27 - 0.10!r}::DOUBLE AS low, {at * 0.27 + 0.22 + 0.12!r}::DOUBLE AS high FROM customer WHERE c_custkey % {_N} = {case}" for case, kind, at in _CORRECTED)


@query(f"""WITH w AS ({_WINDOWS_SQL}) SELECT call_id, type, source, {_r4_sql('low')} AS time_start, {_r4_sql('high')} AS time_end, sure AS alignment_confidence FROM w""")
def recovery_times(spark, sf_dir):
    """Windows and their times, by words, and by the segment in calls without words."""
    texts, accepted, tokens, offsets, _ = _lost(spark, sf_dir)
    windows = recovery.plan_recovery(texts, accepted, tokens, offsets=offsets)
    return windows.select("call_id", "type", "source", _r4(F.col("time_start")).alias("time_start"), _r4(F.col("time_end")).alias("time_end"), "alignment_confidence")


@query(f"""WITH w AS ({_WINDOWS_SQL}), l AS ({_LATER_SQL})
SELECT call_id, type, {_r4_sql('CASE WHEN ' + _CONFIRMED_SQL + ' THEN 1.6 ELSE low END')} AS start, {_r4_sql('CASE WHEN ' + _CONFIRMED_SQL + ' THEN 2.12 ELSE least(high, low + longest) END')} AS stop,
  CASE WHEN {_CONFIRMED_SQL} THEN 'privacy_recovery' ELSE 'conservative_guard' END AS method, CASE WHEN {_CONFIRMED_SQL} THEN 0.97 ELSE 0.72 END::DOUBLE AS confidence FROM w
UNION ALL SELECT call_id, type, {_r4_sql('low')}, {_r4_sql('high')}, CASE type WHEN 'PHONE' THEN 'post_guard_partial_correction_alignment' ELSE 'post_guard_correction_primary_alignment' END, 0.9 FROM l""")
def recovery_intervals(spark, sf_dir):
    """Audio to hide: confirmed values, guards from the windows' starts, and corrections after guards."""
    texts, accepted, tokens, offsets, heard = _lost(spark, sf_dir)
    windows = recovery.plan_recovery(texts, accepted, tokens, offsets=offsets)
    hidden, _ = recovery.recover(windows, heard, True, (texts, accepted, tokens, offsets))
    return hidden.select("call_id", F.get("types", F.lit(0)).alias("type"), _r4(F.col("start")).alias("start"), _r4(F.col("end")).alias("stop"), F.col("alignment_method").alias("method"), "confidence")


@query(f"""WITH w AS ({_WINDOWS_SQL}), l AS ({_LATER_SQL}), a AS (SELECT type, {_CONFIRMED_SQL} AS sure, false AS later FROM w UNION ALL SELECT type, false, true FROM l)
SELECT type, count(*) FILTER (NOT later)::BIGINT AS planned, count(*) FILTER (sure)::BIGINT AS confirmed, count(*) FILTER (NOT sure)::BIGINT AS guarded, 0::BIGINT AS unresolved, count(*) FILTER (later)::BIGINT AS corrections FROM a GROUP BY ROLLUP (type)""")
def recovery_report(spark, sf_dir):
    """Windows planned, confirmed and guarded, and values corrected after a guard."""
    texts, accepted, tokens, offsets, heard = _lost(spark, sf_dir)
    windows = recovery.plan_recovery(texts, accepted, tokens, offsets=offsets)
    return recovery.telemetry(recovery.recover(windows, heard, True, (texts, accepted, tokens, offsets))[1])


_GUARDED = [
    "'Please tell me your CVV.Mine is [CVV AUDIO PROTECTED].'",
    "'My registered name is [NAME AUDIO PROTECTED]'",
    "'My OTP is [OTP AUDIO PROTECTED] I made a mistake. [OTP AUDIO PROTECTED].'",
    "'My phone number is [PHONE AUDIO PROTECTED] Last digit is [PHONE AUDIO PROTECTED].'",
    "'My phone number is [PHONE REDACTED].'",
    "'My PAN is [PAN AUDIO PROTECTED]'",
    "'My registered name is [NAME AUDIO PROTECTED]'",
]


@query(f"SELECT c_custkey AS call_id, CASE c_custkey % {_N} " + " ".join(f"WHEN {i} THEN {t}" for i, t in enumerate(_GUARDED)) + " END AS safe_text FROM customer")
def guarded_transcripts(spark, sf_dir):
    """Safe texts of whole call analyses, with markers where only the audio is hidden."""
    segs, words = _calls(spark, sf_dir, _texts_sql(_LOST))
    return analyze.analyze_calls(segs, words.where(F.col("call_id") % _N != 6))["segments"].select("call_id", "safe_text")


# ---- corrections ----

_EDITS = ["My phone number is {phone}. Last two digits are 42.", "My phone number is {phone}. Last two digits are 42.", "My phone number is {phone}. Last three digits are 42.", "My phone number is {phone}. In the sample the last two digits are 42.", "My OTP is {d6}. The last digit is nine."]


@query(f"""SELECT c_custkey AS call_id, CASE WHEN c_custkey % 5 = 4 THEN 1 ELSE 2 END::INT AS digits, CASE WHEN c_custkey % 5 = 4 THEN 36 ELSE 51 END::INT AS start, c_custkey % 5 != 1 AS expose_old FROM customer WHERE c_custkey % 5 IN (0, 1, 4)""")
def suffix_corrections(spark, sf_dir):
    """Edits of a number's last digits; on a bad line the old number stays hidden, too."""
    segs, words = _calls(spark, sf_dir, _texts_sql(_EDITS), "CASE WHEN c_custkey % 5 = 1 THEN 0.4 ELSE 0.95 END")
    texts = timeline.call_text(segs)
    edits = timeline.suffix_corrections(materialize(_spans(texts), "edit-spans"), timeline.word_map(segs, words), texts)
    return edits.select("call_id", "digits", "start", "expose_old")


@query(f"""SELECT c_custkey AS call_id, CASE WHEN c_custkey % 3 = 0 THEN '638292' ELSE {FIELDS['d6']} END AS value, CASE WHEN c_custkey % 3 = 0 THEN 'timed_punctuation_restart_rediscovered' END AS corrected_by, CASE WHEN c_custkey % 3 = 0 THEN 'again' ELSE 'found' END AS origin FROM customer""")
def rediscovered_values(spark, sf_dir):
    """A value that punctuation cut off from its label corrects the one before, if the pause is long
    enough and the line clear."""
    segs, words = _calls(spark, sf_dir, made("My OTP is {d6}... 638292."), "CASE WHEN c_custkey % 3 = 2 THEN 0.4 ELSE 0.95 END", 4, "CASE WHEN c_custkey % 3 = 1 THEN 0.0 ELSE 0.6 END")
    texts = timeline.call_text(segs)
    return timeline.correct_calls(materialize(_spans(texts), "said-spans"), timeline.word_map(segs, words), texts).select("call_id", "value", "corrected_by", "origin")


@query(f"""WITH c AS (SELECT c_custkey AS call_id, {T.PHONE} AS a, {T.OTHER} AS b FROM customer)
SELECT call_id, b AS value, CASE WHEN call_id % 2 = 1 THEN 'silent_restart' END AS corrected_by FROM c UNION ALL SELECT call_id, a, NULL FROM c WHERE call_id % 2 = 0 UNION ALL SELECT call_id, a, NULL FROM c WHERE call_id % 2 = 0""")
def reused_values(spark, sf_dir):
    """A number that is the speaker's own elsewhere, too, is not taken for a mistake."""
    twice = ["My phone number is {phone} {other}. My phone number is {phone}.", "My phone number is {phone} {other}."]
    segs, words = _calls(spark, sf_dir, _texts_sql(twice), pause_at=5, pause="0.6")
    texts = timeline.call_text(segs)
    aligned = timeline.attach_tokens(materialize(_spans(texts), "reused-spans"), timeline.word_map(segs, words))
    return timeline.timed_corrections(aligned, texts).select("call_id", "value", "corrected_by")


# ---- words, segments and intervals ----

_SEGS_SQL = f"""g AS ({T.SEGMENTS_SQL}), l AS (SELECT *, coalesce(sum(length(text) + 1) OVER (PARTITION BY call_id ORDER BY seg_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off, string_split(text, ' ') AS ws FROM g),
u AS (SELECT *, unnest(generate_series(1, len(ws))) AS i FROM l),
w AS (SELECT call_id, seg_id, off, i - 1 AS idx, off + i - 1 + coalesce(list_sum(list_transform(ws[1:i-1], lambda x: length(x))), 0) AS a, length(ws[i]) AS n, start + (i - 1) * 0.25 AS t FROM u WHERE ws[i] != '')"""


@query(f"""WITH {_SEGS_SQL}, m AS (SELECT call_id, seg_id, avg(0.6 + (idx % 7) / 71.0::DOUBLE) AS mean FROM w WHERE seg_id % 3 != 2 GROUP BY ALL)
SELECT g.call_id, g.seg_id, round(coalesce(mean, exp(-0.1::DOUBLE * (g.seg_id + 1))), 4) AS confidence FROM g LEFT JOIN m ON m.call_id = g.call_id AND m.seg_id = g.seg_id""")
def segment_confidence(spark, sf_dir):
    """The mean confidence of a segment's words, or what its log probability says."""
    segs = T.segments(spark, sf_dir).withColumn("avg_logprob", -0.1 * (F.col("seg_id") + 1))
    words = T.words(segs).where("seg_id % 3 != 2").withColumn("confidence", 0.6 + (F.col("word_idx") % 7) / 71.0)
    return timeline.segment_confidence(segs, words).select("call_id", "seg_id", "confidence")


@query(f"""WITH {_SEGS_SQL}, s AS (SELECT call_id, seg_id, off, length(text) AS len, start AS t0 FROM l WHERE length(text) >= 12),
h AS (SELECT s.call_id, s.seg_id, min(w.t) AS a, max(w.t + 0.2) AS b FROM s JOIN w ON w.call_id = s.call_id AND w.seg_id = s.seg_id AND w.a < s.off + 12 AND s.off + 4 < w.a + w.n WHERE s.seg_id % 2 = 0 GROUP BY ALL),
x AS (SELECT s.call_id, s.seg_id, h.a IS NOT NULL AS late, coalesce(h.a, t0 + 4.0 * 4 / len) AS a, coalesce(h.b, t0 + 4.0 * 12 / len) AS b FROM s LEFT JOIN h ON h.call_id = s.call_id AND h.seg_id = s.seg_id)
SELECT call_id, seg_id, CASE WHEN late THEN 'late_word_alignment' ELSE 'character_ratio_fallback' END AS method, {_r4_sql('greatest(0, a - CASE WHEN late THEN 0.13 ELSE 0.21 END)')} AS start, {_r4_sql('b + CASE WHEN late THEN 0.13 ELSE 0.21 END')} AS stop FROM x""")
def late_alignment(spark, sf_dir):
    """Spans without tokens are timed by words that came late, or by their share of the segment."""
    segs = T.segments(spark, sf_dir)
    offsets = timeline.segment_offsets(segs)
    spans = offsets.where("char_end - char_start >= 12").select("call_id", F.col("seg_id").alias("span_id"), F.lit("OTP").alias("type"), (F.col("char_start") + 4).alias("start"), (F.col("char_start") + 12).alias("end"), (F.col("seg_id") + 0.5).alias("confidence"))
    out = timeline.fallback_intervals(spans, offsets, T.words(segs).where("seg_id % 2 = 0"))
    return out.select("call_id", (F.col("confidence") - 0.5).cast("long").alias("seg_id"), F.col("alignment_method").alias("method"), _r4(F.col("start")).alias("start"), _r4(F.col("end")).alias("stop"))


@query(f"""WITH {_SEGS_SQL}, p AS (SELECT call_id, greatest(0, t - 0.09) AS a, t + 0.2 + idx % 7 * 0.0037 + 0.09 AS b FROM w WHERE (idx + seg_id) % 2 = 0),
f AS (SELECT *, CASE WHEN a > max(b) OVER (PARTITION BY call_id ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 0.06 THEN 1 ELSE 0 END AS n FROM p),
i AS (SELECT *, sum(n) OVER (PARTITION BY call_id ORDER BY a, b RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS k FROM f)
SELECT call_id, {_r4_sql('min(a)')} AS start, {_r4_sql('max(b)')} AS stop, count(*)::BIGINT AS n FROM i GROUP BY call_id, k""")
def closed_gaps(spark, sf_dir):
    """Intervals merged over the default gap; the made times never lie at it exactly."""
    w = T.words(T.segments(spark, sf_dir)).where("(word_idx + seg_id) % 2 = 0")
    pads = w.select("call_id", F.greatest(F.lit(0.0), F.col("start") - 0.09).alias("start"), (F.col("start") + 0.2 + F.col("word_idx") % 7 * 0.0037 + 0.09).alias("end"), F.array(F.concat_ws(":", "seg_id", "word_idx")).alias("types"), F.lit(1.0).alias("confidence"), F.lit("m").alias("alignment_method"), F.lit(1.0).alias("alignment_confidence"))
    return timeline.merge_intervals(pads).select("call_id", _r4(F.col("start")).alias("start"), _r4(F.col("end")).alias("stop"), F.size("types").cast("long").alias("n"))


@query("""WITH g AS (SELECT conv_id AS call_id, turn, turn * 5.0 + 1 AS a, turn * 5.0 + 3 AS b, CASE turn % 2 WHEN 0 THEN 'OTP' ELSE 'PHONE' END AS type FROM conversations),
f AS (SELECT conv_id AS call_id, turn * 5.0 + 1.5 AS a, turn * 5.0 + 4 AS b, CASE turn % 3 WHEN 0 THEN ['OTP'] WHEN 1 THEN ['PHONE'] ELSE ['OTP', 'PHONE'] END AS types FROM conversations)
SELECT g.call_id, g.turn, coalesce(max((least(g.b, f.b) - greatest(g.a, f.a)) / (g.b - g.a)), 0)::DOUBLE AS covered FROM g LEFT JOIN f ON f.call_id = g.call_id AND least(g.b, f.b) > greatest(g.a, f.a) AND list_contains(f.types, g.type) GROUP BY ALL""")
def gold_coverage(spark, sf_dir):
    """How much of each gold interval a found interval of its type covers."""
    conv = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("call_id"), "turn")
    at = F.col("turn") * 5.0
    gold = conv.select("call_id", "turn", (at + 1).alias("start"), (at + 3).alias("end"), F.when(F.col("turn") % 2 == 0, "OTP").otherwise("PHONE").alias("type"))
    kinds = F.when(F.col("turn") % 3 == 0, F.array(F.lit("OTP"))).when(F.col("turn") % 3 == 1, F.array(F.lit("PHONE"))).otherwise(F.array(F.lit("OTP"), F.lit("PHONE")))
    found = conv.select("call_id", (at + 1.5).alias("start"), (at + 4).alias("end"), kinds.alias("types"))
    return evaluation.interval_coverage(gold, found).select("call_id", "turn", "covered")


_KINDS_SQL = "CASE {} % 3 WHEN 0 THEN 'NAME' WHEN 1 THEN 'ADDRESS' ELSE 'PHONE' END"


@query(f"""WITH d AS (SELECT DISTINCT l_orderkey AS call_id, l_linenumber AS n FROM lineitem),
c AS (SELECT *, {_KINDS_SQL.format('n')} AS type, n * 7 % 23 AS a, n * 7 % 23 + 5 AS b FROM d), p AS (SELECT call_id, {_KINDS_SQL.format('(n + call_id)')} AS type, n * 11 % 23 AS a, n * 11 % 23 + 4 AS b, (0.5 + n / 64.0)::DOUBLE AS confidence FROM d)
SELECT c.call_id, c.n::INT AS span_id, round(coalesce(max(p.confidence), 0), 4) AS support FROM c LEFT JOIN p ON p.call_id = c.call_id AND p.a < c.b AND c.a < p.b AND (p.type = c.type OR (p.type IN ('NAME', 'ADDRESS') AND c.type IN ('NAME', 'ADDRESS'))) GROUP BY ALL""")
def name_support(spark, sf_dir):
    """The support of a name model's proposals for candidates, over made spans."""
    d = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("call_id"), F.col("l_linenumber").cast("int").alias("n")).distinct()
    kind = lambda of: F.expr(_KINDS_SQL.format(of))
    candidates = d.select("call_id", F.col("n").alias("span_id"), kind("n").alias("type"), (F.col("n") * 7 % 23).alias("start"), (F.col("n") * 7 % 23 + 5).alias("end"))
    proposals = d.select("call_id", kind("(n + call_id)").alias("type"), (F.col("n") * 11 % 23).alias("start"), (F.col("n") * 11 % 23 + 4).alias("end"), (0.5 + F.col("n") / 64.0).alias("confidence"))
    return providers.name_support(candidates, proposals).select("call_id", "span_id", "support")


@query("""WITH e AS (SELECT vec_id, [embedding[1]::DOUBLE, embedding[2]::DOUBLE, embedding[3]::DOUBLE] AS v FROM embeddings), s AS (SELECT vec_id, v, list_reverse_sort(v) AS r FROM e)
SELECT vec_id, ['a', 'b', 'c'][list_position(v, r[1])] AS label, r[1] AS confidence, r[1] - r[2] AS runner_up_margin, concat(['a', 'b', 'c'][list_position(v, r[2])], ',', ['a', 'b', 'c'][list_position(v, r[3])]) AS others FROM s""")
def label_ranking(spark, sf_dir):
    """The best of scored labels, its lead and the next ones."""
    scores = F.array(*[F.struct(F.get("embedding", F.lit(i)).cast("double").alias("score"), F.lit(n).alias("label")) for i, n in enumerate("abc")])
    rows = table(spark, sf_dir, "embeddings").select("vec_id", providers.rank_labels(scores).alias("r"))
    return rows.select("vec_id", "r.label", "r.confidence", "r.runner_up_margin", F.array_join("r.alternatives", ",").alias("others"))


# ---- evaluation ----


@query(f"""WITH c AS (SELECT c_custkey AS k, {T.TYPE_SQL} AS type FROM customer),
x AS (SELECT k, (type IS NOT NULL AND k % 16 != 5)::INT AS tp, (type IS NOT NULL AND k % 16 = 5)::INT AS fp, (k % 16 IN (2, 4))::INT AS fn, ((type IS NULL AND k % 16 != 2) OR k % 16 = 5)::INT AS negative, (k % 16 = 2)::INT AS leaked FROM c)
SELECT sum(tp)::BIGINT AS tp, sum(fp)::BIGINT AS fp, sum(fn)::BIGINT AS fn, sum(negative)::BIGINT AS negative_cases, sum(negative * fp)::BIGINT AS negative_cases_with_fp, sum(leaked)::BIGINT AS mask_failure_cases,
  round(sum(tp) / (sum(tp) + sum(fp)), 6) AS precision, round(sum(tp) / (sum(tp) + sum(fn)), 6) AS recall, round(2 * sum(tp) / (2 * sum(tp) + sum(fp) + sum(fn)), 6) AS f1, round(sum(negative * fp) / sum(negative), 6) AS negative_case_false_positive_rate FROM x""")
def case_report(spark, sf_dir):
    """Detection scored against a gold standard that misses some values, expects others that are not
    there, and one kind that the context takes away."""
    rows = privacy.protect_documents(T.utterances(spark, sf_dir))
    k, kind = F.col("call_id") % 16, "array<struct<type:string,value:string>>"
    own = F.expr(T.TYPE_SQL.replace("c_custkey", "call_id")), F.expr(T.VALUE_SQL.replace("c_custkey", "call_id"))
    gold = F.when(own[0].isNull() | (k == 5), F.array().cast(kind)).otherwise(F.array(F.struct(own[0].alias("type"), own[1].alias("value"))))
    more = F.when(k == 4, F.array(F.struct(F.lit("PAN").alias("type"), F.lit("ABCDE1234F").alias("value")))).when(k == 2, F.array(F.struct(F.lit("PHONE").alias("type"), F.expr(T.PHONE.replace("c_custkey", "call_id")).alias("value")))).otherwise(F.array().cast(kind))
    made_cases = rows.select(F.col("call_id").alias("id"), F.concat(gold, more).alias("expected"), F.transform("protected.pii", lambda x: F.struct(x["type"].alias("type"), x["value"].alias("value"))).alias("found"), "protected.safe_text")
    out = evaluation.case_summary(evaluation.case_rows(made_cases))
    rate = lambda c: F.round(c, 6).alias(c)
    return out.select("tp", "fp", "fn", "negative_cases", "negative_cases_with_fp", "mask_failure_cases", rate("precision"), rate("recall"), rate("f1"), rate("negative_case_false_positive_rate"))


_WORD = r"[\p{L}\p{N}_@.+-]+"


@query(f"""WITH t AS (SELECT item_id, len(regexp_extract_all(text, '{_WORD}')) AS n, len(regexp_extract_all(array_to_string(string_split(text, ' ')[2:], ' '), '{_WORD}')) AS m FROM benchmark)
SELECT item_id, round((n - m) / greatest(1, n), 4) AS wer FROM t""")
def word_errors(spark, sf_dir):
    """Transcripts that lack the first word: as many edits as it has parts."""
    ship(spark)
    words = F.split("text", " ")
    heard = F.array_join(F.slice(words, F.lit(2), F.greatest(F.size(words) - 1, F.lit(1))), " ")
    return table(spark, sf_dir, "benchmark").select("item_id", F.round(evaluation.word_errors(F.col("text"), heard), 4).alias("wer"))


@query(f"""WITH t AS (SELECT item_id, item_id % 4 AS k, len(regexp_extract_all(text, '{_WORD}')) AS n, len(regexp_extract_all(array_to_string(string_split(text, ' ')[2:], ' '), '{_WORD}')) AS m FROM benchmark)
SELECT item_id AS id, CASE WHEN k != 3 AND n > 0 THEN round((n - m) / n, 4) END AS wer, [2, 1, 0, 0][1 + k]::INT AS pii_tp, [0, 0, 1, 1][1 + k]::INT AS pii_fp, [0, 1, 2, 2][1 + k]::INT AS pii_fn, (k = 0)::INT AS profanity_tp, (k = 1)::INT AS profanity_fp, (k = 2)::INT AS profanity_fn,
  [0.5, 1.0, 1.0, 1.0][1 + k]::DOUBLE AS alignment_coverage, [0.75, 0.0, 0.5, NULL][1 + k]::DOUBLE AS redaction_coverage FROM t""")
def manifest_report(spark, sf_dir):
    """Calls of a manifest against their results: words, values, profanity, alignment and hidden audio."""
    pick = lambda *xs: F.get(F.array(*[F.expr(x) for x in xs]), (F.col("item_id") % 4).cast("int"))
    phone, otp = "named_struct('type', 'PHONE', 'value', '98765 43210')", "named_struct('type', 'otp', 'value', '12')"
    found = lambda kind, value, ids: f"named_struct('type', '{kind}', 'value', '{value}', 'token_ids', cast(array({ids}) as array<int>))"
    rows = table(spark, sf_dir, "benchmark")
    gold_time = "array(named_struct('type', 'PHONE', 'start', 1.0D, 'end', 3.0D))"
    manifest = rows.select(
        F.col("item_id").alias("id"), F.when(F.col("item_id") % 4 != 3, F.col("text")).alias("transcript"), F.expr(f"array({phone}, {otp})").alias("pii"),
        pick("array('Shit')", "cast(array() as array<string>)", "array('shit')", "cast(array() as array<string>)").alias("profanity"),
        pick(gold_time, gold_time, "array(named_struct('type', 'PHONE', 'start', 1.0D, 'end', 3.0D), named_struct('type', 'OTP', 'start', 1.0D, 'end', 3.0D))", f"slice({gold_time}, 1, 0)").alias("gold_intervals"),
    )
    words = F.split("text", " ")
    swear = "named_struct('type', 'PROFANITY', 'value', 'SH-IT')"
    times = lambda kind, a, b: f"named_struct('types', array('{kind}'), 'start', {a}D, 'end', {b}D)"
    results = rows.select(
        F.col("item_id").alias("id"), F.array_join(F.slice(words, F.lit(2), F.greatest(F.size(words) - 1, F.lit(1))), " ").alias("text"),
        pick(f"array({found('PHONE', '9876543210', '3')}, {found('OTP', '12', '')})", f"array({found('PHONE', '9876543210', '3')})", f"array({found('PHONE', '9876543211', '3')})", f"array({found('PAN', '9876543210', '4')})").alias("pii"),
        pick(f"array({swear})", f"array({swear})", f"slice(array({swear}), 1, 0)", f"slice(array({swear}), 1, 0)").alias("profanity"),
        pick(f"array({times('PHONE', 1.5, 4.0)})", f"array({times('OTP', 1.5, 4.0)})", f"array({times('OTP', 0.0, 9.0)})", f"array({times('OTP', 0.0, 9.0)})").alias("intervals"),
        F.lit(0.25).alias("real_time_factor"),
    )
    return evaluation.manifest_rows(manifest, results).drop("real_time_factor")


@query(f"""WITH c AS (SELECT c_custkey AS k FROM customer)
SELECT k AS id, round(least(1, greatest(0, 0.48 * ((k % 97) / 97.0) + 0.22 * ((k % 89) / 89.0) + 0.18 * ((k % 83) / 83.0) + 0.12 * ((k % 79) / 79.0)))::DOUBLE, 3) AS trust FROM c""")
def call_trust(spark, sf_dir):
    part = lambda n: (F.col("c_custkey") % n) / float(n)
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), privacy.trust(part(97), part(89), part(83), part(79)).alias("trust"))


# ---- facts, obligations, compliance ----

#: A sentence of a collection call, its facts, obligations, disclosures and risks.
_COLLECTED = [
    ("The outstanding is Rs 5,000.", [("OUTSTANDING_AMOUNT", "5000")], [], [], []),
    ("The amount due is INR 300.50 only.", [("DUE_AMOUNT", "300.50")], [], [], []),
    ("A loan amount of Rs 90000 was given.", [("LOAN_AMOUNT", "90000")], [], [], []),
    ("We can settle for Rs 700.", [("SETTLEMENT_AMOUNT", "700")], [], [], []),
    ("There is a penalty of 250 rupees.", [("LATE_FEE", "250")], [], [], []),
    ("The emi of Rs 10 and the penalty of Rs 20.", [("EMI_AMOUNT", "10"), ("LATE_FEE", "20")], [], [], []),
    ("He gave Rs 40.", [("MONEY", "40")], [], [], []),
    ("The apr is 12 percent.", [("APR", "12%")], [], [], []),
    ("The interest is 9.5 per cent.", [("INTEREST_RATE", "9.5%")], [], [], []),
    ("The repayment term is 24 Months.", [("TENURE", "24 months")], [], [], []),
    ("He is 24 years old.", [], [], [], []),
    ("The due date is 12/05/2026.", [("DUE_DATE", "12/05/2026")], [], [], []),
    ("He will pay on friday by neft.", [("PAYMENT_DATE", "friday"), ("PAYMENT_METHOD", "NEFT")], [], [], []),
    ("See you on monday.", [("PAYMENT_DATE", "monday")], [], [], []),
    ("The auto debit bounced.", [("PAYMENT_METHOD", "AUTO DEBIT"), ("PAYMENT_STATUS", "bounced")], [], [], []),
    ("I dispute this amount.", [], [("PAYMENT_OR_DEBT_DISPUTE", 0.92)], [], []),
    ("I do not owe that.", [], [("PAYMENT_OR_DEBT_DISPUTE", 0.92)], [], []),
    ("I will pay soon.", [], [("PROMISE_TO_PAY", 0.84)], [], []),
    ("I need more time.", [], [("REPAYMENT_DIFFICULTY", 0.91)], [], []),
    ("I am not sure.", [], [], [], []),
    ("I refuse to pay.", [], [("PAYMENT_REFUSAL", 0.93)], [], []),
    ("The call may be recorded for quality purposes.", [], [], ["quality_monitoring_disclosure", "recording_disclosure"], []),
    ("Never share your otp.", [], [], ["otp_safety_warning"], []),
    ("You may raise a complaint.", [], [], ["grievance_channel"], []),
    ("We will tell your employer about your loan.", [], [], [], [("public_shaming_threat", "high"), ("third_party_debt_disclosure", "high")]),
    ("You will regret this.", [], [], [], [("physical_threat", "high")]),
    ("The court has ordered your arrest.", [], [], [], [("misleading_authority_claim", "high")]),
    ("That was stupid.", [], [], [], [("aggressive_insult", "medium")]),
]
_M = len(_COLLECTED)
_COLLECTED_SQL = f"CASE o_orderkey % {_M} " + " ".join(f"WHEN {i} THEN '{c[0]}'" for i, c in enumerate(_COLLECTED)) + " END"


def _collected(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")).select(F.col("o_orderkey").alias("call_id"), F.to_date("o_orderdate").alias("call_date"), F.expr(_COLLECTED_SQL).alias("text"))


def _each(part: int, columns) -> str:
    return "\nUNION ALL ".join(f"SELECT o_orderkey AS call_id, {columns(x)} FROM orders WHERE o_orderkey % {_M} = {i}" for i, c in enumerate(_COLLECTED) for x in c[part])


@query(_each(1, lambda x: f"'{x[0]}' AS type, '{x[1]}' AS value"))
def fact_kinds(spark, sf_dir):
    rows = _collected(spark, sf_dir).select("call_id", F.explode(understanding.financial_facts(F.col("text"))).alias("f"))
    return rows.select("call_id", "f.type", "f.value")


@query(_each(2, lambda x: f"'{x[0]}' AS type, {x[1]}::DOUBLE AS confidence"))
def obligation_kinds(spark, sf_dir):
    rows = _collected(spark, sf_dir).select("call_id", F.explode(understanding.obligations(F.col("text"), F.col("call_date"))).alias("o"))
    return rows.select("call_id", "o.type", "o.confidence")


@query(_each(3, lambda x: f"'{x}' AS rule"))
def disclosures(spark, sf_dir):
    rows = _collected(spark, sf_dir).select("call_id", F.explode(understanding.regulatory(F.col("text"))["present"]).alias("d"))
    return rows.select("call_id", "d.rule")


@query(_each(4, lambda x: f"'{x[0]}' AS type, '{x[1]}' AS severity"))
def risk_phrases(spark, sf_dir):
    rows = _collected(spark, sf_dir).select("call_id", F.explode(understanding.regulatory(F.col("text"))["risks"]).alias("r"))
    return rows.select("call_id", "r.type", "r.severity")


@query("""SELECT c_custkey AS id, CASE c_custkey % 3 WHEN 0 THEN '[ACCOUNT_NUMBER REDACTED]' WHEN 1 THEN '[UPI REDACTED]' ELSE cast(c_custkey AS VARCHAR) END AS value FROM customer""")
def safe_facts(spark, sf_dir):
    """Facts of identifying types lose their values."""
    kind = F.expr("CASE c_custkey % 3 WHEN 0 THEN 'ACCOUNT_NUMBER' WHEN 1 THEN 'UPI' ELSE 'MONEY' END")
    fact = F.struct(kind.alias("type"), F.col("c_custkey").cast("string").alias("value"))
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.get(understanding.safe_facts(F.array(fact)), F.lit(0))["value"].alias("value"))


#: The published permutations of the Verhoeff scheme, row by row.
_PERMUTATIONS = "['0123456789', '1576283094', '5803796142', '8916043527', '9453126870', '4286573901', '2793806415', '7046913258']"


@query(f"""WITH c AS (SELECT c_custkey AS id, cast(200000000000 + c_custkey * 7919 AS VARCHAR) AS value FROM customer),
p AS (SELECT id, value, list_transform(generate_series(0, 11), lambda i: substr({_PERMUTATIONS}[1 + i % 8], 1 + substr(reverse(value), (i + 1)::INT, 1)::INT, 1)::INT) AS xs FROM c)
SELECT id, value, list_reduce(xs, lambda a, b: CASE WHEN a < 5 AND b < 5 THEN (a + b) % 5 WHEN a < 5 THEN 5 + (a + b - 5) % 5 WHEN b < 5 THEN 5 + (a - b) % 5 ELSE (a - b + 5) % 5 END, 0) = 0 AS valid FROM p""")
def verhoeff_checks(spark, sf_dir):
    from sparkveil.functions.scalars import verhoeff_ok

    number = F.expr("cast(200000000000 + c_custkey * 7919 as string)")
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), number.alias("value"), verhoeff_ok(number).alias("valid"))


# ---- sources and audio ----


@query(f"SELECT cast(c_custkey AS VARCHAR) AS id, {T.UTTERANCE_SQL} AS text, coalesce({T.TYPE_SQL}, 'none') AS expected FROM customer")
def case_files(spark, sf_dir):
    """Cases written as lines of JSON and read again."""
    kind = F.expr(T.TYPE_SQL.replace("c_custkey", "call_id"))
    value = F.expr(T.VALUE_SQL.replace("c_custkey", "call_id"))
    expected = F.when(kind.isNull(), F.array().cast("array<struct<type:string,value:string>>")).otherwise(F.array(F.struct(kind.alias("type"), value.alias("value"))))
    path = shared_path(spark, "case-files")
    cases.write_results(T.utterances(spark, sf_dir).select(F.col("call_id").cast("string").alias("id"), "text", expected.alias("expected")), path)
    out = materialize(cases.read_cases(spark, path), "cases")
    drop_path(spark, path)
    return out.select("id", "text", F.coalesce(F.get("expected", F.lit(0))["type"], F.lit("none")).alias("expected"))


def _waves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A second of sound for each nation: silence, or a wave that swings fully at each sample."""
    ship(spark)

    @pandas_udf("binary")
    def wav(keys):
        import numpy as np

        from sparkveil.sources.audio import encode_wav

        swing = np.where(np.arange(16_000) % 2 == 0, 1.0, -1.0)
        return keys.map(lambda k: encode_wav((swing * (k % 2)).astype("float32"), 16_000))

    key = F.col("n_nationkey").cast("long")
    return table(spark, sf_dir, "nation").select(F.concat(F.lit("nation-"), key).alias("path"), F.lit("wav").alias("suffix"), wav(key).alias("content"))


@query("""SELECT concat('nation-', n_nationkey) AS path, 1.0::DOUBLE AS duration_s, [0.2, 0.35][1 + n_nationkey % 2]::DOUBLE AS quality, [1.0, 0.0][1 + n_nationkey % 2]::DOUBLE AS silence_ratio, [0.0, 1.0][1 + n_nationkey % 2]::DOUBLE AS clipping_ratio,
  ['low_snr,high_silence,low_volume', 'low_snr,clipping'][1 + n_nationkey % 2] AS issues, 'MEDIUM' AS tamper, 0.4::DOUBLE AS tamper_score, 'repeated_audio_blocks' AS signals FROM nation""")
def audio_levels(spark, sf_dir):
    """Signal metrics of silence and of a fully clipped wave, whose values follow from their definition."""
    rows = audio.audio_metrics(_waves(spark, sf_dir))
    return rows.select("path", "duration_s", F.col("quality.score").alias("quality"), "quality.silence_ratio", "quality.clipping_ratio", F.array_join("quality.issues", ",").alias("issues"), F.col("tamper.risk").alias("tamper"), F.col("tamper.score").alias("tamper_score"), F.array_join("tamper.signals", ",").alias("signals"))


@query("""SELECT concat('nation-', n_nationkey) AS path, 16000::BIGINT AS samples, CASE n_nationkey % 2 WHEN 0 THEN 16000 ELSE 4000 END::BIGINT AS zeros FROM nation""")
def muted_audio(spark, sf_dir):
    """Protected files: a quarter of a second is silent afterwards."""
    files = _waves(spark, sf_dir).withColumn("intervals", F.expr("array(named_struct('start', 0.25D, 'end', 0.5D))"))

    @pandas_udf("struct<samples:bigint,zeros:bigint>")
    def count(contents):
        import pandas as pd

        from sparkveil.sources.audio import decode_wav

        waves = [decode_wav(bytes(c))[0] for c in contents]
        return pd.DataFrame({"samples": [len(x) for x in waves], "zeros": [int((x == 0).sum()) for x in waves]})

    return audio.protect_audio(files, "mute").select("path", count("protected").alias("c")).select("path", "c.samples", "c.zeros")
