"""Registered queries over the driver's tables, each with its SQL twin where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from sparkveil.functions import patterns as P
from sparkveil.functions.scalars import due_date, luhn_ok, normal_value
from sparkveil.functions.spans import by_position, find, greedy, render
from sparkveil.operators import evaluation, privacy, recovery, timeline, understanding
from sparkveil.plans import analyze, calls, sentences, services  # noqa: F401, the last three register queries
from sparkveil.plans import transcripts as T
from sparkveil.plans.register import ORACLE_SQL, QUERIES, query  # noqa: F401
from sparkveil.session import ship, spread, table
from sparkveil.sources import audio

#: The e-mail shape without look-around, which the SQL engine lacks; on these texts they agree.
MAIL_SQL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"


def _mails(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "text")
    return docs.withColumn("mails", find(F.coalesce("text", F.lit("")), P.EMAIL, prefilter="@"))


@query(f"""SELECT lang, source, count(*) AS docs, coalesce(sum(len(regexp_extract_all(text, '{MAIL_SQL}'))), 0)::BIGINT AS mails,
  sum(length(regexp_replace(text, '{MAIL_SQL}', '[EMAIL REDACTED]', 'g')))::BIGINT AS safe_chars FROM documents GROUP BY ALL""")
def email_by_lang(spark, sf_dir):
    """E-mail addresses found natively, hidden, and counted by language and source."""
    rows = _mails(spark, sf_dir)
    safe = render(F.coalesce("text", F.lit("")), F.col("mails"), lambda m: F.lit("[EMAIL REDACTED]"))
    return rows.groupBy("lang", "source").agg(F.count(F.lit(1)).alias("docs"), F.sum(F.size("mails")).cast("long").alias("mails"), F.sum(F.char_length(safe)).cast("long").alias("safe_chars"))


@query(f"""WITH m AS (SELECT doc_id, regexp_extract_all(text, '{MAIL_SQL}') AS m, string_split_regex(text, '{MAIL_SQL}') AS s FROM documents),
u AS (SELECT doc_id, m, s, unnest(generate_series(1, len(m))) AS i FROM m)
SELECT doc_id, m[i] AS value, (list_sum(list_transform(s[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i-1], lambda x: length(x))), 0))::BIGINT AS start FROM u""")
def email_spans(spark, sf_dir):
    return _mails(spark, sf_dir).select("doc_id", F.explode("mails").alias("m")).select("doc_id", "m.value", F.col("m.start").cast("long").alias("start"))


@query(r"""WITH r AS (SELECT doc_id, unnest(regexp_extract_all(text, '\b[0-9]{13,19}\b')) AS d FROM documents),
x AS (SELECT doc_id, d, list_sum(list_transform(generate_series(1, length(d)), lambda i: CASE WHEN (length(d) - i) % 2 = 1
  THEN CASE WHEN 2 * substr(d, i, 1)::INT > 9 THEN 2 * substr(d, i, 1)::INT - 9 ELSE 2 * substr(d, i, 1)::INT END ELSE substr(d, i, 1)::INT END)) AS s FROM r)
SELECT doc_id, d AS value, (s % 10 = 0) AS luhn FROM x""")
def card_luhn(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.regexp_extract_all(F.col("text"), F.lit(r"\b[0-9]{13,19}\b"), F.lit(0))).alias("value"))
    return rows.select("doc_id", "value", luhn_ok(F.col("value")).alias("luhn"))


@query(f"""WITH t AS (SELECT c_custkey AS call_id, {T.TYPE_SQL} AS type, {T.VALUE_SQL} AS value FROM customer)
SELECT call_id, type, value FROM t WHERE type IS NOT NULL""")
def call_privacy_spans(spark, sf_dir):
    """Owned, vetoed, corrected, answered and counted values in calls."""
    rows = privacy.detect(T.utterances(spark, sf_dir))
    return rows.select("call_id", F.explode("pii").alias("s")).select("call_id", "s.type", "s.value")


@query(f"""WITH t AS (SELECT c_custkey AS call_id, {T.UTTERANCE_SQL} AS text, {T.TYPE_SQL} AS type, {T.VALUE_SQL} AS value FROM customer)
SELECT call_id, CASE WHEN type IS NULL THEN text ELSE replace(text, value, concat('[', type, ' REDACTED]')) END AS safe_text FROM t""")
def call_safe_text(spark, sf_dir):
    return privacy.protect_documents(T.utterances(spark, sf_dir)).select("call_id", "protected.safe_text")


@query(f"""WITH e AS (SELECT c_custkey AS id, {T.TYPE_SQL} AS type FROM customer), n AS (SELECT type, count(*) AS tp FROM e WHERE type IS NOT NULL GROUP BY type)
SELECT type AS kind, tp::BIGINT AS tp, 0::BIGINT AS fp, 0::BIGINT AS fn, 1.0::DOUBLE AS precision, 1.0::DOUBLE AS recall, 1.0::DOUBLE AS f1 FROM n""")
def detector_scores(spark, sf_dir):
    """Found against expected values, as multisets, by type."""
    found = call_privacy_spans(spark, sf_dir).select(F.col("type").alias("kind"), "type", F.concat_ws(":", "call_id", evaluation.score_value(F.col("type"), F.col("value"))).alias("value"))
    cust = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("call_id"), F.expr(T.TYPE_SQL).alias("type"), F.expr(T.VALUE_SQL).alias("value")).where("type is not null")
    expected = cust.select(F.col("type").alias("kind"), "type", F.concat_ws(":", "call_id", evaluation.score_value(F.col("type"), F.col("value"))).alias("value"))
    out = evaluation.rates(evaluation.multiset_counts(expected, found, ["kind"]))
    return out.select("kind", "tp", "fp", "fn", "precision", "recall", "f1")


@query(f"""WITH e AS (SELECT c_custkey % 8 AS k FROM customer), w(k, confidence) AS (VALUES (0, 0.94), (3, 0.985), (4, 0.95), (5, 0.97), (6, 0.97)),
t(threshold) AS (VALUES (0.8::DOUBLE), (0.96::DOUBLE), (0.98::DOUBLE))
SELECT threshold, count(*) FILTER (confidence >= threshold)::BIGINT AS tp, 0::BIGINT AS fp, count(*) FILTER (confidence < threshold)::BIGINT AS fn FROM e JOIN w USING (k) CROSS JOIN t GROUP BY threshold""")
def threshold_sweep(spark, sf_dir):
    rows = privacy.detect(T.utterances(spark, sf_dir)).select(F.col("call_id").alias("id"), F.explode("pii").alias("s"))
    found = rows.select("id", "s.type", F.concat_ws(":", "id", "s.value").alias("value"), "s.confidence")
    expected = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.expr(T.TYPE_SQL).alias("type"), F.concat_ws(":", "c_custkey", F.expr(T.VALUE_SQL)).alias("value")).where("type is not null")
    return evaluation.threshold_sweep(expected, found, [0.8, 0.96, 0.98]).select("threshold", "tp", "fp", "fn")


@query(f"""WITH c AS (SELECT o_orderkey AS call_id, o_orderkey % 5 AS k, {T.COLLECTION_SQL} AS text FROM orders)
SELECT call_id, 'EMI_AMOUNT' AS type, cast(1000 + call_id % 5000 AS VARCHAR) AS value FROM c WHERE k = 0
UNION ALL SELECT call_id, 'PAYMENT_STATUS', 'overdue' FROM c WHERE k = 0
UNION ALL SELECT call_id, 'MONEY', cast(500 + call_id % 700 AS VARCHAR) FROM c WHERE k = 1
UNION ALL SELECT call_id, 'PAYMENT_DATE', 'tomorrow' FROM c WHERE k = 1
UNION ALL SELECT call_id, 'PAYMENT_METHOD', 'UPI' FROM c WHERE k = 1
UNION ALL SELECT call_id, 'TENURE', concat(6 + call_id % 30, ' months') FROM c WHERE k = 3""")
def financial_facts(spark, sf_dir):
    rows = T.collection_calls(spark, sf_dir).select("call_id", F.explode(understanding.financial_facts(F.col("text"))).alias("f"))
    return rows.select("call_id", "f.type", "f.value")


@query("""WITH c AS (SELECT o_orderkey AS call_id, o_orderkey % 5 AS k, CAST(o_orderdate AS DATE) AS d FROM orders)
SELECT call_id, 'PROMISE_TO_PAY' AS type, CAST(d + 1 AS DATE) AS due_date, cast(500 + call_id % 700 AS VARCHAR) AS amount, 0.94::DOUBLE AS confidence FROM c WHERE k = 1
UNION ALL SELECT call_id, 'REPAYMENT_DIFFICULTY', NULL, NULL, 0.91 FROM c WHERE k = 2
UNION ALL SELECT call_id, 'PAYMENT_REFUSAL', NULL, NULL, 0.93 FROM c WHERE k = 2""")
def obligations(spark, sf_dir):
    rows = T.collection_calls(spark, sf_dir).select("call_id", F.explode(understanding.obligations(F.col("text"), F.col("call_date"))).alias("o"))
    return rows.select("call_id", "o.type", "o.due_date", "o.amount", "o.confidence")


@query("""WITH c AS (SELECT o_orderkey AS call_id, o_orderkey % 5 AS k FROM orders)
SELECT call_id, CASE WHEN k = 4 THEN 'high' ELSE 'low' END AS risk_level, (CASE WHEN k = 4 THEN 3 ELSE 0 END)::BIGINT AS risks, (CASE WHEN k = 3 THEN 0 ELSE 1 END)::BIGINT AS missing FROM c""")
def regulatory(spark, sf_dir):
    rows = T.collection_calls(spark, sf_dir).select("call_id", understanding.regulatory(F.col("text")).alias("r"))
    return rows.select("call_id", "r.risk_level", F.size("r.risks").cast("long").alias("risks"), F.size("r.missing").cast("long").alias("missing"))


_INTENT_SQL = ", ".join("('{}', {})".format(label, "[" + ", ".join("'" + k.replace("'", "''") + "'" for k in keys) + "]") for label, keys in P.INTENTS.items())


@query(f"""WITH c AS (SELECT o_orderkey AS call_id, lower({T.COLLECTION_SQL}) AS t FROM orders), i(label, keys) AS (VALUES {_INTENT_SQL}),
h AS (SELECT call_id, label, len(list_filter(keys, lambda k: contains(t, k))) AS hits FROM c CROSS JOIN i),
b AS (SELECT call_id, label, hits, row_number() OVER (PARTITION BY call_id ORDER BY hits DESC, label DESC) AS r FROM h)
SELECT call_id, CASE WHEN hits > 0 THEN label ELSE 'general customer support' END AS label, CASE WHEN hits > 0 THEN least(0.94, 0.66 + 0.09 * hits)::DOUBLE ELSE 0.5 END AS confidence, hits::BIGINT AS rule_hits FROM b WHERE r = 1""")
def intent_rules(spark, sf_dir):
    rows = T.collection_calls(spark, sf_dir).select("call_id", understanding.intent(F.col("text")).alias("i"))
    return rows.select("call_id", "i.label", F.round("i.confidence", 6).alias("confidence"), F.col("i.rule_hits").cast("long").alias("rule_hits"))


@query("""WITH x AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d, ['today', 'tomorrow', 'day after tomorrow', 'monday', 'friday', '31/02/2026', '5-3-69'][1 + o_orderkey % 7] AS e FROM orders)
SELECT o_orderkey, e AS expression, CASE e WHEN 'today' THEN d WHEN 'tomorrow' THEN CAST(d + 1 AS DATE) WHEN 'day after tomorrow' THEN CAST(d + 2 AS DATE)
  WHEN 'monday' THEN CAST(d + CAST((7 - isodow(d)) + 1 AS INT) AS DATE) WHEN 'friday' THEN CAST(d + CAST(CASE WHEN isodow(d) < 5 THEN 5 - isodow(d) ELSE 12 - isodow(d) END AS INT) AS DATE)
  WHEN '5-3-69' THEN DATE '1969-03-05' END AS due_date FROM x""")
def due_dates(spark, sf_dir):
    terms = F.array(*[F.lit(x) for x in ("today", "tomorrow", "day after tomorrow", "monday", "friday", "31/02/2026", "5-3-69")])
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("d"), F.get(terms, (F.col("o_orderkey") % 7).cast("int")).alias("expression"))
    return rows.select("o_orderkey", "expression", due_date(F.col("expression"), F.col("d")).alias("due_date"))


@query("""WITH c AS (SELECT c_custkey AS id, cast(100000000000 + c_custkey * 7919 AS VARCHAR) AS n FROM customer)
SELECT id, n AS value, regexp_replace(n, '[^0-9]', '', 'g') AS norm FROM c""")
def normal_values(spark, sf_dir):
    number = F.expr("cast(100000000000 + c_custkey * 7919 as string)")
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), number.alias("value"), F.concat_ws("-", F.substring(number, 1, 4), F.substring(number, 5, 8)).alias("spaced"))
    return rows.select("id", "value", normal_value(F.lit("AADHAAR"), F.col("spaced")).alias("norm"))


#: Spans made from line items: places and lengths that overlap, with a confidence to rank by.
_SPAN = "struct(cast(l_linenumber * 7 % 23 as int) as start, cast(l_linenumber * 7 % 23 + 3 + l_quantity % 9 as int) as end, l_linenumber as line, l_quantity as confidence)"


@query("""WITH RECURSIVE s AS (SELECT l_orderkey AS k, l_linenumber AS line, (l_linenumber * 7 % 23)::INT AS a, (l_linenumber * 7 % 23 + 3 + l_quantity % 9)::INT AS b,
  row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity DESC, l_linenumber, l_linenumber * 7 % 23, l_extendedprice) AS r FROM lineitem),
w AS (SELECT k, 0 AS r, []::STRUCT(a INT, b INT, line INT)[] AS kept FROM (SELECT DISTINCT k FROM s)
  UNION ALL SELECT w.k, s.r, CASE WHEN len(list_filter(w.kept, lambda x: x.a < s.b AND s.a < x.b)) > 0 THEN w.kept ELSE list_append(w.kept, {a: s.a, b: s.b, line: s.line}) END FROM w JOIN s ON s.k = w.k AND s.r = w.r + 1),
z AS (SELECT k, kept, row_number() OVER (PARTITION BY k ORDER BY r DESC) AS n FROM w)
SELECT k AS l_orderkey, len(kept)::BIGINT AS kept, list_sum(list_transform(kept, lambda x: x.a))::BIGINT AS starts FROM z WHERE n = 1""")
def overlap_resolve(spark, sf_dir):
    """Greedy choice of non-overlapping spans by confidence."""
    kind = "array<struct<start:int,end:int,line:int,confidence:double,price:double>>"
    item = F.struct(F.expr("cast(l_linenumber * 7 % 23 as int)").alias("start"), F.expr("cast(l_linenumber * 7 % 23 + 3 + l_quantity % 9 as int)").alias("end"), F.col("l_linenumber").alias("line"), F.col("l_quantity").cast("double").alias("confidence"), F.col("l_extendedprice").cast("double").alias("price"))
    rows = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list(item).cast(kind).alias("s"))
    kept = by_position(greedy(F.col("s"), kind, lambda x: [-x["confidence"], x["line"], x["start"], x["price"]]))
    rows = rows.select("l_orderkey", kept.alias("k"))
    return rows.select("l_orderkey", F.size("k").cast("long").alias("kept"), F.aggregate("k", F.lit(0).cast("long"), lambda n, x: n + x["start"]).alias("starts"))


_WORDS_SQL = f"""g AS ({T.SEGMENTS_SQL}),
o AS (SELECT *, coalesce(sum(length(text) + 1) OVER (PARTITION BY call_id ORDER BY seg_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off FROM g),
l AS (SELECT *, string_split(text, ' ') AS ws FROM o),
u AS (SELECT call_id, seg_id, speaker, off, start, ws, unnest(generate_series(1, len(ws))) AS i FROM l),
w AS (SELECT call_id, seg_id, speaker, i - 1 AS word_idx, ws[i] AS word, off + i - 1 + coalesce(list_sum(list_transform(ws[1:i-1], lambda x: length(x))), 0) AS char_start, start + (i - 1) * 0.25 AS time_start, 0.5 + ((i - 1) % 5) * 0.1 AS confidence FROM u WHERE ws[i] != ''),
t AS (SELECT *, char_start + length(word) AS char_end, time_start + 0.2 AS time_end, row_number() OVER (PARTITION BY call_id ORDER BY seg_id, word_idx) - 1 AS token_id FROM w)"""


def _tokens(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    segs = T.segments(spark, sf_dir)
    return segs, timeline.word_map(segs, T.words(segs))


@query(f"""WITH {_WORDS_SQL} SELECT call_id, seg_id, token_id::BIGINT AS token_id, char_start::BIGINT AS char_start, char_end::BIGINT AS char_end, round(time_start, 4) AS time_start FROM t""")
def word_map(spark, sf_dir):
    _, tokens = _tokens(spark, sf_dir)
    return tokens.select("call_id", "seg_id", F.col("token_id").cast("long").alias("token_id"), F.col("char_start").cast("long").alias("char_start"), F.col("char_end").cast("long").alias("char_end"), F.round("time_start", 4).alias("time_start"))


def _long_word_spans(tokens: DataFrame) -> DataFrame:
    """A span over each eleventh word and half of the one after it."""
    rows = tokens.where("token_id % 11 = 0")
    return rows.select("call_id", F.col("token_id").alias("span_id"), F.when(F.col("token_id") % 2 == 0, "PHONE").otherwise("OTP").alias("type"), F.col("char_start").alias("start"), (F.col("char_end") + 3).alias("end"), F.lit(0.9).alias("confidence"))


@query(f"""WITH {_WORDS_SQL}, s AS (SELECT call_id, token_id AS span_id, char_start AS a, char_end + 3 AS b FROM t WHERE token_id % 11 = 0)
SELECT s.call_id, s.span_id::BIGINT AS span_id, count(*)::BIGINT AS n_tokens, round(min(time_start), 4) AS time_start, round(max(time_end), 4) AS time_end, round(avg(confidence), 4) AS alignment_confidence
FROM s JOIN t ON t.call_id = s.call_id AND t.char_start < s.b AND s.a < t.char_end GROUP BY ALL""")
def align_spans(spark, sf_dir):
    _, tokens = _tokens(spark, sf_dir)
    rows = timeline.attach_tokens(_long_word_spans(tokens), tokens)
    return rows.select("call_id", F.col("span_id").cast("long").alias("span_id"), F.size("token_ids").cast("long").alias("n_tokens"), F.round("time_start", 4).alias("time_start"), F.round("time_end", 4).alias("time_end"), "alignment_confidence")


@query(f"""WITH {_WORDS_SQL}, s AS (SELECT call_id, token_id AS span_id, char_start AS a, char_end + 3 AS b FROM t WHERE token_id % 11 = 0),
x AS (SELECT s.call_id, s.span_id, min(time_start) AS ts, max(time_end) AS te, avg(confidence) AS c FROM s JOIN t ON t.call_id = s.call_id AND t.char_start < s.b AND s.a < t.char_end GROUP BY ALL),
p AS (SELECT call_id, greatest(0, ts - CASE WHEN round(c, 4) < 0.72 THEN 0.15 ELSE 0.09 END) AS a, te + CASE WHEN round(c, 4) < 0.72 THEN 0.15 ELSE 0.09 END AS b FROM x),
f AS (SELECT *, CASE WHEN a > max(b) OVER (PARTITION BY call_id ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 0.07 THEN 1 ELSE 0 END AS n FROM p),
i AS (SELECT *, sum(n) OVER (PARTITION BY call_id ORDER BY a, b RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS k FROM f)
SELECT call_id, round(min(a), 4) AS start, round(max(b), 4) AS stop FROM i GROUP BY call_id, k""")
def protected_intervals(spark, sf_dir):
    """The merged audio intervals that hide the aligned spans. The made times are multiples of 0.01 s
    that can lie at the default gap of 0.06 s exactly, so the gap is 0.07 s here."""
    _, tokens = _tokens(spark, sf_dir)
    merged = timeline.merge_intervals(timeline.audio_intervals(timeline.attach_tokens(_long_word_spans(tokens), tokens)), gap=0.07)
    return merged.select("call_id", F.round("start", 4).alias("start"), F.round("end", 4).alias("stop"))


@query("""WITH s AS (SELECT conv_id AS call_id, turn AS seg_id, turn * 5.0 AS a, turn * 5.0 + 4.0 AS b FROM conversations),
t AS (SELECT conv_id AS call_id, turn AS turn_idx, role AS speaker, turn * 5.0 + 1.5 AS a, turn * 5.0 + 6.0 AS b FROM conversations WHERE turn % 3 != 2),
x AS (SELECT s.call_id, s.seg_id, t.speaker, row_number() OVER (PARTITION BY s.call_id, s.seg_id ORDER BY least(s.b, t.b) - greatest(s.a, t.a) DESC, t.turn_idx) AS r
  FROM s JOIN t ON s.call_id = t.call_id AND least(s.b, t.b) - greatest(s.a, t.a) > 0)
SELECT s.call_id, s.seg_id, coalesce(x.speaker, 'UNKNOWN') AS speaker FROM s LEFT JOIN x ON x.call_id = s.call_id AND x.seg_id = s.seg_id AND x.r = 1""")
def assign_speakers(spark, sf_dir):
    conv = table(spark, sf_dir, "conversations")
    segs = conv.select(F.col("conv_id").alias("call_id"), F.col("turn").alias("seg_id"), (F.col("turn") * 5.0).alias("start"), (F.col("turn") * 5.0 + 4.0).alias("end"))
    turns = conv.where("turn % 3 != 2").select(F.col("conv_id").alias("call_id"), F.col("turn").alias("turn_idx"), F.col("role").alias("speaker"), (F.col("turn") * 5.0 + 1.5).alias("start"), (F.col("turn") * 5.0 + 6.0).alias("end"))
    return timeline.assign_speakers(segs.withColumn("speaker", F.lit(None).cast("string")), turns).select("call_id", "seg_id", "speaker")


@query(f"""WITH g AS ({T.SEGMENTS_SQL}), o AS (SELECT *, coalesce(sum(length(text) + 1) OVER (PARTITION BY call_id ORDER BY seg_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS a FROM g),
s AS (SELECT DISTINCT call_id, 200 * (call_id % 9) AS p FROM o),
d AS (SELECT s.call_id, o.seg_id, CASE WHEN p + 5 < a THEN a - p - 5 WHEN p > a + length(text) THEN p - a - length(text) ELSE 0 END AS d FROM s JOIN o USING (call_id)),
r AS (SELECT *, row_number() OVER (PARTITION BY call_id ORDER BY d, seg_id) AS n FROM d)
SELECT call_id, seg_id, d::BIGINT AS distance FROM r WHERE n = 1""")
def nearest_segment(spark, sf_dir):
    offsets = timeline.segment_offsets(T.segments(spark, sf_dir))
    spans = offsets.select("call_id").distinct().select("call_id", F.lit(0).alias("span_id"), (200 * (F.col("call_id") % 9)).cast("int").alias("start")).withColumn("end", F.col("start") + 5)
    return timeline.nearest_segment(spans, offsets).select("call_id", "seg_id", F.col("distance").cast("long").alias("distance"))


@query("""WITH e AS (SELECT user_id, epoch(ts) AS a, epoch(ts) + value AS b, event_type FROM events),
f AS (SELECT *, CASE WHEN a > max(b) OVER (PARTITION BY user_id ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 600 THEN 1 ELSE 0 END AS n FROM e),
i AS (SELECT *, sum(n) OVER (PARTITION BY user_id ORDER BY a, b RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS k FROM f)
SELECT user_id, round(min(a), 3) AS start, round(max(b), 3) AS stop, array_to_string(list_sort(list_distinct(list(event_type))), ',') AS types FROM i GROUP BY user_id, k""")
def merge_intervals(spark, sf_dir):
    begin = F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', cast(ts as timestamp_ntz))") / 1e6
    rows = table(spark, sf_dir, "events").select("user_id", begin.alias("start"), (begin + F.col("value")).alias("end"), F.array("event_type").alias("types"), F.lit(1.0).alias("confidence"), F.lit("m").alias("alignment_method"), F.lit(1.0).alias("alignment_confidence"))
    merged = timeline.merge_intervals(rows, ["user_id"], 600.0)
    return merged.select("user_id", F.round("start", 3).alias("start"), F.round("end", 3).alias("stop"), F.array_join("types", ",").alias("types"))


@query("""WITH v AS (SELECT value, row_number() OVER (ORDER BY value) - 1 AS i, count(*) OVER () AS n FROM events), s(share) AS (VALUES (0.5::DOUBLE), (0.95::DOUBLE), (0.99::DOUBLE))
SELECT share, value FROM v JOIN s ON i = round_even((n - 1) * share, 0)""")
def latency_ranks(spark, sf_dir):
    return evaluation.nearest_rank(table(spark, sf_dir, "events").select("value"), "value", [0.5, 0.95, 0.99])


@query("""WITH p AS (SELECT embedding AS e FROM embeddings WHERE vec_id = 0), q AS (SELECT embedding AS e FROM embeddings WHERE vec_id = 1)
SELECT vec_id, round(1 / (1 + exp(-10 * (list_cosine_similarity(embedding::DOUBLE[], (SELECT e::DOUBLE[] FROM p)) - list_cosine_similarity(embedding::DOUBLE[], (SELECT e::DOUBLE[] FROM q))))), 4) AS score FROM embeddings""")
def prototype_score(spark, sf_dir):
    emb = table(spark, sf_dir, "embeddings")
    first = {r["vec_id"]: list(r["embedding"]) for r in emb.where("vec_id in (0, 1)").collect()}  # two prototypes
    return emb.select("vec_id", evaluation.prototype_score(F.col("embedding"), [first[0]], [first[1]]).alias("score"))


@query("SELECT doc_id, length(text)::BIGINT AS n, sha256(text) AS digest FROM documents")
def debug_digests(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.char_length("text").cast("long").alias("n"), F.sha2(F.encode("text", "utf-8"), 256).alias("digest"))


@query()
def protected_documents(spark, sf_dir):
    """All documents through the span engine: what is hidden, by type."""
    rows = privacy.protect_documents(spread(table(spark, sf_dir, "documents").select("doc_id", "text")), ids=True)
    return rows.select("doc_id", F.size("protected.pii").alias("pii"), F.size("protected.financial_ids").alias("ids"), F.size("protected.profanity").alias("profanity"), F.sha2(F.encode("protected.safe_text", "utf-8"), 256).alias("safe_sha256"))


@query("""WITH c AS (SELECT c_custkey AS id, c_custkey % 4 AS k FROM customer)
SELECT id, 'PROFANITY' AS type, 'shit' AS canonical FROM c WHERE k = 1 UNION ALL SELECT id, 'TRANSACTION_ID', concat('TXN', 100000 + id) FROM c WHERE k = 2""")
def operational_and_rude(spark, sf_dir):
    """Operational identifiers and profanity, with clean look-alikes."""
    text = F.expr("CASE c_custkey % 4 WHEN 0 THEN 'The assistant sent the asset class.' WHEN 1 THEN 'What a sh1t day.' WHEN 2 THEN concat('The transaction id is TXN', 100000 + c_custkey, '.') ELSE 'The ticket number is pending.' END")
    rows = privacy.protect_documents(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), text.alias("text")), ids=True)
    ids = rows.select("id", F.explode("protected.financial_ids").alias("s")).select("id", "s.type", F.col("s.value").alias("canonical"))
    rude = rows.select("id", F.explode("protected.profanity").alias("s")).select("id", "s.type", "s.canonical")
    return ids.unionByName(rude)


# ---- calls with times ----

_TWICE = f"concat('My phone number is ', {T.PHONE}, ' ', {T.OTHER}, '.')"


def _timed_calls(spark: SparkSession, sf_dir: str, text: str) -> tuple[DataFrame, DataFrame]:
    """One segment for each customer; the fifth word ends a pause that depends on the key modulo 3,
    and every third call is heard badly."""
    rows = spread(table(spark, sf_dir, "customer").select("c_custkey")).select(F.col("c_custkey").alias("call_id"), F.expr(text).alias("text"))
    segs = rows.select("call_id", F.lit(0).alias("seg_id"), F.lit(0.0).alias("start"), F.lit(60.0).alias("end"), "text", F.lit("A").alias("speaker"))
    words = segs.select("call_id", "seg_id", F.posexplode(F.split("text", " ")).alias("word_idx", "word"))
    pause = F.when(F.col("word_idx") >= 5, F.when(F.col("call_id") % 3 == 1, 0.10).otherwise(0.65)).otherwise(0.05)
    begin = F.col("word_idx") * 0.22 + F.least(F.col("word_idx"), F.lit(4)) * 0.05 + pause
    return segs, words.select("call_id", "seg_id", "word_idx", "word", begin.alias("start"), (begin + 0.22).alias("end"), F.when(F.col("call_id") % 3 == 2, 0.40).otherwise(0.95).alias("confidence"))


@query(f"""WITH c AS (SELECT c_custkey AS call_id, {T.PHONE} AS a, {T.OTHER} AS b FROM customer)
SELECT call_id, b AS value, CASE WHEN call_id % 3 = 0 AND a != b THEN 'silent_restart' END AS corrected_by FROM c UNION ALL SELECT call_id, a, NULL FROM c WHERE call_id % 3 != 0 OR a = b""")
def correction_timed(spark, sf_dir):
    """A number said twice: a long pause on a clear line corrects it, a short one or a bad line doesn't."""
    segs, words = _timed_calls(spark, sf_dir, _TWICE)
    texts = timeline.call_text(segs)
    spans = privacy.detect(texts).select("call_id", F.posexplode("pii").alias("span_id", "s")).select("call_id", "span_id", "s.type", "s.start", "s.end", "s.value", "s.confidence", "s.ownership")
    aligned = timeline.attach_tokens(spans, timeline.word_map(segs, words))
    return timeline.timed_corrections(aligned, texts).select("call_id", "value", "corrected_by")


_LOST = f"""CASE c_custkey % 4 WHEN 0 THEN 'The CVV is located on the back of the card. Mine ID, address is available.'
 WHEN 1 THEN 'My registered name is 2210.' WHEN 2 THEN concat('My phone number is ', {T.PHONE}, '.') ELSE 'My email is not available.' END"""


@query("""SELECT c_custkey AS call_id, CASE c_custkey % 4 WHEN 0 THEN 'CVV' ELSE 'NAME' END AS type, CASE c_custkey % 4 WHEN 0 THEN 'followup_expectation' ELSE 'owned_field' END AS source
FROM customer WHERE c_custkey % 4 < 2""")
def recovery_windows(spark, sf_dir):
    """Windows to decode again where a value should be and isn't."""
    segs, words = _timed_calls(spark, sf_dir, _LOST)
    texts = timeline.call_text(segs)
    found = privacy.detect(texts).select("call_id", F.explode("pii").alias("s")).select("call_id", "s.type", "s.start", "s.end")
    return recovery.plan_recovery(texts, found, timeline.word_map(segs, words)).select("call_id", "type", "source")


@query("""WITH c AS (SELECT c_custkey AS call_id, c_custkey % 4 AS k FROM customer WHERE c_custkey % 4 < 2)
SELECT CASE k WHEN 0 THEN 'CVV' ELSE 'NAME' END AS type, count(*)::BIGINT AS planned, 0::BIGINT AS confirmed, count(*)::BIGINT AS guarded FROM c GROUP BY k
UNION ALL SELECT NULL, count(*), 0, count(*) FROM c""")
def recovery_telemetry(spark, sf_dir):
    """Nothing was decoded again: every window is guarded. ``recovery_report`` has confirmed ones."""
    return recovery.telemetry(recovery_windows(spark, sf_dir).withColumn("status", F.lit("guarded"))).select("type", "planned", "confirmed", "guarded")


@query("""SELECT conv_id AS call_id, count(*)::BIGINT AS segments, sum(length(trim(regexp_replace(text, '[\\x20\\x09-\\x0D]+', ' ', 'g'))))::BIGINT + count(*)::BIGINT - 1 AS chars FROM conversations GROUP BY conv_id""")
def call_texts(spark, sf_dir):
    segs = T.segments(spark, sf_dir)
    n = segs.groupBy("call_id").agg(F.count(F.lit(1)).alias("segments"))
    return timeline.call_text(segs).select("call_id", F.char_length("text").cast("long").alias("chars")).join(n, "call_id")


@query()
def audio_screening(spark, sf_dir):
    """Signal metrics of made WAV files, one for each nation."""
    ship(spark)

    @pandas_udf("binary")
    def made(keys):
        import numpy as np

        from sparkveil.sources.audio import encode_wav

        wave = lambda k: 0.3 * np.sin(2 * np.pi * (200 + 40 * k) * np.arange(16_000) / 16_000)
        return keys.map(lambda k: encode_wav(wave(k).astype("float32"), 16_000))

    files = table(spark, sf_dir, "nation").select(F.concat(F.lit("nation-"), F.col("n_nationkey")).alias("path"), F.lit("wav").alias("suffix"), made(F.col("n_nationkey").cast("long")).alias("content"))
    rows = audio.audio_metrics(files)
    return rows.select("path", "duration_s", F.col("quality.score").alias("quality"), F.col("stress.level").alias("stress"), F.col("tamper.risk").alias("tamper"), "error")


@query("""SELECT o_orderkey AS call_id, ['general customer support', 'payment commitment', 'repayment difficulty', 'general customer support', 'general customer support'][1 + o_orderkey % 5] AS intent,
  CASE WHEN o_orderkey % 5 = 4 THEN 'high' ELSE 'low' END AS risk_level, [2, 3, 0, 1, 0][1 + o_orderkey % 5]::BIGINT AS facts, [0, 1, 2, 0, 0][1 + o_orderkey % 5]::BIGINT AS obligations, 0::BIGINT AS pii FROM orders""")
def call_analysis(spark, sf_dir):
    """Privacy and understanding of each call in one pass."""
    rows = analyze.analyze_texts(T.collection_calls(spark, sf_dir))
    size = lambda c: F.size(c).cast("long").alias(c)
    return rows.select("call_id", F.col("intent.label").alias("intent"), F.col("regulatory.risk_level").alias("risk_level"), size("facts"), size("obligations"), size("pii"))


@query(f"""SELECT c_custkey AS call_id, concat('My phone number is ', CASE WHEN c_custkey % 3 = 0 AND {T.PHONE} != {T.OTHER} THEN {T.PHONE} ELSE '[PHONE REDACTED]' END, ' [PHONE REDACTED].') AS safe_text FROM customer""")
def corrected_transcripts(spark, sf_dir):
    """Safe segments of timed calls: a number corrected in time is shown, any other hidden."""
    segs, words = _timed_calls(spark, sf_dir, _TWICE)
    return analyze.analyze_calls(segs, words)["segments"].select("call_id", "safe_text")
