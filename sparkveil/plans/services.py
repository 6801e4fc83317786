"""Queries over sources and sinks, models as providers, SQL functions and lost values of every type."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from sparkveil.functions import scalars
from sparkveil.operators import evaluation, privacy, providers, recovery, rendering, timeline
from sparkveil.plans import transcripts as T
from sparkveil.plans.calls import _calls, _spans, _texts_sql, _waves
from sparkveil.plans.register import query
from sparkveil.plans.sentences import FIELDS, IDS, by_key, made, said
from sparkveil.session import drop_path, materialize, shared_path, ship, table
from sparkveil.sources import audio, cases

# ---- labels that no value follows ----

_LABELS = [
    ("My registered name is 22.", "NAME"), ("Call me on noise.", "PHONE"), ("My work email is lost.", "EMAIL"), ("My PAN number is lost.", "PAN"), ("My aadhar is lost.", "AADHAAR"), ("My bank IFSC is lost.", "IFSC"), ("My UPI id is lost.", "UPI"),
    ("My debit card is lost.", "CARD"), ("The CVV on my card is lost.", "CVV"), ("My verification code is lost.", "OTP"), ("My bank account is lost.", "ACCOUNT_NUMBER"), ("My zip code is lost.", "PINCODE"), ("My birth date is lost.", "DOB"),
    ("My passport is lost.", "PASSPORT"), ("My dl number is lost.", "DRIVING_LICENSE"), ("My voter id is lost.", "VOTER_ID"), ("My billing address is lost.", "ADDRESS"), ("My passport is not available.", None), ("The weather is lost.", None),
    ("Please tell me your OTP. It is lost.", "OTP"), ("Please tell me your OTP. Lost it.", None), ("Please tell me your OTP. I have none, sorry.", "OTP"),
]


@query("\nUNION ALL ".join(f"SELECT c_custkey AS call_id, '{kind}' AS type, '{'followup_expectation' if text.startswith('Please') else 'owned_field'}' AS source FROM customer WHERE c_custkey % {len(_LABELS)} = {i}" for i, (text, kind) in enumerate(_LABELS) if kind))
def lost_values(spark, sf_dir):
    """Windows for every type whose label was understood and whose value was not."""
    segs, words = _calls(spark, sf_dir, _texts_sql([t for t, _ in _LABELS]))
    texts = timeline.call_text(segs)
    return recovery.plan_recovery(texts, materialize(_spans(texts), "label-spans"), timeline.word_map(segs, words)).select("call_id", "type", "source")


_RISKY = "My CVV is lost. My OTP is lost. My PAN is lost. My name is 22. My phone is lost. My address is lost."


@query("SELECT c_custkey AS call_id, t.type, t.place::INT AS place FROM customer, (VALUES ('CVV', 1), ('OTP', 2), ('PAN', 3), ('PHONE', 4)) t(type, place)")
def riskiest_windows(spark, sf_dir):
    """Of six windows of a call the four riskiest, in their order."""
    segs, words = _calls(spark, sf_dir, f"'{_RISKY}'")
    texts = timeline.call_text(segs)
    none = said(spark, sf_dir, "''").limit(0).select("call_id", F.lit("").alias("type"), F.lit(0).alias("start"), F.lit(0).alias("end"))
    return recovery.plan_recovery(texts, none, timeline.word_map(segs, words)).select("call_id", "type", F.col("rank").alias("place"))


@query("""SELECT c_custkey AS call_id, concat('My OTP is [OTP REDACTED], the transaction id is [TRANSACTION_ID REDACTED]. What a [BLEEP] day.') AS safe_text FROM customer""")
def safe_texts(spark, sf_dir):
    """Whole safe texts from replacements of all classes."""
    rows = privacy.protect_documents(said(spark, sf_dir, made("My OTP is {d6}, the transaction id is TXN{d6}. What a sh1t day.")), ids=True)
    rows = materialize(rows, "safe-decided")
    return rendering.safe_texts(rows.select("call_id", "text"), rendering.replacements(rows))


# ---- values ----

_FORMS = [
    ("PHONE", "98 76-{d4}", "concat('9876', {d4})"), ("PAN", " abc-{d4} f", "concat('abc', {d4}, 'f')"), ("EMAIL", "A {k} @B.in", "concat('a', {k}, '@b.in')"), ("NAME", "  Asha   O+Rao, {k}!", "concat('asha o+rao ', {k})"), ("OTP", "none", "'none'"),
]


@query("\nUNION ALL ".join(f"SELECT c_custkey AS id, '{kind}' AS type, {form.format(**FIELDS)} AS norm FROM customer WHERE c_custkey % {len(_FORMS)} = {i}" for i, (kind, _, form) in enumerate(_FORMS)))
def value_forms(spark, sf_dir):
    """The form in which two values of a type are compared."""
    kind = "CASE call_id % 5 " + " ".join(f"WHEN {i} THEN '{k}'" for i, (k, _, _) in enumerate(_FORMS)) + " END"
    rows = said(spark, sf_dir, by_key([(v, []) for _, v, _ in _FORMS])).withColumn("type", F.expr(kind))
    return rows.select(F.col("call_id").alias("id"), "type", scalars.normal_value(F.col("type"), F.col("text")).alias("norm"))


@query("""SELECT c_custkey AS id, CASE c_custkey % 3 WHEN 0 THEN concat('HDFC0', lpad(cast(c_custkey % 1000000 as varchar(6)), 6, '0')) WHEN 1 THEN 'ICIC0123456' END AS canonical FROM customer""")
def canonical_codes(spark, sf_dir):
    """Bank codes with and without separators, and what is none."""
    text = by_key([("{ifsc}", []), ("icic 0-12 34.56", []), ("HDFC1{six}", [])])
    return said(spark, sf_dir, text).select(F.col("call_id").alias("id"), scalars.canonical_ifsc(F.col("text")).alias("canonical"))


# ---- models ----

_JUDGED = ["The code {pan} appears here.", "I live at {day} Lake Road, Pune.", "My name is {first} Rao.", "The payment used {card} yesterday."]


@query("""SELECT c_custkey AS call_id, ['PAN', 'ADDRESS', 'NAME', 'CARD'][1 + c_custkey % 4] AS type, [0.86, 0.945, 0.995, 0.97][1 + c_custkey % 4]::DOUBLE AS confidence, ['hybrid_semantic_batched', 'hybrid_semantic_batched', 'deterministic', 'hybrid_semantic_batched'][1 + c_custkey % 4] AS method FROM customer""")
def model_fusion(spark, sf_dir):
    """Candidates whose confidence models change: a semantic score of .9, and a name model that supports
    names with .9 and others too little to count."""
    review = providers.with_models(lambda text, spans: [0.9] * len(spans), lambda text, spans: [0.5 if x.type != "NAME" else 0.9 for x in spans])
    rows = privacy.detect(said(spark, sf_dir, by_key([(t, []) for t in _JUDGED])), review=review).select("call_id", F.explode("pii").alias("s"))
    return rows.select("call_id", "s.type", "s.confidence", "s.method")


@query("""SELECT c_custkey AS call_id, c_custkey % 4 IN (0, 3) AS shown FROM customer""")
def model_vetoes(spark, sf_dir):
    """A semantic score of 0 takes a weak candidate away, and leaves those that asked for no view."""
    texts = ["I live at {day} Lake Road, Pune.", "The payment used {card} yesterday.", "My name is {first} Rao.", "I live at {day} Lake Road, Pune."]
    review = providers.with_models(lambda text, spans: [0.0 if "payment" in text else None for _ in spans])
    rows = privacy.detect(said(spark, sf_dir, by_key([(t, []) for t in texts])), review=review)
    return rows.select("call_id", (F.exists("pii", lambda s: s["type"] == "ADDRESS")).alias("shown"))


@query("SELECT c_custkey AS call_id, concat('My OTP is [OTP REDACTED].') AS safe_text, 'OTP' AS type FROM customer")
def sql_functions(spark, sf_dir):
    """The functions that SQL gets."""
    privacy.register(spark)
    rows = said(spark, sf_dir, made("My OTP is {d6}."))
    return rows.select("call_id", F.expr("protect_text(text)").alias("safe_text"), F.expr("detect_pii(text)[0].type").alias("type"))


@query("""WITH c AS (SELECT c_custkey % 9 AS k, c_custkey % 18 AS m FROM customer), x AS (
SELECT CASE k WHEN 0 THEN 'TRANSACTION_ID' WHEN 1 THEN 'TRANSACTION_ID' WHEN 2 THEN 'LOAN_ID' WHEN 3 THEN 'CUSTOMER_ID' WHEN 4 THEN 'APPLICATION_ID' END AS type, (m NOT IN (2, 3))::INT AS tp, (m = 2)::INT AS fp, (m = 3)::INT AS fn FROM c WHERE k < 5
UNION ALL SELECT 'COMPLAINT_ID', 2, 0, 0 FROM c WHERE k = 5 UNION ALL SELECT 'CUSTOMER_ID', 0, 1, 0 FROM c WHERE m = 3)
SELECT type AS kind, sum(tp)::BIGINT AS tp, sum(fp)::BIGINT AS fp, sum(fn)::BIGINT AS fn, round(sum(tp) / (sum(tp) + sum(fp)), 6) AS precision, round(sum(tp) / (sum(tp) + sum(fn)), 6) AS recall FROM x GROUP BY type""")
def identifier_scores(spark, sf_dir):
    """Operational identifiers against a gold standard that lacks some and has others wrong."""
    rows = privacy.protect_documents(said(spark, sf_dir, by_key(IDS)), ids=True).select("call_id", F.explode("protected.financial_ids").alias("s"))
    found = rows.select(F.col("s.type").alias("kind"), "s.type", F.concat_ws(":", "call_id", "s.value").alias("value"))
    wrong = F.when(F.col("call_id") % 18 == 3, F.concat("value", F.lit("x"))).otherwise(F.col("value"))
    gold = rows.select("call_id", F.col("s.type").alias("kind"), "s.type", F.concat_ws(":", "call_id", "s.value").alias("value")).where("call_id % 18 != 2").withColumn("value", wrong).drop("call_id")
    out = evaluation.rates(evaluation.multiset_counts(gold, found, ["kind"]))
    return out.select("kind", "tp", "fp", "fn", F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"))


# ---- files ----


@query("SELECT concat('nation-', n_nationkey) AS name, 1.0::DOUBLE AS duration_s, [1.0, 0.0][1 + n_nationkey % 2]::DOUBLE AS silence_ratio FROM nation")
def audio_files(spark, sf_dir):
    """Protected files written under a folder, found there again and analysed."""
    folder = shared_path(spark, "audio-files")
    whole = audio.protect_audio(_waves(spark, sf_dir).withColumn("intervals", F.expr("slice(array(named_struct('start', 0.0D, 'end', 0.0D)), 1, 0)")))
    audio.write_protected(whole, folder if "://" in folder else "file://" + folder).select("protected_path").write.format("noop").mode("overwrite").save()
    metrics = materialize(audio.audio_metrics(audio.read_audio(spark, folder)), "audio-metrics")
    drop_path(spark, folder)
    return metrics.select(F.regexp_extract("path", r"(nation-\d+)-[0-9a-f]{16}\.protected\.wav$", 1).alias("name"), "duration_s", "quality.silence_ratio")


@query("SELECT concat('nation-', n_nationkey) AS path, 16000::BIGINT AS samples, true AS level FROM nation")
def resampled_audio(spark, sf_dir):
    """A second of a steady level at 8 kHz, in two channels, becomes a second at 16 kHz in one."""
    ship(spark)

    @pandas_udf("struct<samples:bigint,level:boolean>")
    def heard(keys):
        import io
        import wave

        import numpy as np
        import pandas as pd

        rows = []
        for _ in keys:
            out = io.BytesIO()
            with wave.open(out, "wb") as w:
                w.setnchannels(2)
                w.setsampwidth(2)
                w.setframerate(8_000)
                w.writeframes(np.tile(np.array([8192, 16384], "<i2"), 8_000).tobytes())
            x = audio.load(out.getvalue(), "wav")
            rows.append((len(x), bool(np.allclose(x, 0.375, atol=1e-3))))
        return pd.DataFrame(rows, columns=["samples", "level"])

    rows = table(spark, sf_dir, "nation").select(F.concat(F.lit("nation-"), F.col("n_nationkey")).alias("path"), heard("n_nationkey").alias("h"))
    return rows.select("path", "h.samples", "h.level")


@query(f"SELECT cast(c_custkey AS VARCHAR) AS id, length(text)::BIGINT AS raw_chars, sha256(text) AS raw_sha256, changed FROM (SELECT c_custkey, {T.UTTERANCE_SQL} AS text, {T.TYPE_SQL} IS NOT NULL AS changed FROM customer)")
def debug_bundles(spark, sf_dir):
    """Bundles hold safe texts, and of raw texts their lengths and digests."""
    root = shared_path(spark, "debug")
    rows = privacy.protect_documents(T.utterances(spark, sf_dir)).select(F.col("call_id").cast("string").alias("id"), F.col("text").alias("raw"), F.col("protected.safe_text").alias("safe"))
    path = cases.write_bundle(rows, root, "1", "raw", "safe")
    out = materialize(spark.read.json(path).select("id", "raw_chars", "raw_sha256", "changed"), "bundle-rows")
    drop_path(spark, root)
    return out


@query("""SELECT * FROM (VALUES ('a', '"1"', '"2"'), ('b', '"1"', NULL), ('model:asr', NULL, '"3"')) t(name, before, now)""")
def version_drift(spark, sf_dir):
    """Versions of packages and models that differ from those of the run before."""
    return cases.fingerprint_drift(spark, {"a": "1", "b": "1", "same": "5"}, {"a": "2", "same": "5", "model:asr": "3"})


@query("SELECT conv_id AS call_id, turn AS seg_id, CASE WHEN length(trim(regexp_replace(text, '[\\x20\\x09-\\x0D]+', ' ', 'g'))) < 3 THEN 'unknown' ELSE 'en' END AS code, CASE WHEN length(trim(regexp_replace(text, '[\\x20\\x09-\\x0D]+', ' ', 'g'))) < 3 THEN 0.0 ELSE 0.5 END::DOUBLE AS raw_score FROM conversations")
def language_hints(spark, sf_dir):
    """A language identifier's view of each segment; texts under three characters have none."""
    rows = providers.language_hints(T.segments(spark, sf_dir), lambda text: ("en", 0.5))
    return rows.select("call_id", "seg_id", "text_language.code", "text_language.raw_score")


@query("""WITH t AS (SELECT c_custkey AS call_id, c_custkey % 4 AS k FROM customer)
SELECT call_id, [0, 1, 3, 0][1 + k]::INT AS n, ['', 'NAME:0-8', 'NAME:0-4,NAME:5-8,ADDRESS:9-13', ''][1 + k] AS found FROM t""")
def model_tokens(spark, sf_dir):
    """A name model's labels of tokens, grouped to proposals."""
    labelled = [[(0, 4, "O", 0.9)], [(0, 4, "B-GIVENNAME", 0.9), (5, 8, "I-SURNAME", 0.7)], [(0, 4, "B-GIVENNAME", 0.9), (5, 8, "B-SURNAME", 0.7), (9, 13, "I-CITY", 0.8)], [(3, 3, "B-CITY", 0.9)]]

    @pandas_udf("array<struct<type:string,start:int,end:int>>")
    def grouped(keys):
        return keys.map(lambda k: [{"type": t, "start": s, "end": e} for t, s, e, _ in providers.grouped_entities(labelled[k % 4])])

    ship(spark)
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("call_id"), grouped("c_custkey").alias("g"))
    names = F.transform("g", lambda x: F.concat(x["type"], F.lit(":"), x["start"].cast("string"), F.lit("-"), x["end"].cast("string")))
    return rows.select("call_id", F.size("g").alias("n"), F.array_join(names, ",").alias("found"))


@query("""WITH p AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id < 5), c AS (SELECT v.vec_id, p.vec_id AS k, list_cosine_similarity(v.embedding::DOUBLE[], p.e) AS c FROM embeddings v CROSS JOIN p),
s AS (SELECT a.vec_id, a.k, round(1 / (1 + exp(-10 * (a.c - max(b.c)))), 4) AS score FROM c a JOIN c b ON b.vec_id = a.vec_id AND b.k != a.k AND b.k < 4 WHERE a.k < 4 GROUP BY a.vec_id, a.k, a.c),
r AS (SELECT vec_id, list({score: score, k: k} ORDER BY score DESC, k DESC) AS l FROM s GROUP BY vec_id),
t AS (SELECT a.vec_id, round(1 / (1 + exp(-10 * (a.c - b.c))), 4) AS tone FROM c a JOIN c b ON b.vec_id = a.vec_id WHERE a.k = 4 AND b.k = 0)
SELECT r.vec_id, concat('intent ', l[1].k) AS label, greatest(0.45, least(0.97, 0.58 * l[1].score + 0.42 * least(1, greatest(0, 0.5 + (l[1].score - l[2].score))))) > 0.7 AS sure, round(l[1].score - l[2].score, 4) AS runner_up_margin, concat('intent ', l[2].k) AS second,
  tone, CASE WHEN tone >= 0.78 THEN 'high' WHEN tone >= 0.6 THEN 'medium' ELSE 'low' END AS level FROM r JOIN t ON t.vec_id = r.vec_id""")
def utterance_scores(spark, sf_dir):
    """Intents and tone of vectors, from made examples."""
    emb = table(spark, sf_dir, "embeddings")
    known = {r["vec_id"]: list(r["embedding"]) for r in emb.where("vec_id < 5").collect()}  # five examples
    rows = emb.select("vec_id", providers.utterance(F.col("embedding"), {f"intent {i}": [known[i]] for i in range(4)}, ([known[4]], [known[0]])).alias("u"))
    return rows.select("vec_id", "u.intent.label", (F.col("u.intent.confidence") > 0.7).alias("sure"), "u.intent.runner_up_margin", F.col("u.intent.alternatives")[0]["label"].alias("second"), F.col("u.abusive_tone.score").alias("tone"), "u.abusive_tone.level")


@query("""SELECT c_custkey AS id, ['payment commitment', 'fraud report', 'payment commitment', 'loan enquiry', 'general customer support'][1 + c_custkey % 5] AS label, ['semantic+rule_agreement', 'semantic', 'strong_rules_over_weak_semantic', 'zero_shot', 'context_rules'][1 + c_custkey % 5] AS method,
  [0.83, 0.9, 0.84, 0.7, 0.5][1 + c_custkey % 5]::DOUBLE AS confidence FROM customer""")
def intent_arbitration(spark, sf_dir):
    """A rule's intent against a semantic model's, and a zero-shot classifier's where there is none."""
    from sparkveil.operators import understanding

    texts = ["I will pay.", "I will pay.", "I will pay, pay tomorrow.", "Hello.", "Hello."]
    rows = said(spark, sf_dir, by_key([(t, []) for t in texts])).withColumn("k", F.col("call_id") % 5)
    made_ = lambda label, p: F.struct(F.lit(label).alias("label"), F.lit(p).alias("confidence"))
    model = F.when(F.col("k") == 0, made_("payment commitment", 0.8)).when(F.col("k") == 1, made_("fraud report", 0.9)).when(F.col("k") == 2, made_("fraud report", 0.6))
    zero = F.when(F.col("k") == 3, made_("loan enquiry", 0.7))
    out = rows.select("call_id", understanding.arbitrate_intent(understanding.intent(F.col("text")), model, zero).alias("i"))
    return out.select(F.col("call_id").alias("id"), "i.label", "i.method", F.round("i.confidence", 4).alias("confidence"))
