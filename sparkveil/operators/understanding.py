"""Financial facts, obligations, intents and compliance phrases as Catalyst expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from sparkveil.functions import patterns as P
from sparkveil.functions.scalars import due_date
from sparkveil.functions.spans import find, let, ordered, unicode_regex

FACT = "array<struct<type:string,value:string,start:int,end:int,confidence:double,evidence:string>>"


def left_window(text: Column, start: Column, radius: int) -> Column:
    """Up to ``radius`` characters before a position, after the last clause end among them."""
    low = F.greatest(start - radius, F.lit(0))
    return F.regexp_extract(F.substring(text, low + 1, start - low), r"[^.!?\n;]*$", 0)


def says(context: Column, pattern: str) -> Column:
    return context.rlike(unicode_regex(pattern))


def _fact(kind, value: Column, m: Column, confidence, evidence) -> Column:
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.struct(lit(kind).alias("type"), value.alias("value"), m["start"].alias("start"), m["end"].alias("end"), lit(confidence).cast("double").alias("confidence"), lit(evidence).alias("evidence"))


def amount_value(match: Column, pattern: str) -> Column:
    """The number of an amount, without thousands separators."""
    p = unicode_regex(pattern)
    first = F.regexp_extract(match, p, 1)
    return F.replace(F.when(first != "", first).otherwise(F.regexp_extract(match, p, 2)), F.lit(","), F.lit(""))


def _nearest_cue(left: Column) -> Column:
    """The amount type whose cue ends nearest to the amount; of equally near ones the first listed."""
    options = []
    for i, (kind, cue) in enumerate(P.AMOUNT_CUES):
        last = F.array_max(F.transform(find(left, cue), lambda m: m["end"]))
        options.append(F.when(last.isNotNull(), F.struct((F.char_length(left) - last).alias("d"), F.lit(i).alias("i"), F.lit(kind).alias("kind"))))
    return F.array_min(F.array_compact(F.array(*options)))["kind"]


def _amounts(text: Column) -> Column:
    def one(m: Column) -> Column:
        kind = let(left_window(text, m["start"], 60), _nearest_cue)
        value = amount_value(m["value"], P.MONEY)
        return let(F.coalesce(kind, F.lit("MONEY")), lambda k: _fact(k, value, m, F.when(k == "MONEY", 0.94).otherwise(0.97), F.when(k == "MONEY", "currency_structure").otherwise("currency+local_context")))

    return F.transform(find(text, P.MONEY, prefilter=r"[0-9]"), one)


def financial_facts(text: Column) -> Column:
    """Amounts, rates, terms, dates, methods and statuses, sorted by place. Facts of the same type
    never overlap; the stronger type, then the surer and the earlier one stays."""
    text = F.coalesce(text, F.lit(""))
    group = lambda m, p, g: F.regexp_extract(m["value"], unicode_regex(p), g)
    rates = F.transform(find(text, P.RATE_WORD_END, prefilter="[0-9]"), lambda m: _fact(F.when(says(left_window(text, m["start"], 56), P.APR_CUE), "APR").otherwise("INTEREST_RATE"), F.concat(group(m, P.RATE_WORD_END, 1), F.lit("%")), m, 0.96, "rate_structure"))
    terms = F.filter(find(text, P.TENURE, prefilter="[0-9]"), lambda m: says(left_window(text, m["start"], 48), P.TENURE_CUE))
    terms = F.transform(terms, lambda m: _fact("TENURE", F.concat(group(m, P.TENURE, 1), F.lit(" "), F.lower(group(m, P.TENURE, 2))), m, 0.93, "tenure_context"))
    dates = F.filter(find(text, P.FACT_DATE), lambda m: says(left_window(text, m["start"], 52), P.DATE_CUE))
    dates = F.transform(dates, lambda m: _fact(F.when(says(left_window(text, m["start"], 52), P.DUE_CUE), "DUE_DATE").otherwise("PAYMENT_DATE"), m["value"], m, 0.88, "date+payment_context"))
    methods = F.transform(find(text, P.PAYMENT_METHOD), lambda m: _fact("PAYMENT_METHOD", F.upper(m["value"]), m, 0.95, "payment_method_lexicon"))
    statuses = F.transform(find(text, P.PAYMENT_STATUS), lambda m: _fact("PAYMENT_STATUS", F.lower(m["value"]), m, 0.90, "financial_status_lexicon"))
    rank = F.create_map(*[F.lit(x) for pair in P.FACT_PRIORITY.items() for x in pair])

    def keep(found: Column) -> Column:
        ranked = ordered(found, lambda x: [-F.element_at(rank, x["type"]), -x["confidence"], x["start"]])
        clash = lambda acc, x: F.exists(acc, lambda c: (c["type"] == x["type"]) & (x["start"] < c["end"]) & (c["start"] < x["end"]))
        kept = F.aggregate(ranked, F.array().cast(FACT), lambda acc, x: F.when(clash(acc, x), acc).otherwise(F.concat(acc, F.array(x))))
        return ordered(kept, lambda x: [x["start"], x["end"], x["type"]])

    return let(F.concat(_amounts(text), rates, terms, dates, methods, statuses), keep)


def safe_facts(facts: Column) -> Column:
    """Facts without the values of identifying types."""
    hidden = ["FINANCIAL_ACCOUNT_REF", "ACCOUNT_NUMBER", "CARD", "UPI", "PAN", "AADHAAR"]
    return F.transform(facts, lambda x: x.withField("value", F.when(x["type"].isin(hidden), F.concat(F.lit("["), x["type"], F.lit(" REDACTED]"))).otherwise(x["value"])))


def obligations(text: Column, call_date: Column) -> Column:
    """Promises, difficulties, refusals and disputes by sentence. ``call_date`` is the day from which
    due expressions count; without one there would be no repeatable answer."""
    text = F.coalesce(text, F.lit(""))
    first = lambda s, p: F.regexp_extract(s, unicode_regex(p), 0)

    def of_sentence(m: Column) -> Column:
        segment = F.btrim(m["value"], F.lit(" \t\n\x0b\x0c\r"))

        def hits(x: Column) -> Column:
            s = x["s"]
            due, amount = first(s, P.DUE_TERM), first(s, P.DUE_AMOUNT)
            due = F.when(due != "", due)

            def one(kind: str, pattern: str, confidence, extra: bool = False) -> Column:
                hit = first(s, pattern)
                at = x["at"] + F.char_length(F.element_at(F.split(s, unicode_regex(pattern), 2), 1))
                return F.when(
                    hit != "",
                    F.struct(
                        F.lit(kind).alias("type"), hit.alias("evidence"), (due if extra else F.lit(None).cast("string")).alias("due_expression"),
                        (due_date(due, call_date) if extra else F.lit(None).cast("date")).alias("due_date"),
                        (F.when(amount != "", amount_value(amount, P.DUE_AMOUNT)) if extra else F.lit(None).cast("string")).alias("amount"),
                        (confidence if isinstance(confidence, Column) else F.lit(confidence)).cast("double").alias("confidence"), at.cast("int").alias("start"), (at + F.char_length(hit)).cast("int").alias("end"),
                    ),
                )

            promise = F.when(~says(s, P.REFUSAL) & ~says(s, P.CANNOT_PAY), one("PROMISE_TO_PAY", P.PROMISE, F.when(due.isNotNull(), 0.94).otherwise(0.84), True))
            return F.array_compact(F.array(promise, one("REPAYMENT_DIFFICULTY", P.DIFFICULTY, 0.91), one("PAYMENT_REFUSAL", P.REFUSAL, 0.93), one("PAYMENT_OR_DEBT_DISPUTE", P.DISPUTE, 0.92)))

        return let(F.struct(segment.alias("s"), m["start"].alias("at")), hits)

    found = F.flatten(F.transform(F.filter(find(text, P.OBLIGATION_SENTENCE), lambda m: F.btrim(m["value"], F.lit(" \t\n\x0b\x0c\r")) != ""), of_sentence))
    return let(found, lambda f: ordered(f, lambda x: [x["start"]]))


def regulatory(text: Column, require_recording: bool = True) -> Column:
    """``present`` and ``missing`` disclosures, ``risks`` and the ``risk_level`` of a text. Only the
    recording disclosure is ever missing."""
    text = F.coalesce(text, F.lit(""))

    def disclosure(rule: str, severity: str, pattern: str) -> Column:
        p = unicode_regex(pattern)
        hit = F.regexp_extract(text, p, 0)
        at = F.char_length(F.element_at(F.split(text, p, 2), 1))
        return F.when(hit != "", F.struct(F.lit(rule).alias("rule"), F.lit(severity).alias("severity"), F.lit(0.92).alias("confidence"), at.alias("start"), (at + F.char_length(hit)).alias("end")))

    present = F.array_compact(F.array(*[disclosure(*d) for d in P.DISCLOSURES]))
    gap = F.struct(F.lit("recording_disclosure").alias("rule"), F.lit("medium").alias("severity"), F.lit(0.85).alias("confidence"))
    missing = F.when(~says(text, P.DISCLOSURES[0][2]) & F.lit(require_recording), F.array(gap)).otherwise(F.filter(F.array(gap), lambda x: F.lit(False)))
    risks = F.concat(*[_risk(text, *phrase) for phrase in P.RISK_PHRASES])

    def done(r: Column) -> Column:
        level = F.coalesce(F.array_max(F.transform(r, lambda x: F.when(x["severity"] == "high", 3).when(x["severity"] == "medium", 2).otherwise(1))), F.lit(1))
        return F.struct(present.alias("present"), missing.alias("missing"), r.alias("risks"), F.when(level == 3, "high").when(level == 2, "medium").otherwise("low").alias("risk_level"))

    return let(risks, done)


def _risk(text: Column, kind: str, severity: str, confidence: float, pattern: str) -> Column:
    return F.transform(find(text, pattern), lambda m: F.struct(F.lit(kind).alias("type"), F.lit(severity).alias("severity"), F.lit(confidence).alias("confidence"), m["start"].alias("start"), m["end"].alias("end")))


def intent(text: Column) -> Column:
    """The intent with the most keywords in the text, of ties the last by name; none: general."""
    low = F.lower(F.coalesce(text, F.lit("")))

    def hits(t: Column) -> Column:
        scores = [F.struct(reduce(lambda a, b: a + b, [t.contains(k).cast("int") for k in keys]).alias("hits"), F.lit(label).alias("label")) for label, keys in P.INTENTS.items()]
        best = F.array_max(F.array(*scores))
        general = F.struct(F.lit("general customer support").alias("label"), F.lit(0.5).alias("confidence"), F.lit("context_rules").alias("method"), F.lit(0).alias("rule_hits"))
        found = lambda b: F.when(b["hits"] > 0, F.struct(b["label"].alias("label"), F.least(F.lit(0.94), 0.66 + 0.09 * b["hits"]).alias("confidence"), F.lit("context_rules").alias("method"), b["hits"].alias("rule_hits"))).otherwise(general)
        return let(best, found)

    return let(low, hits)


def arbitrate_intent(rule: Column, model: Column, zero_shot: Column | None = None) -> Column:
    """A rule's and a model's intent (struct label, confidence; null without a model): agreement is
    stronger than either, two rule hits beat an unsure model, else the model's stands. Without a model
    a zero-shot classifier's intent, if there is one, stands for the rule's."""
    agreed = F.least(F.lit(0.98), 0.6 * model["confidence"] + 0.4 * rule["confidence"] + 0.05)
    made = lambda label, confidence, method: F.struct(label.alias("label"), confidence.cast("double").alias("confidence"), F.lit(method).alias("method"), rule["rule_hits"].alias("rule_hits"))
    alone = made(rule["label"], rule["confidence"], "context_rules")
    if zero_shot is not None:
        alone = F.when(zero_shot.isNull(), alone).otherwise(made(zero_shot["label"], F.round(zero_shot["confidence"], 4), "zero_shot"))
    return (
        F.when(model.isNull(), alone)
        .when((rule["rule_hits"] > 0) & (rule["label"] == model["label"]), made(model["label"], F.round(agreed, 4), "semantic+rule_agreement"))
        .when((rule["rule_hits"] >= 2) & (model["confidence"] < 0.68), made(rule["label"], rule["confidence"], "strong_rules_over_weak_semantic"))
        .otherwise(made(model["label"], model["confidence"], "semantic"))
    )
