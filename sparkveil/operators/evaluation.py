"""Scoring of detected against expected values, and of transcripts against references."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from sparkveil.functions.scalars import digits
from sparkveil.session import materialize, ship


def score_value(kind: Column, value: Column) -> Column:
    """The form in which scores compare values."""
    numeric = kind.isin("PHONE", "AADHAAR", "CARD", "ACCOUNT_NUMBER", "OTP", "CVV", "PINCODE")
    return F.when(numeric, digits(value)).otherwise(F.trim(F.regexp_replace(F.lower(value), r"(?U)\s+", " ")))


def multiset_counts(expected: DataFrame, found: DataFrame, keys: list[str]) -> DataFrame:
    """``tp, fp, fn`` for each key, comparing (type, value) as multisets: both sides are counted,
    united and summed, one shuffle without a join."""
    one = lambda df, side: df.groupBy(*keys, "type", "value").agg(F.count(F.lit(1)).alias("n")).withColumn("side", F.lit(side))
    both = one(expected, 0).unionByName(one(found, 1)).groupBy(*keys, "type", "value").agg(F.sum(F.when(F.col("side") == 0, F.col("n")).otherwise(0)).alias("e"), F.sum(F.when(F.col("side") == 1, F.col("n")).otherwise(0)).alias("f"))
    return both.groupBy(*keys).agg(F.sum(F.least("e", "f")).alias("tp"), F.sum(F.greatest(F.col("f") - F.col("e"), F.lit(0))).alias("fp"), F.sum(F.greatest(F.col("e") - F.col("f"), F.lit(0))).alias("fn"))


def rates(counts: DataFrame) -> DataFrame:
    """``counts`` with precision and recall (1 without a case) and F1 (0 without one)."""
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    share = lambda a, b, empty: F.when(b > 0, a / b).otherwise(empty)
    out = counts.withColumn("precision", share(tp, tp + fp, 1.0)).withColumn("recall", share(tp, tp + fn, 1.0))
    p, r = F.col("precision"), F.col("recall")
    return out.withColumn("f1", F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0)).withColumn("false_discovery", 1 - p).withColumn("false_negative", 1 - r)


def threshold_sweep(expected: DataFrame, found: DataFrame, thresholds: list[float]) -> DataFrame:
    """Rates at each threshold; a found value is copied for each threshold that it passes."""
    steps = F.array(*[F.lit(t) for t in thresholds])
    e = expected.select("id", "type", "value", F.explode(steps).alias("threshold"))
    f = found.select("id", "type", "value", F.explode(F.filter(steps, lambda t: F.col("confidence") >= t)).alias("threshold"))
    return rates(multiset_counts(e, f, ["threshold"]))


def case_rows(cases: DataFrame) -> DataFrame:
    """``id, tp, fp, fn, negative, leaked, passed`` of each case: ``cases`` has id, ``expected`` and
    ``found`` (arrays of structs type, value) and ``safe_text``. The two are compared as multisets; a
    case leaks if an expected value stands in its safe text."""

    def keys(spans: Column) -> Column:
        return F.transform(spans, lambda x: F.struct(x["type"].alias("type"), score_value(x["type"], x["value"]).alias("value")))

    rows = cases.select("id", "expected", "safe_text", keys(F.col("expected")).alias("e"), keys(F.col("found")).alias("f"))
    times = lambda xs, k: F.size(F.filter(xs, lambda x: x == k))
    both = F.aggregate(F.array_distinct("e"), F.lit(0), lambda n, k: n + F.least(times(F.col("e"), k), times(F.col("f"), k)))
    leaked = F.exists("expected", lambda x: F.contains(F.col("safe_text"), x["value"]))
    rows = rows.select("id", both.alias("tp"), F.size("e").alias("_e"), F.size("f").alias("_f"), leaked.alias("leaked"))
    out = rows.select("id", "tp", (F.col("_f") - F.col("tp")).alias("fp"), (F.col("_e") - F.col("tp")).alias("fn"), (F.col("_e") == 0).alias("negative"), "leaked")
    return out.withColumn("passed", (F.col("fp") == 0) & (F.col("fn") == 0) & ~F.col("leaked"))


def case_summary(rows: DataFrame) -> DataFrame:
    """One row: the sums and rates of ``case_rows``, the share of negative cases with a false find, and
    the cases that leak."""
    count = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0).cast("long"))
    hit = F.col("negative") & (F.col("fp") > 0)
    sums = rows.agg(count(F.col("tp")).alias("tp"), count(F.col("fp")).alias("fp"), count(F.col("fn")).alias("fn"), count(F.col("negative")).alias("negative_cases"), count(hit).alias("negative_cases_with_fp"), count(F.col("leaked")).alias("mask_failure_cases"))
    rate = F.when(F.col("negative_cases") > 0, F.col("negative_cases_with_fp") / F.col("negative_cases")).otherwise(0.0)
    return rates(sums).withColumn("negative_case_false_positive_rate", rate)


def nearest_rank(values: DataFrame, column: str, shares: list[float]) -> DataFrame:
    """Percentiles by nearest rank: the value at position round((n - 1) * share) of the order.

    The values are counted, and the distinct ones dealt out by ranges. Each range finds its sum; the
    sums of the ranges, one row for each task, give every range its first position, and only ranges
    that hold a wanted position are numbered.
    """
    counts = values.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("v")).agg(F.count(F.lit(1)).alias("c"))
    ranges = materialize(counts.repartitionByRange("v").withColumn("part", F.spark_partition_id()), "ranks")
    sums = ranges.groupBy("part").agg(F.sum("c").alias("n")).orderBy("part").collect()  # a row for each task
    total, at, wanted = sum(r["n"] for r in sums), 0, []
    places = {s: round((total - 1) * s) for s in shares} if total else {}
    for r in sums:
        wanted += [(r["part"], s, k - at) for s, k in places.items() if at <= k < at + r["n"]]
        at += r["n"]
    spark = values.sparkSession
    ranks = spark.createDataFrame(wanted, "part int, share double, rank long")
    inside = Window.partitionBy("part").orderBy("v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    upto = ranges.join(F.broadcast(ranks.select("part").distinct()), "part", "left_semi").withColumn("hi", F.sum("c").over(inside))  # a row for each share
    hit = (F.col("hi") > F.col("rank")) & (F.col("hi") - F.col("c") <= F.col("rank"))
    return upto.join(F.broadcast(ranks), "part").where(hit).select("share", F.col("v").alias("value"))


def word_errors(reference: Column, heard: Column) -> Column:
    """Word error rate: edits between the words, in lower case, by the reference's length (at least 1)."""

    @pandas_udf("double")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for refs, hyps in batches:
            yield pd.Series([word_error_rate(r or "", h or "") for r, h in zip(refs, hyps)])

    return run(reference, heard)


def word_error_rate(reference: str, heard: str) -> float:
    ref, hyp = (re.findall(r"[\w@.+-]+", t.casefold()) for t in (reference, heard))
    row = list(range(len(hyp) + 1))
    for i, a in enumerate(ref, 1):
        before, row[0] = row[0], i
        for j, b in enumerate(hyp, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (a != b))
    return row[-1] / max(1, len(ref))


def interval_coverage(gold: DataFrame, found: DataFrame, keys: list[str] = ["call_id"]) -> DataFrame:  # noqa: B006
    """``gold`` intervals with ``covered``, the largest share of one that a found interval of the
    same type covers."""
    g, f = gold.alias("g"), found.alias("f")
    shared = F.least("g.end", "f.end") - F.greatest("g.start", "f.start")
    on = (shared > 0) & F.array_contains("f.types", F.col("g.type"))
    for k in keys:
        on = on & (F.col(f"g.{k}") == F.col(f"f.{k}"))
    span = F.col("g.end") - F.col("g.start")
    cols = [F.col(f"g.{c}") for c in gold.columns]
    return g.join(f, on, "left").groupBy(*cols).agg(F.coalesce(F.max(F.when(span > 0, shared / span)), F.lit(0.0)).alias("covered"))


def entity_key(value: Column) -> Column:
    """The form in which a manifest's values are compared: lower-case letters and digits."""
    return F.regexp_replace(F.lower(F.coalesce(value, F.lit(""))), "[^a-z0-9]+", "")


def manifest_rows(manifest: DataFrame, results: DataFrame) -> DataFrame:
    """Each row of a manifest (id, transcript, pii, profanity, gold_intervals) against the result of its
    call (id, text, pii and profanity as structs type, value, token_ids, intervals as structs types,
    start, end, and real_time_factor): ``id, wer, pii_tp, pii_fp, pii_fn, profanity_tp, profanity_fp,
    profanity_fn, alignment_coverage, redaction_coverage, real_time_factor``.

    Without a transcript there is no word error rate, and without gold intervals no coverage.
    """
    ship(manifest.sparkSession)
    r = results.select(*[F.col(c).alias(f"_{c}") for c in ("id", "text", "pii", "profanity", "intervals", "real_time_factor")])
    rows = manifest.join(r, F.col("id") == F.col("_id"), "left")
    none = lambda c, kind: F.coalesce(F.col(c), F.array().cast(kind))
    pair = lambda x: F.concat(F.upper(x["type"]), F.lit(":"), entity_key(x["value"]))
    value = lambda kind: f"array<struct<type:string,value:string{kind}>>"
    gold, own = F.transform(none("pii", value("")), pair), F.transform(none("_pii", value(",token_ids:array<int>")), pair)
    gold_rude, own_rude = F.transform(none("profanity", "array<string>"), entity_key), F.transform(none("_profanity", value("")), lambda x: entity_key(x["value"]))

    def common(a: Column, b: Column) -> Column:
        times = lambda xs, k: F.size(F.filter(xs, lambda x: x == k))
        return F.aggregate(F.array_distinct(a), F.lit(0), lambda n, k: n + F.least(times(a, k), times(b, k)))

    def covered(g: Column) -> Column:
        size = F.greatest(g["end"] - g["start"], F.lit(1e-6))
        fits = F.filter("_intervals", lambda p: g["type"].isNull() | (g["type"] == "") | F.array_contains(p["types"], g["type"]))
        best = F.aggregate(fits, F.lit(0.0), lambda m, p: F.greatest(m, F.least(g["end"], p["end"]) - F.greatest(g["start"], p["start"])))
        return F.least(F.lit(1.0), best / size)

    mean = lambda xs: F.aggregate(xs, F.lit(0.0), lambda n, x: n + x) / F.size(xs)
    aligned = F.size(F.filter("_pii", lambda x: F.size(x["token_ids"]) > 0))
    counts = lambda kind, tp, a, b: [tp.alias(f"{kind}_tp"), (F.size(b) - tp).alias(f"{kind}_fp"), (F.size(a) - tp).alias(f"{kind}_fn")]
    return rows.select(
        "id",
        F.when(F.coalesce("transcript", F.lit("")) != "", F.round(word_errors(F.col("transcript"), F.col("_text")), 4)).alias("wer"),
        *counts("pii", common(gold, own), gold, own),
        *counts("profanity", common(gold_rude, own_rude), gold_rude, own_rude),
        F.round(F.when(F.coalesce(F.size("_pii"), F.lit(0)) > 0, aligned / F.size("_pii")).otherwise(1.0), 4).alias("alignment_coverage"),
        F.round(F.when(F.coalesce(F.size("gold_intervals"), F.lit(0)) > 0, F.coalesce(mean(F.transform("gold_intervals", covered)), F.lit(0.0))), 4).alias("redaction_coverage"),
        F.col("_real_time_factor").alias("real_time_factor"),
    )


def manifest_summary(rows: DataFrame) -> DataFrame:
    """One row of totals and means over ``manifest_rows``, with precision, recall and F1 of both kinds
    (0 without a case, as a report of means has it)."""
    sums = [F.coalesce(F.sum(f"{k}_{c}"), F.lit(0)).cast("long").alias(f"{k}_{c}") for k in ("pii", "profanity") for c in ("tp", "fp", "fn")]
    means = [F.avg(c).alias(f"mean_{c}") for c in ("wer", "real_time_factor", "alignment_coverage", "redaction_coverage")]
    out = rows.agg(*sums, *means)
    for k in ("pii", "profanity"):
        tp, fp, fn = (F.col(f"{k}_{c}") for c in ("tp", "fp", "fn"))
        p, r = tp / F.greatest(F.lit(1), tp + fp), tp / F.greatest(F.lit(1), tp + fn)
        out = out.withColumns({f"{k}_precision": p, f"{k}_recall": r, f"{k}_f1": 2 * p * r / F.greatest(F.lit(1e-9), p + r)})
    return out


def prototype_score(vector: Column, positives: list[list[float]], negatives: list[list[float]]) -> Column:
    """How much nearer a vector is, by cosine, to its best positive than to its best negative
    prototype, through a logistic of slope 10."""
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda n, x: n + x.cast("double") * x))

    def cosine(p: list[float]) -> Column:
        own = F.array(*[F.lit(float(x)) for x in p])
        size = sum(x * x for x in p) ** 0.5
        dot = F.aggregate(F.zip_with(vector, own, lambda a, b: a.cast("double") * b), F.lit(0.0), lambda n, x: n + x)
        return dot / F.greatest(norm(vector) * F.lit(size), F.lit(1e-12))

    best = lambda ps: F.greatest(*[cosine(p) for p in ps], F.lit(-1.0)) if ps else F.lit(0.0)
    margin = best(positives) - best(negatives)
    return F.round(1 / (1 + F.exp(-10 * margin)), 4)
