"""Detection and protection of texts as DataFrame operations.

The span engine needs look-around, overlapping scans and edit similarity that Catalyst lacks, so it
runs in an Arrow batch, once per text; everything around it (filters, joins, aggregation) is native.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from sparkveil.functions import engine
from sparkveil.functions import patterns as P
from sparkveil.session import ship

SPAN = "struct<type:string,start:int,end:int,value:string,confidence:double,evidence:string,canonical:string,ownership:int,authority:int,partial:boolean,ai_review:boolean,ner_review:boolean,method:string>"
SPANS = f"array<{SPAN}>"
SWEAR = "struct<type:string,category:string,severity:int,start:int,end:int,value:string,canonical:string,confidence:double,evidence:string>"
PROTECTED = f"struct<safe_text:string,pii:{SPANS},financial_ids:{SPANS},profanity:array<{SWEAR}>,threshold:double>"


def _row(x: engine.Span) -> dict:
    return {
        "type": x.type, "start": x.start, "end": x.end, "value": x.value, "confidence": round(x.confidence, 3), "evidence": x.evidence, "canonical": x.canonical,
        "ownership": x.ownership, "authority": x.authority, "partial": x.partial, "ai_review": x.ai_review, "ner_review": x.ner_review, "method": x.method or "deterministic",
    }


def _swear(x: engine.Span, severity: int) -> dict:
    return {"type": x.type, "category": "abusive_language", "severity": severity, "start": x.start, "end": x.end, "value": x.value, "canonical": x.canonical, "confidence": x.confidence, "evidence": x.evidence}


def detect_spans(text: Column, profile: str = "balanced", threshold: float | None = None, review=None) -> Column:
    """Resolved spans of personal data and credentials. A null text has none."""
    least = P.PROFILES[profile] if threshold is None else threshold

    @pandas_udf(SPANS)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield texts.map(lambda t: [_row(x) for x in engine.detect(t, least, review)])

    return run(F.coalesce(text, F.lit("")))


def protect(text: Column, **options) -> Column:
    """``safe_text`` and the spans behind it; ``options`` are those of ``engine.protect``. A null text
    is protected as an empty one."""

    @pandas_udf(PROTECTED)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            done = [engine.protect(t, **options) for t in texts]
            yield pd.DataFrame(
                {
                    "safe_text": [d["safe_text"] for d in done],
                    "pii": [[_row(x) for x in d["pii"]] for d in done],
                    "financial_ids": [[_row(x) for x in d["financial_ids"]] for d in done],
                    "profanity": [[_swear(*x) for x in d["profanity"]] for d in done],
                    "threshold": [d["threshold"] for d in done],
                }
            )

    return run(F.coalesce(text, F.lit("")))


def detect(df: DataFrame, text_col: str = "text", out: str = "pii", **kw) -> DataFrame:
    ship(df.sparkSession)
    return df.withColumn(out, detect_spans(F.col(text_col), **kw))


def protect_documents(df: DataFrame, text_col: str = "text", out: str = "protected", **options) -> DataFrame:
    ship(df.sparkSession)
    return df.withColumn(out, protect(F.col(text_col), **options))


def public_spans(spans: Column) -> Column:
    """Spans without the values they hide."""
    return F.transform(spans, lambda s: F.struct(s["type"].alias("type"), s["start"].alias("start"), s["end"].alias("end"), s["confidence"].alias("confidence"), s["evidence"].alias("evidence"), s["method"].alias("decision_method"), F.concat(F.lit("["), s["type"], F.lit(" REDACTED]")).alias("masked_value")))


def stated(spans: Column) -> Column:
    """Spans of the values that a text ends up with: a value that a repair only says once more counts
    once. For lists of values, not for hiding them, which needs all spans."""
    return F.filter(spans, lambda s: ~s["evidence"].endswith(engine.RESTATED))


def mean_confidence(spans: Column) -> Column:
    """The mean over the spans; 1 if there are none."""
    total = F.aggregate(spans, F.lit(0.0), lambda n, s: n + s["confidence"])
    return F.when(F.size(spans) == 0, 1.0).otherwise(total / F.size(spans))


def trust(asr: Column, quality: Column, intent: Column, pii: Column) -> Column:
    """The weighted confidence of a call, between 0 and 1."""
    return F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), 0.48 * asr + 0.22 * quality + 0.18 * intent + 0.12 * pii)), 3)


def register(spark: SparkSession) -> None:
    """``detect_pii(text)`` and ``protect_text(text)`` for SQL."""
    ship(spark)

    @pandas_udf(SPANS)
    def detect_pii(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [_row(x) for x in engine.detect(t or "")])

    @pandas_udf("string")
    def protect_text(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: engine.protect(t or "")["safe_text"])

    spark.udf.register("detect_pii", detect_pii)
    spark.udf.register("protect_text", protect_text)
