"""Protection of a stream of utterances, and counts of what was hidden by time window."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkveil.operators import privacy


def protect_stream(utterances: DataFrame, **options) -> DataFrame:
    """A stream of ``call_id, ts, text`` with ``safe_text`` and the public metadata of its spans; the
    raw text doesn't go on."""
    rows = privacy.protect_documents(utterances, out="_p", **options)
    return rows.select(*[c for c in utterances.columns if c != "text"], F.col("_p.safe_text").alias("safe_text"), privacy.public_spans(F.col("_p.pii")).alias("pii"))


def hidden_by_window(protected: DataFrame, window: str = "10 minutes", late: str = "30 minutes") -> DataFrame:
    """How many spans of each type were hidden in each window; rows later than ``late`` are dropped,
    so the state stays bounded."""
    spans = protected.withWatermark("ts", late).select("ts", F.explode("pii").alias("s"))
    return spans.groupBy(F.window("ts", window).alias("w"), F.col("s.type").alias("type")).agg(F.count(F.lit(1)).alias("hidden")).select(F.col("w.start").alias("start"), "type", "hidden")
