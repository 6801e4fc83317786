"""Safe transcripts: the decisions on a call's text shown segment by segment, and markers for windows
that only the audio protects."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkveil.functions.spans import by_position, greedy, render

#: Which of overlapping replacements wins: markers, personal data, operational identifiers, profanity.
GUARD, PII, OPERATIONAL, PROFANITY = 4, 3, 2, 1
PART = "array<struct<start:int,end:int,new:string,class:int>>"


def replacements(protected: DataFrame, protected_col: str = "protected", bleep: str = "[BLEEP]") -> DataFrame:
    """``call_id, start, end, new, class`` of everything that a protected call hides."""
    p = F.col(protected_col)

    def part(spans: Column, new, class_: int) -> Column:
        return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), new(s).alias("new"), F.lit(class_).alias("class")))

    name = lambda s: F.concat(F.lit("["), s["type"], F.lit(" REDACTED]"))
    parts = F.concat(part(p["pii"], name, PII), part(p["financial_ids"], name, OPERATIONAL), part(p["profanity"], lambda s: F.lit(bleep), PROFANITY))
    return protected.select("call_id", F.explode(parts).alias("x")).select("call_id", "x.*")


def guard_markers(windows: DataFrame, texts: DataFrame) -> DataFrame:
    """``call_id, start, end, new, class`` for windows whose audio is hidden without a known value. A
    natural phrase around the value stays; the comma behind it goes with the value."""
    rows = windows.join(texts, "call_id").withColumn("_raw", F.trim(F.substring(F.col("text"), F.col("char_start") + 1, F.col("char_end") - F.col("char_start"))))
    marker = F.concat(F.lit("["), F.col("type"), F.lit(" AUDIO PROTECTED]"))
    mine = (F.col("source") == "followup_expectation") & F.col("_raw").rlike(r"(?i)^mine\b")
    verb = F.lower(F.regexp_extract("_raw", r"(?i)^i\s+(received|got)\b", 1))
    phrase = mine | (verb != "")
    new = F.when(mine, F.concat(F.lit("Mine is "), marker, F.lit("."))).when(verb != "", F.concat(F.lit("I "), verb, F.lit(" "), marker, F.lit("."))).otherwise(marker)
    comma = F.substring(F.col("text"), F.col("char_end") + 1, F.lit(1)) == ","
    end = F.col("char_end") + F.when(phrase & comma, 1).otherwise(0)
    return rows.select("call_id", F.col("char_start").alias("start"), end.cast("int").alias("end"), new.alias("new"), F.lit(GUARD).alias("class")).where("end > start")


def kept_parts(parts: Column) -> Column:
    """Non-overlapping replacements by class, then length, then later start, sorted by place."""
    return by_position(greedy(parts, PART, lambda x: [-x["class"], x["start"] - x["end"], -x["start"]]))


def _array(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col("start").cast("int").alias("start"), F.col("end").cast("int").alias("end"), "new", F.col("class").cast("int").alias("class")))).cast(PART).alias("parts"))


def safe_texts(texts: DataFrame, parts: DataFrame) -> DataFrame:
    """``call_id, safe_text``."""
    rows = texts.join(_array(parts, ["call_id"]), "call_id", "left")
    return rows.select("call_id", F.when(F.col("parts").isNull(), F.col("text")).otherwise(render(F.col("text"), kept_parts(F.col("parts")), lambda x: x["new"])).alias("safe_text"))


def safe_segments(offsets: DataFrame, parts: DataFrame) -> DataFrame:
    """``offsets`` (segments with their place in the call's text) with ``safe_text`` for ``text``. A
    replacement is cut at the segment's ends; a marker is shown where its span begins and hides the
    rest of the span without repeating itself."""
    s, p = offsets.alias("s"), parts.alias("p")
    touch = (F.col("s.call_id") == F.col("p.call_id")) & (F.col("p.start") < F.col("s.char_end")) & (F.col("s.char_start") < F.col("p.end"))
    begins = (F.col("p.start") >= F.col("s.char_start")) & (F.col("p.start") < F.col("s.char_end"))
    local = s.join(p, touch).select(
        "s.call_id", "s.seg_id",
        F.greatest(F.col("p.start") - F.col("s.char_start"), F.lit(0)).alias("start"), F.least(F.col("p.end") - F.col("s.char_start"), F.col("s.char_end") - F.col("s.char_start")).alias("end"),
        F.when((F.col("p.class") == GUARD) & ~begins, F.lit("")).otherwise(F.col("p.new")).alias("new"), "p.class",
    )
    rows = offsets.join(_array(local, ["call_id", "seg_id"]), ["call_id", "seg_id"], "left")
    text = F.coalesce("text", F.lit(""))
    return rows.withColumn("safe_text", F.when(F.col("parts").isNull(), text).otherwise(render(text, kept_parts(F.col("parts")), lambda x: x["new"]))).drop("parts", "text")
