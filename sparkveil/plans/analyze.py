"""Whole analyses: of texts alone, and of timed calls."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, fields

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkveil.operators import privacy, recovery, rendering, timeline, understanding
from sparkveil.session import materialize


def flag(raw: str) -> bool:
    """Whether a setting says yes."""
    low = raw.strip().lower()
    if low not in ("1", "true", "yes", "on", "0", "false", "no", "off", ""):
        raise ValueError(f"neither yes nor no: {raw!r}")
    return low in ("1", "true", "yes", "on")


@dataclass(frozen=True)
class Options:
    """What an analysis hides and adds."""

    profile: str = "balanced"
    mode: str = "full"
    types: frozenset[str] | None = None
    swears: bool = True
    ids: bool = False
    raw_facts: bool = False
    windows: int = recovery.MAX_WINDOWS
    conservative_guard: bool = True
    review: Callable | None = None

    @classmethod
    def from_env(cls, env: Mapping[str, str], prefix: str = "SPARKVEIL_") -> Options:
        """Options from variables like ``SPARKVEIL_PROFILE``; those not given keep their default. Yes and
        no are 1, true, yes, on and 0, false, no, off; types are separated by commas."""
        made = {}
        for f in fields(cls):
            raw = env.get(prefix + f.name.upper())
            if raw is None or f.name == "review":
                continue
            if f.name == "types":
                made[f.name] = frozenset(x.strip() for x in raw.split(",") if x.strip())
            else:
                made[f.name] = flag(raw) if isinstance(f.default, bool) else type(f.default)(raw)
        return cls(**made)

    def protect(self) -> dict:
        return {"profile": self.profile, "mode": self.mode, "types": self.types, "swears": self.swears, "ids": self.ids, "review": self.review}


def analyze_texts(texts: DataFrame, call_date: str = "call_date", options: Options = Options()) -> DataFrame:
    """``call_id`` and, of each text, the safe text, public spans, facts, obligations, compliance,
    intent, counts and the mean confidence. ``texts`` has call_id, text and the day of the call."""
    rows = privacy.protect_documents(texts, out="_p", **options.protect())
    facts = understanding.financial_facts(F.col("text"))
    return rows.select(
        "call_id",
        F.col("_p.safe_text").alias("safe_text"),
        privacy.public_spans(F.col("_p.pii")).alias("pii"),
        privacy.public_spans(F.col("_p.financial_ids")).alias("operational_ids"),
        F.transform("_p.profanity", lambda s: s.dropFields("value")).alias("profanity"),
        privacy.mean_confidence(F.col("_p.pii")).alias("pii_confidence"),
        (facts if options.raw_facts else understanding.safe_facts(facts)).alias("facts"),
        understanding.obligations(F.col("text"), F.col(call_date)).alias("obligations"),
        understanding.regulatory(F.col("text")).alias("regulatory"),
        understanding.intent(F.col("text")).alias("intent"),
    )


def analyze_calls(segments: DataFrame, words: DataFrame, turns: DataFrame | None = None, options: Options = Options(), heard: DataFrame | None = None) -> dict[str, DataFrame]:
    """The tables of a call analysis: ``segments`` with safe text, ``spans`` after corrections,
    ``windows`` to decode again, ``intervals`` of audio to hide, ``recovery`` (an audit row for each
    window and each later correction) and its ``telemetry``. ``heard`` is a provider's second decoding
    of the windows of a run before, see ``recovery.recover``.

    The decisions are made once on a call's whole text, written to the shared folder, and reused by
    every table; all joins are by call.
    """
    segments = segments if turns is None else timeline.assign_speakers(segments, turns)
    offsets = timeline.segment_offsets(segments)
    tokens = materialize(timeline.word_map(segments, words), "tokens")
    decided = materialize(privacy.protect_documents(timeline.call_text(segments), **options.protect()), "decided")
    texts = decided.select("call_id", "text")
    found = decided.select("call_id", F.posexplode("protected.pii").alias("span_id", "s"))
    spans = found.select("call_id", "span_id", "s.type", "s.start", "s.end", "s.value", "s.confidence", "s.ownership")
    kept = timeline.correct_calls(spans, tokens, texts)
    edits = materialize(timeline.suffix_corrections(spans, tokens, texts), "suffix-edits")
    shown = edits.where("expose_old").select("call_id", "span_id", F.lit(timeline.FOUND).alias("origin"))
    digits = edits.join(spans.select("call_id", "span_id", "type"), ["call_id", "span_id"]).withColumns({"confidence": F.lit(0.995), "value": F.lit(None).cast("string"), "ownership": F.lit(4), "origin": F.lit(timeline.EDIT)})
    digits = timeline.attach_tokens(digits.select(*spans.columns, "origin"), tokens)
    final = materialize(kept.join(shown, ["call_id", "span_id", "origin"], "left_anti").drop("corrected_by").unionByName(digits).drop("value"), "final-spans")
    accepted = final.select("call_id", "type", "start", "end")
    windows = materialize(recovery.plan_recovery(texts, accepted, tokens, options.windows, offsets), "windows")
    guarded, audit = recovery.recover(windows, heard, options.conservative_guard, (texts, accepted, tokens, offsets))
    audit = materialize(audit, "recovery-audit")
    name = F.concat(F.lit("["), F.col("type"), F.lit(" REDACTED]"))
    own = final.select("call_id", "start", "end", name.alias("new"), F.lit(rendering.PII).alias("class"))
    other = rendering.replacements(decided).where(F.col("class") != rendering.PII)
    markers = rendering.guard_markers(audit.where("status = 'guarded'"), texts)
    unresolved = final.where("alignment_method = 'unresolved'").withColumn("span_id", F.concat_ws(":", "origin", "span_id"))
    hidden = timeline.audio_intervals(final).unionByName(timeline.fallback_intervals(unresolved, offsets)).unionByName(guarded)
    return {
        "segments": rendering.safe_segments(offsets, own.unionByName(other).unionByName(markers)),
        "spans": final,
        "windows": windows,
        "intervals": timeline.merge_intervals(hidden),
        "recovery": audit,
        "telemetry": recovery.telemetry(audit),
    }
