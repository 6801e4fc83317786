"""Command line: ``python -m sparkveil protect|analyze|calls|fingerprint ...``, see ``--help`` of each."""

from __future__ import annotations

import argparse
import importlib
import json
import sys
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkveil.operators import privacy, providers
from sparkveil.plans.analyze import Options, analyze_calls, analyze_texts
from sparkveil.sources import cases

FORMATS = ("parquet", "json", "csv", "orc")


def read(spark: SparkSession, path: str, kind: str) -> DataFrame:
    return spark.read.option("header", True).format(kind).load(path)


def plug(name: str | None):
    """A provider named ``module:function``."""
    if name is None:
        return None
    module, _, attribute = name.partition(":")
    return getattr(importlib.import_module(module), attribute)


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="sparkveil", description=__doc__)
    sub = p.add_subparsers(dest="what", required=True)
    policy = argparse.ArgumentParser(add_help=False)
    policy.add_argument("--format", default="parquet", choices=FORMATS)
    policy.add_argument("--profile", default="balanced", choices=("high_precision", "balanced", "high_recall"))
    policy.add_argument("--partial-mask", action="store_true")
    policy.add_argument("--no-profanity-filter", action="store_true")
    policy.add_argument("--financial-id-mask", action="store_true")
    policy.add_argument("--types", help="comma-separated types to hide; all others stay")
    policy.add_argument("--include-raw", action="store_true", help="keep the text, and the values of facts")
    policy.add_argument("--semantic", help="module:function, a semantic judge")
    policy.add_argument("--names", help="module:function, a name model")
    for what in ("protect", "analyze"):
        q = sub.add_parser(what, parents=[policy])
        q.add_argument("input")
        q.add_argument("output")
        q.add_argument("--id", default="call_id")
        q.add_argument("--text", default="text")
        if what == "analyze":
            q.add_argument("--date", required=True, help="column with the day of the call, from which due dates count")
    q = sub.add_parser("calls", parents=[policy], help="timed calls: a table for each result under OUTPUT")
    q.add_argument("segments")
    q.add_argument("words")
    q.add_argument("output")
    q.add_argument("--turns", help="table of speaker turns")
    q.add_argument("--heard", help="table of second decodings")
    q.add_argument("--max-windows", type=int, default=Options.windows)
    q.add_argument("--no-guard", action="store_true", help="leave windows open that no second decoding confirms")
    q = sub.add_parser("fingerprint", help="versions in use, compared with those of the file before it is replaced")
    q.add_argument("file")
    q.add_argument("--model", action="append", default=[], help="name=version")
    q.add_argument("--strict", action="store_true", help="exit with 3 if a version differs")
    return p


def _options(a: argparse.Namespace) -> Options:
    review = providers.with_models(plug(a.semantic), plug(a.names)) if a.semantic or a.names else None
    return Options(
        profile=a.profile, mode="partial" if a.partial_mask else "full", swears=not a.no_profanity_filter, ids=a.financial_id_mask, types=frozenset(a.types.split(",")) if a.types else None,
        raw_facts=a.include_raw, windows=getattr(a, "max_windows", Options.windows), conservative_guard=not getattr(a, "no_guard", False), review=review,
    )


def _fingerprint(a: argparse.Namespace) -> int:
    now, path = cases.runtime_fingerprint(dict(m.split("=", 1) for m in a.model)), Path(a.file)
    before = json.loads(path.read_text()) if path.exists() else now
    drift = {k: [before.get(k), now.get(k)] for k in sorted(before.keys() | now.keys()) if before.get(k) != now.get(k)}
    path.write_text(json.dumps(now, indent=1))
    print(json.dumps({"drift": drift}))
    return 3 if drift and a.strict else 0


def main(args: list[str] | None = None) -> int:
    a = _parser().parse_args(args)
    if a.what == "fingerprint":
        return _fingerprint(a)
    spark = SparkSession.builder.appName("sparkveil").getOrCreate()
    options = _options(a)
    nested = "json" if a.format == "csv" else a.format  # nested results don't fit in CSV
    if a.what == "calls":
        table = lambda path: read(spark, path, a.format) if path else None
        for name, rows in analyze_calls(table(a.segments), table(a.words), table(a.turns), options, table(a.heard)).items():
            rows.write.mode("overwrite").format(nested).save(f"{a.output.rstrip('/')}/{name}")
        return 0
    rows = read(spark, a.input, a.format)
    if a.what == "protect":
        out = privacy.protect_documents(rows, text_col=a.text, out="_p", **options.protect())
        if a.include_raw:
            out = out.withColumn("raw_" + a.text, F.col(a.text))
        out.withColumn(a.text, F.col("_p.safe_text")).drop("_p").write.mode("overwrite").format(a.format).save(a.output)
    else:
        texts = rows.select(F.col(a.id).alias("call_id"), F.col(a.text).alias("text"), F.to_date(F.col(a.date)).alias("call_date"))
        out = analyze_texts(texts, options=options)
        if a.include_raw:
            out = out.join(texts.select("call_id", F.col("text").alias("raw_text")), "call_id")
        out.write.mode("overwrite").format(nested).save(a.output)
    return 0


if __name__ == "__main__":
    sys.exit(main())
