"""Case files, manifests, results and reports."""

from __future__ import annotations

import json
import platform
from importlib.metadata import PackageNotFoundError, version

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CASE = "id string, text string, expected array<struct<type:string,value:string>>"
PROFANITY_CASE = "id string, text string, expected array<string>"
MANIFEST = "id string, audio string, transcript string, pii array<struct<type:string,value:string>>, profanity array<string>, gold_intervals array<struct<type:string,start:double,end:double>>"

#: Packages whose versions decide results.
PACKAGES = ("pyspark", "pyarrow", "pandas", "numpy")


def read_cases(spark: SparkSession, path: str, schema: str = CASE) -> DataFrame:
    """One case a line. Blank lines are skipped; a line that is no JSON of this form is an error, so no
    case is lost without notice."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """A manifest, its relative audio paths made absolute beside it."""
    base = path.rsplit("/", 1)[0]
    rows = read_cases(spark, path, MANIFEST)
    return rows.withColumn("audio", F.when(F.col("audio").rlike(r"^(/|[a-z0-9]+:)"), F.col("audio")).otherwise(F.concat(F.lit(base + "/"), F.col("audio"))))


def write_results(df: DataFrame, path: str) -> None:
    """Whole results, one JSON object a line."""
    df.write.mode("overwrite").json(path)


def write_report(rows: DataFrame, path: str, summary: DataFrame | None = None) -> None:
    """Rows of a report as CSV with a header, and the summary as JSON in a folder of its own beside."""
    rows.write.mode("overwrite").option("header", True).csv(path)
    if summary is not None:
        summary.write.mode("overwrite").json(path.rstrip("/") + "-summary")


def write_bundle(df: DataFrame, root: str, run: str, raw_col: str, safe_col: str, include_raw: bool = False) -> str:
    """A debug bundle ``run_<run>`` under ``root``: ``debug_rows`` as JSON, readable by its owner alone.
    Returns its path."""
    path = f"{root.rstrip('/')}/run_{run}"
    debug_rows(df, raw_col, safe_col, include_raw).write.mode("errorifexists").json(path)
    jvm, conf = df.sparkSession.sparkContext._jvm, df.sparkSession.sparkContext._jsc.hadoopConfiguration()
    folder = jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(conf)
    for status in fs.listStatus(folder):
        fs.setPermission(status.getPath(), jvm.org.apache.hadoop.fs.permission.FsPermission("600"))
    fs.setPermission(folder, jvm.org.apache.hadoop.fs.permission.FsPermission("700"))
    return path


def debug_rows(df: DataFrame, raw_col: str, safe_col: str, include_raw: bool = False) -> DataFrame:
    """What a debug bundle may show of a text: the safe text, and of the raw one its length and digest;
    the raw text itself only if asked for."""
    text = F.coalesce(F.col(raw_col), F.lit(""))
    out = df.withColumn("raw_chars", F.char_length(text)).withColumn("raw_sha256", F.sha2(F.encode(text, "utf-8"), 256)).withColumn("safe_chars", F.char_length(safe_col)).withColumn("changed", text != F.col(safe_col))
    return out if include_raw else out.drop(raw_col)


def expire(spark: SparkSession, root: str, ttl_hours: float, now_ms: int, prefix: str = "run_") -> dict:
    """Remove the bundles under ``root`` that are older than the time to live; nothing else."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path(root)
    fs = path.getFileSystem(conf)
    counts = {"removed": 0, "kept": 0, "failed": 0}
    for status in fs.listStatus(path) if fs.exists(path) else []:
        if not status.getPath().getName().startswith(prefix) or not status.isDirectory():
            continue
        if now_ms - status.getModificationTime() < ttl_hours * 3_600_000:
            counts["kept"] += 1
        else:
            counts["removed" if fs.delete(status.getPath(), True) else "failed"] += 1
    return counts


def runtime_fingerprint(models: dict[str, str] | None = None, packages: tuple[str, ...] = PACKAGES) -> dict[str, str | None]:
    """The versions of the interpreter and of packages (null: not installed), and the models in use."""
    found: dict[str, str | None] = {"python": platform.python_version()}
    for name in packages:
        try:
            found[name] = version(name)
        except PackageNotFoundError:
            found[name] = None
    return found | {f"model:{k}": v for k, v in (models or {}).items()}


def fingerprint_drift(spark: SparkSession, before: dict, now: dict) -> DataFrame:
    """``name, before, now`` of every package or model whose version differs."""
    table = lambda d, c: spark.createDataFrame([(k, json.dumps(v)) for k, v in d.items()], f"name string, {c} string")
    return table(before, "before").join(table(now, "now"), "name", "full").where(~F.col("before").eqNullSafe(F.col("now")))
