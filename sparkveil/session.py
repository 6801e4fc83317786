"""Session helpers shared by every layer: code shipping, table loading, shared storage."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PACKAGE = Path(__file__).resolve().parent
_SHIPPED = "_sparkveil_shipped"


def local_session(cores: str = "*", shuffle: int = 8, memory: str = "8g") -> SparkSession:
    """A local session with the settings the tests and the bench use."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("sparkveil")
        .config("spark.sql.shuffle.partitions", str(shuffle))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", memory)
        .config("spark.sql.adaptive.enabled", "true")
        .getOrCreate()
    )


def ship(spark: SparkSession) -> None:
    """Send this package to the executors' Python workers, once per SparkContext."""
    sc = spark.sparkContext
    if getattr(sc, _SHIPPED, False):
        return
    path = os.path.join(tempfile.mkdtemp(prefix="sparkveil-"), "sparkveil_code.zip")
    with zipfile.ZipFile(path, "w") as z:
        for p in sorted(PACKAGE.rglob("*.py")):
            z.write(p, Path("sparkveil") / p.relative_to(PACKAGE))
    sc.addPyFile(path)
    setattr(sc, _SHIPPED, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def named(name: str) -> Column:
    """The column of that very name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def spread(scan: DataFrame) -> DataFrame:
    """A scan that is read by fewer tasks than the cluster has cores, dealt out to all of them for
    costly work on each row. Large inputs have more splits than cores and stay as they are. Only for
    plans without an exchange, as the number of their tasks is known before they run."""
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores) if scan.rdd.getNumPartitions() < cores else scan


def by_key(df: DataFrame, key: str) -> DataFrame:
    """``df`` dealt out by a key to as many tasks as the cluster has cores, or shuffles are set to have.
    For costly work behind a small shuffle, which would else be joined into one task."""
    spark = df.sparkSession
    return df.repartition(max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), key)


def sliced(batches: Iterator, rows: int = 1024) -> Iterator:
    """Arrow batches in pieces of at most ``rows`` rows, so that what a worker makes of one is small."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see (``spark.checkpoint.dir``).

    Only a local master may fall back to a folder of its own.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a shared folder on a cluster")
        root = getattr(spark.sparkContext, "_sparkveil_tmp", None)
        if root is None:
            root = "file://" + tempfile.mkdtemp(prefix="sparkveil-shared-")
            spark.sparkContext._sparkveil_tmp = root
    return root.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, removed when the driver's JVM ends."""
    path = f"{shared_dir(spark)}/sparkveil/{name}-{uuid.uuid4().hex[:12]}"
    sc = spark.sparkContext
    p = sc._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(sc._jsc.hadoopConfiguration())
    fs.mkdirs(p.getParent())
    fs.deleteOnExit(p)
    return path


def drop_path(spark: SparkSession, path: str) -> None:
    sc = spark.sparkContext
    p = sc._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(sc._jsc.hadoopConfiguration()).delete(p, True)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write a result to the shared folder and read it again: later steps keep no lineage to
    the input, and a lost executor costs only the tasks it held."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._sparkveil_path = path
    return out


def forget(*tables: DataFrame) -> None:
    """Remove tables of ``materialize`` that nothing reads any more."""
    for df in tables:
        drop_path(df.sparkSession, df._sparkveil_path)


def path_exists(spark: SparkSession, path: str) -> bool:
    sc = spark.sparkContext
    p = sc._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(sc._jsc.hadoopConfiguration()).exists(p)
