"""Connected components by alternating large-star and small-star steps over an edge table.

Each round is a few aggregations and joins, and its edges are written to the shared folder, so
the plan does not grow and a lost executor costs only its tasks. Nothing but two numbers a round
comes to the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkveil.session import drop_path, materialize


def _with_minimum(edges: DataFrame, least: DataFrame) -> tuple[DataFrame, str]:
    """edges(u, v) joined with least(u, m). The minima are written first: Spark then knows their size,
    broadcasts them only if they are small, and otherwise splits the hubs' partitions of the join."""
    written = materialize(least, "edge-minima")
    return edges.join(written, "u").select("u", "v", "m"), written._sparkveil_path


def _star_round(e: DataFrame) -> tuple[DataFrame, list[str]]:
    both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    joined, first = _with_minimum(both, both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")))
    large = materialize(joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "edges")
    least = large.groupBy("u").agg(F.min("v").alias("m"))
    joined, second = _with_minimum(large, least)
    small = joined.where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return materialize(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "edges"), [first, second, large._sparkveil_path, e._sparkveil_path]


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node, root`` for every node of an edge other than its component's smallest node, the root.

    Self-loops, repeated edges, either direction and nulls (ignored) are fine; no edges give an
    empty result.
    """
    spark = edges.sparkSession
    pairs = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
    current, before = materialize(pairs.distinct(), "edges"), None
    while True:
        state = current.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).collect()[0]
        if state == before or state["n"] == 0:
            return current.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = state
        current, done = _star_round(current)
        for path in done:
            drop_path(spark, path)


def row_key(text: Column) -> Column:
    """What tells rows of one id apart: a digest of the text, null counting as empty."""
    return F.md5(F.encode(F.coalesce(text.cast("string"), F.lit("")), "utf-8"))


def one_row_each(df: DataFrame, members: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``df`` that come first in their component, one for each.

    ``members`` has ``id, key, root`` for every row, the key being ``row_key``. Rows rank by id, nulls
    last, then by key, so a null or reused id never takes unlinked texts along. Of rows that agree in
    id and text one stays.
    """
    members = materialize(members, "component-members")
    rank = F.struct(F.col("id").isNull().alias("none"), "id", "key")
    best = members.groupBy("root").agg(F.min(rank).alias("best"))
    gone = members.join(best, "root").where(~((F.col("key") == F.col("best.key")) & F.col("id").eqNullSafe(F.col("best.id"))))
    gone = materialize(gone.select(F.col("id").alias("_gone"), F.col("key").alias("_gone_key")).distinct(), "component-gone")
    # Columns may have any names, so they are addressed by position.
    names = df.columns
    packed = df.toDF(*[f"c{i}" for i in range(len(names))])
    doc_id, text = (F.col(f"c{names.index(c)}") for c in (id_col, text_col))
    rows = packed.withColumn("_row_id", doc_id.cast("long")).withColumn("_row_key", row_key(text))
    kept = rows.join(gone, F.col("_row_id").eqNullSafe(F.col("_gone")) & (F.col("_row_key") == F.col("_gone_key")), "left_anti")
    repeated = members.groupBy(F.col("id").alias("_again"), F.col("key").alias("_again_key")).count().where("count > 1").drop("count")
    if not repeated.isEmpty():
        same = F.col("_row_id").eqNullSafe(F.col("_again")) & (F.col("_row_key") == F.col("_again_key"))
        order = Window.partitionBy("_row_id", "_row_key").orderBy(*packed.columns)
        once = kept.join(repeated, same, "left_semi").withColumn("_copy", F.row_number().over(order)).where("_copy = 1").drop("_copy")
        kept = kept.join(repeated, same, "left_anti").unionByName(once)
    return kept.select(*packed.columns).toDF(*names)
