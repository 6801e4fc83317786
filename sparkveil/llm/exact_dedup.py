"""Exact dedup by content hash, with a byte comparison inside each hash group.

Method: texts are normalised by deleting ASCII white space, hashed to 128 bits (the left half of
their SHA-256), and grouped by ``(hash, normalised bytes)``. The grouping itself compares the
bytes, so two texts that collide on the hash are two groups. Counting and choosing the row that
stays use buffers of fixed width, so Spark combines a group inside each map task before the
shuffle: a group with a third of all rows costs one row per task. The shuffle carries each
distinct text of a task once; the rows of the documents themselves travel as ids and digests.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkveil.session import materialize

#: Ids become ``_TOP - id``, 1 to 2^64; 0 stands for null.
_TOP, _SHIFT = Decimal(2**63), Decimal(2**65)
WHITE = r"[\x20\x09-\x0D]"


def normalised(text: Column) -> Column:
    """The text without ASCII white space; null counts as empty."""
    return F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), WHITE + "+", "")


def _rank(length: Column, doc_id: Column) -> Column:
    """One decimal that orders rows by length, then by smaller id, nulls last: max() of it keeps a
    fixed-width buffer, which a struct would not."""
    low = F.coalesce((F.lit(_TOP) - doc_id.cast("decimal(19,0)")).cast("decimal(20,0)"), F.lit(0).cast("decimal(20,0)"))
    return (length.cast("decimal(11,0)") * F.lit(_SHIFT) + low).cast("decimal(38,0)")


def _ranked_id(rank: Column) -> Column:
    low = F.pmod(rank, F.lit(_SHIFT))
    return F.when(low > 0, (F.lit(_TOP) - low).cast("long"))


def _digests(df: DataFrame, id_col: str, text_col: str, hash_bits: int) -> DataFrame:
    sha = F.sha2(F.encode(F.col("_norm"), "utf-8"), 256)
    return (
        df.select(F.col(id_col).cast("long").alias("_id"), normalised(F.col(text_col)).alias("_norm"), F.char_length(F.coalesce(F.col(text_col).cast("string"), F.lit(""))).alias("_len"))
        .withColumn("_sha", sha)
        .withColumn("_h", F.substring("_sha", 1, hash_bits // 4))
    )


def exact_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", hash_bits: int = 128) -> DataFrame:
    """One row per input row: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Of equal texts the row with the most code points in its original text stays, then the one with
    the smallest id; an id that is null ranks last. Defined cases: a null text counts as empty, and
    empty texts are equal to each other; a text of any length is compared whole; rows repeated in full
    are members of one group and exactly one of them is kept; an empty table gives an empty result;
    other columns are ignored, whatever their names. ``hash_bits`` is a multiple of 4 and smaller only in tests that force collisions.
    """
    rows = _digests(df, id_col, text_col, hash_bits)
    groups = (
        rows.groupBy("_h", "_norm")
        .agg(F.count(F.lit(1)).alias("group_size"), F.max(_rank(F.col("_len"), F.col("_id"))).alias("_best"))
        .select(F.sha2(F.encode("_norm", "utf-8"), 256).alias("_sha"), "group_size", "_best")
    )
    # Documents find their group by the whole SHA-256. Were two different texts to agree on all of
    # it, the groups would hold that digest twice: that is an error, never a silent merge. Written
    # groups also leave a plain join, whose hot partitions Spark can split.
    groups = materialize(groups, "exact-groups")
    if not groups.groupBy("_sha").count().where("count > 1").isEmpty():
        raise ValueError("different texts share a SHA-256")
    # Rows that agree in id and text are counted here and unfolded below.
    members = rows.groupBy("_sha", "_id", "_len").agg(F.count(F.lit(1)).alias("_copies"))
    joined = members.join(groups, "_sha").withColumn("_mine", _rank(F.col("_len"), F.col("_id")) == F.col("_best"))
    keep = _ranked_id(F.col("_best"))
    unfolded = joined.withColumn("_keep", keep).withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_copies"))))
    return unfolded.select(
        F.col("_id").alias(id_col),
        F.col("_keep").alias("keep_id"),
        F.col("group_size").cast("long").alias("group_size"),
        (F.col("_mine") & (F.col("_copy") == 1)).alias("kept"),
        F.col("_sha").alias("text_sha256"),
    )


def drop_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", hash_bits: int = 128) -> DataFrame:
    """The rows that ``exact_dedup`` keeps, with all their columns.

    One shuffle: the row that stays is carried as the group's value, so no join follows. Which of
    several rows repeated in full stays makes no difference. Columns may have any names.
    """
    names = df.columns
    packed = df.toDF(*[f"c{i}" for i in range(len(names))])
    text, doc_id = F.col(f"c{names.index(text_col)}"), F.col(f"c{names.index(id_col)}")
    length = F.char_length(F.coalesce(text.cast("string"), F.lit("")))
    row = packed.select(normalised(text).alias("_norm"), _rank(length, doc_id.cast("long")).alias("_rank"), F.struct(*packed.columns).alias("_row"))
    row = row.withColumn("_h", F.substring(F.sha2(F.encode("_norm", "utf-8"), 256), 1, hash_bits // 4))
    best = row.groupBy("_h", "_norm").agg(F.max_by("_row", "_rank").alias("_row"))
    return best.select(*[F.col(f"_row.c{i}").alias(n) for i, n in enumerate(names)])
