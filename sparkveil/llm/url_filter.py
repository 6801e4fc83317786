"""URL filters: a blocked Bloom filter in front of an exact hash join.

A list entry is (host, path, verdict). It fits its host and all subdomains if the URL's path starts
with the entry's; of several that fit the longest wins, then the one with the longer host. A URL's
possible entries are its host's suffixes of as many labels, joined with its path's prefixes of the
lengths, that the list has. Each is looked up in the filter, whose 64-bit blocks hold ``HASHES`` bits of one key each,
so a lookup reads one block. What passes goes to an exact join with the list, which removes the
filter's false positives.

The filter has ``blocks`` blocks at most, so its table is broadcast with a known bound; the list
itself is joined as a table of any size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkveil.session import materialize

HASHES = 4
#: 2^15 blocks of 64 bits: about 200,000 entries at 10 bits each, and a broadcast under 1 MB.
BLOCKS = 1 << 15


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url)))
    host = F.regexp_extract(F.coalesce(rest, F.lit("")), r"^[^/?#]*", 0)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end; else empty."""
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url)))
    return F.regexp_extract(F.coalesce(rest, F.lit("")), r"^[^/?#]*([^?#]*)", 1)


def _labels(host: Column) -> Column:
    """How many labels a host has."""
    return F.length(host) - F.length(F.replace(host, F.lit("."), F.lit(""))) + 1


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(1), key), F.lit(blocks))


def _mask(key: Column) -> Column:
    h, mask = F.xxhash64(F.lit(2), key), F.lit(0).cast("long")
    for i in range(HASHES):
        bit = F.shiftrightunsigned(h, 6 * i).bitwiseAND(63).cast("int")
        mask = mask.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), bit))
    return mask


def bloom_filter(keys: DataFrame, key: str, blocks: int = BLOCKS) -> DataFrame:
    """``block, bits``: the blocks of the filter that have a bit set, ``blocks`` rows at most."""
    return keys.where(F.col(key).isNotNull()).groupBy(_block(F.col(key), blocks).alias("block")).agg(F.bit_or(_mask(F.col(key))).alias("bits"))


def rules_table(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    """A list as a table: host, path, verdict."""
    return spark.createDataFrame(rules, "host string, path string, verdict string")


def judge_urls(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow", blocks: int = BLOCKS) -> DataFrame:
    """One row per input row: ``page_id, host, path, rule`` (null if none fits) and ``verdict``, the
    rule's or ``default``.

    Defined cases: a null URL and one without ``://`` have an empty host and path, fit no rule and
    get ``default``; rules with a null or empty host never fit; of rules with the same host and path
    the smallest verdict counts; of a host with any number of labels, and a path of any length, only
    the parts that a rule may have are looked at; repeated rows are returned as often as they came; an
    empty table gives an empty result; other columns are ignored. A verdict depends on host and path
    alone, so each distinct pair is looked up once. The verdicts are written before the rows meet
    them, which leaves a plain join, whose hot partitions Spark can split; rows without a host go
    through it by keys of their own.
    """
    host, path = F.col("host"), F.coalesce("path", F.lit(""))
    listed = (
        rules.where("host is not null and host != ''")
        .select(F.concat(host, path).alias("rule"), F.length(host).alias("host_len"), F.length(path).alias("path_len"), _labels(host).alias("labels"), "verdict")
        .groupBy("rule", "host_len", "path_len", "labels")
        .agg(F.min("verdict").alias("verdict"))
    )
    # No more numbers than the list's longest path has characters, and its longest host labels.
    known = lambda c: sorted(r[0] for r in listed.select(c).distinct().collect())
    rows = pages.select(F.col(id_col).alias("id"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    pairs = rows.where("host != ''").select("host", "path").distinct()
    strings = lambda cs: F.array_compact(F.array(*cs)) if cs else F.array().cast("array<string>")
    suffixes = strings([F.when(_labels(F.col("host")) >= n, F.substring_index("host", ".", -n)) for n in known("labels")])
    prefixes = strings([F.when(F.length("path") >= n, F.substring("path", 1, n)) for n in known("path_len")])
    made = F.flatten(F.transform(suffixes, lambda s: F.transform(prefixes, lambda p: F.concat(s, p))))
    asked = pairs.select("host", "path", F.explode(made).alias("rule")).where("rule != ''")
    asked = asked.withColumn("block", _block(F.col("rule"), blocks)).withColumn("mask", _mask(F.col("rule")))
    # At most `blocks` rows of 16 bytes.
    possible = asked.join(F.broadcast(bloom_filter(listed, "rule", blocks)), "block").where(F.col("bits").bitwiseAND(F.col("mask")) == F.col("mask"))
    hits = possible.select("host", "path", "rule").join(listed, "rule")
    best = hits.groupBy("host", "path").agg(F.max(F.struct((F.col("host_len") + F.col("path_len")).alias("n"), "host_len", "rule", "verdict")).alias("best"))
    best = materialize(best.select(F.col("host").alias("_h"), F.col("path").alias("_p"), F.col("best.rule").alias("rule"), F.col("best.verdict").alias("verdict")), "url-verdicts")
    key = F.when(F.col("host") == "", F.concat(F.lit("\0"), F.col("id").cast("string"))).otherwise(F.col("host"))
    found = rows.withColumn("_key", key).join(best, (F.col("_key") == F.col("_h")) & (F.col("path") == F.col("_p")), "left")
    return found.select(F.col("id").alias(id_col), "host", "path", "rule", F.coalesce("verdict", F.lit(default)).alias("verdict"))
