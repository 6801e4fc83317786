"""The registered queries of the training-data operators, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkveil.llm import byte_bpe, exact_dedup, media_boxes, quality, secret_scan, simhash, source_mix, token_cache, toxicity, url_filter
from sparkveil.session import shared_path, table

#: The cycle of weights of op2, and the URL rules of op7.
WEIGHTS = (3, 1, 2)
URL_RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


def op2_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = source_mix.mix_sources(table(spark, sf_dir, "documents"), source_mix.cycle_weights(WEIGHTS))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With a cache of its own, which starts empty: every distinct text is encoded."""
    return token_cache.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), shared_path(spark, "token-cache"))


def op4_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_boxes.stored_digests(table(spark, sf_dir, "documents"))


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scan_secrets(table(spark, sf_dir, "documents"))
    kinds = [r.kind for r in secret_scan.RULES]
    base = F.filter("found", lambda s: s["order"] < len(secret_scan.BASE))

    def count(order: int):
        return F.size(F.filter("found", lambda s: s["order"] == order)).cast("long")

    counts = [count(i).alias(f"n_{r.kind}") for i, r in enumerate(secret_scan.BASE)]
    return found.select("doc_id", *counts, F.sha2(F.encode(secret_scan.span_list(base, kinds), "utf-8"), 256).alias("base_sha256"), secret_scan.span_list(F.col("found"), kinds).alias("spans"))


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.encoded_digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_urls(table(spark, sf_dir, "pages"), url_filter.rules_table(spark, URL_RULES))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.score(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_dedup(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_exact_dedup, op2_source_mix, op3_token_counts, op4_media_columns, op5_secret_scan, op6_byte_bpe, op7_url_filter, op8_toxicity, op9_quality, op10_simhash)
}

_NORM = r"regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g')"

OP1_SQL = f"""
WITH n AS (SELECT doc_id, length(coalesce(text, '')) AS len, {_NORM} AS norm FROM documents),
g AS (SELECT doc_id, norm, count(*) OVER (PARTITION BY norm) AS group_size,
             first_value(doc_id) OVER (PARTITION BY norm ORDER BY len DESC, doc_id) AS keep_id,
             row_number() OVER (PARTITION BY norm ORDER BY len DESC, doc_id) AS r FROM n)
SELECT doc_id, keep_id, group_size, r = 1 AS kept, sha256(norm) AS text_sha256 FROM g
"""

OP7_SQL = r"""
WITH u AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
r AS (
  SELECT *, CASE
    WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
    WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
    WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
    WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/') THEN 'net/' END AS rule FROM h)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' ELSE 'allow' END AS verdict FROM r
"""


def _op5_sql() -> str:
    """For each rule the matches and the text between them alternate, so lengths give positions."""
    quote = lambda p: "'" + p.replace("'", "''") + "'"
    lists = []
    for i, r in enumerate(secret_scan.RULES):
        p = quote(r.pattern)
        value = f"length(regexp_extract(m[i], {p}, {r.value}))" if r.value else "length(m[i])"
        lists.append(f"""
  SELECT doc_id, {i} AS ord, '{r.kind}' AS kind, start, start + length(hit) AS stop FROM (
    SELECT doc_id, m[i] AS hit, {value} AS value,
           list_sum(list_transform(s[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS start
    FROM (SELECT doc_id, m, s, unnest(generate_series(1, len(m))) AS i FROM (
      SELECT doc_id, regexp_extract_all(text, {p}) AS m, string_split_regex(text, {p}) AS s FROM d))) WHERE value >= {r.least}""")
    spans = "\n  UNION ALL".join(lists)
    n = len(secret_scan.BASE)
    counts = ", ".join(f"count(ord) FILTER (ord = {i}) AS n_{r.kind}" for i, r in enumerate(secret_scan.BASE))
    item = "concat_ws(':', kind, CAST(start AS BIGINT), CAST(stop AS BIGINT))"
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
spans AS ({spans})
SELECT d.doc_id, {counts},
       sha256(coalesce(string_agg({item}, ',' ORDER BY start, ord) FILTER (ord < {n}), '')) AS base_sha256,
       coalesce(string_agg({item}, ',' ORDER BY start, ord) FILTER (ord IS NOT NULL), '') AS spans
FROM d LEFT JOIN spans USING (doc_id) GROUP BY d.doc_id
"""


ORACLE_SQL = {"op1_exact_dedup": OP1_SQL, "op5_secret_scan": _op5_sql(), "op7_url_filter": OP7_SQL}
