"""Token counts through a digest cache.

Texts are keyed by the SHA-256 of their normalised content and a digest of the tokenizer (its file
and its library's version). Counts found in the cache are joined; the distinct texts that miss are
encoded once each and appended to the cache, a Parquet table in shared storage with a folder for each
tokenizer. A new tokenizer file or library never meets old counts. Of the cache a run reads its
tokenizer's digests, 32 bytes a text, and keeps, groups and writes only the counts that it needs.

The encoder is the tokenizer's own library. For a byte-level BPE without normaliser, texts are cut
where no token can cross (``pretokens.py``) and a worker remembers the counts of the chunks it has
seen, which changes no count and saves most of the work.
"""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkveil.llm.pretokens import Memo, chunks
from sparkveil.session import materialize, path_exists, ship, sliced

CACHE_SCHEMA = "tokenizer string, digest binary, n_tokens long"


def normalised(text: Column) -> Column:
    """The content that is counted: null is empty, and nothing else changes, as any other
    normalisation could change the counts."""
    return F.coalesce(text.cast("string"), F.lit(""))


def tokenizer_digest(path: str, data: bytes) -> str:
    """Digest of the tokenizer's file and its library's version."""
    import sentencepiece
    import tokenizers

    version = f"sentencepiece {sentencepiece.__version__}" if path.endswith(".model") else f"tokenizers {tokenizers.__version__}"
    return hashlib.sha256(version.encode() + b"\0" + data).hexdigest()


def _cuttable(spec: dict) -> bool:
    """Whether counts of chunks add up: a byte-level pre-tokenizer with the pattern, no normaliser."""
    pre = spec.get("pre_tokenizer") or {}
    added = spec.get("added_tokens") or []
    return pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and not spec.get("normalizer") and not any(t.get("lstrip") or t.get("rstrip") or any(c.isspace() for c in t["content"]) for t in added)


class Counter:
    """Counts tokens of texts with the library that a tokenizer file belongs to."""

    def __init__(self, path: str, data: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        if path.endswith(".model"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_proto=data)
            self._whole, self._cut = (lambda text: len(model.encode(text))), False
        else:
            from tokenizers import Tokenizer

            model = Tokenizer.from_buffer(data)
            model.no_truncation()
            model.no_padding()
            self._cut = _cuttable(json.loads(data))
            self._whole = lambda text: len(model.encode_batch_fast([text], add_special_tokens=False)[0])
        self._chunk = Memo(self._whole)
        self._spaced = Memo(lambda chunk: self._whole(" " + chunk))

    def __call__(self, text: str) -> int:
        if not self._cut:
            return self._whole(text)
        first, rest = chunks(text)
        if first is None:
            return sum(map(self._chunk.__getitem__, rest))
        return (self._chunk[first] if first else 0) + sum(map(self._spaced.__getitem__, rest))


_COUNTERS: dict[str, Counter] = {}


def counter(version: str, path: str, data: bytes) -> Counter:
    """One counter for each Python worker, so its memo serves all tasks of that worker."""
    if version not in _COUNTERS:
        _COUNTERS[version] = Counter(path, data)
    return _COUNTERS[version]


def _cached(spark: SparkSession, cache_path: str, version: str) -> DataFrame:
    if not path_exists(spark, cache_path):
        return spark.createDataFrame([], CACHE_SCHEMA)
    return spark.read.schema(CACHE_SCHEMA).parquet(cache_path).where(F.col("tokenizer") == version)


def token_counts(df: DataFrame, tokenizer_path: str, cache_path: str, limit: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``doc_id, n_bytes, n_tokens, over_limit``; new counts are appended to
    the cache at ``cache_path``, which need not exist.

    Counts are those of the library without begin, end or added special tokens; special strings in
    a text are handled as the library does by default. Defined cases: a null text counts as empty
    (0 tokens); a text of any length is counted whole, with memory for its pieces; repeated texts are
    encoded once; repeated rows are returned as often as they came; an empty table gives an empty
    result; other columns are ignored. A cache row written twice, by a run that another overtook, is
    counted once. The driver reads the tokenizer's file; workers get it by broadcast.
    """
    spark = df.sparkSession
    ship(spark)
    with open(tokenizer_path, "rb") as f:
        data = f.read()
    version, shared = tokenizer_digest(tokenizer_path, data), spark.sparkContext.broadcast(data)
    rows = df.select(F.col(id_col).alias("id"), normalised(F.col(text_col)).alias("text"))
    rows = rows.withColumn("digest", F.unhex(F.sha2(F.encode("text", "utf-8"), 256)))
    misses, known = rows.select("digest", "text"), None
    if path_exists(spark, cache_path):
        known = _cached(spark, cache_path, version).select("digest")
        known = None if known.isEmpty() else known
    if known is not None:
        misses = misses.join(known, "digest", "left_anti")
    distinct = misses.groupBy("digest").agg(F.first("text").alias("text"))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(version, tokenizer_path, shared.value)
        for batch in sliced(batches):
            n = [count(x.as_py()) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([pa.array([version] * len(n), pa.string()), batch.column(0), pa.array(n, pa.int64())], ["tokenizer", "digest", "n_tokens"])

    distinct.mapInArrow(encode, CACHE_SCHEMA).write.mode("append").partitionBy("tokenizer").parquet(cache_path)
    counts = _cached(spark, cache_path, version)
    if known is not None:  # a cache of other runs, too
        counts = counts.join(rows.select("digest").distinct(), "digest", "left_semi")
    # Written counts leave a plain join, whose hot partitions Spark can split.
    counts = materialize(counts.groupBy("digest").agg(F.max("n_tokens").alias("n_tokens")), "token-counts")
    keys = rows.select("id", F.octet_length("text").cast("long").alias("n_bytes"), "digest")
    return keys.join(counts, "digest").select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
