"""A training corpus from ``documents`` in five stages, each reading the table that the one before
it wrote. All stages but the last return the columns of ``documents``; the last returns token ids as
digests."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from sparkveil.llm import byte_bpe, exact_dedup, near_copies, quality, source_mix
from sparkveil.llm.queries import WEIGHTS
from sparkveil.session import materialize, table

#: A document is rejected below this probability of good quality.
REJECT_BELOW = 0.5
#: Fewer than the encoder's own, as its workers have other stages' memory to carry.
CHUNKS = 120_000


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    return quality.good_documents(docs, model, threshold=REJECT_BELOW)


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.drop_copies(docs)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_copies.one_of_each(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return source_mix.mixed_documents(docs, source_mix.cycle_weights(WEIGHTS))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return byte_bpe.encoded_digests(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, chunks=CHUNKS)


STAGES = [
    ("quality", good_quality),
    ("exact_dedup", without_copies),
    ("near_dedup", without_near_copies),
    ("source_mix", mixed),
    ("encode", encoded),
]

#: A classifier, fingerprints and a tokenizer are not SQL; tests/llm compares run() behind the quality stage with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
