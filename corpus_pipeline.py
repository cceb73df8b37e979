"""Cleaning a corpus end to end: each stage reads all that the stage before it kept."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from replylens.llm import arrays, bpe, exact_dedup, language_id, mixing, ngram_join
from replylens.session import stage_root

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

#: near duplicates: shingles of five words, similarity of 0.8 or more
SHINGLE_WORDS, PERCENT = 5, 80


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in no language go: those without a text or without a letter, and those
    that the network holds for unreadable, in scripts or letters of no labelled language.
    Where no row has a label, all texts with a letter stay. Repeated rows are decided
    alike, an empty table stays empty."""
    arrays.small_batches(spark)
    model = language_id.fit(docs.where(~language_id.held_out(F.col("doc_id"))), background=True)
    return language_id.keep_identified(docs, model)


def drop_equal_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (white space aside) the longest, then smallest doc_id stays."""
    return exact_dedup.drop_exact_duplicates(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group that links connect, the smallest doc_id stays."""
    arrays.small_batches(spark)
    return ngram_join.drop_near_duplicates(docs, SHINGLE_WORDS, PERCENT)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mixture of its sources takes it."""
    return mixing.mix_documents(docs)


def encode_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every row, and the digest of what they decode to."""
    arrays.small_batches(spark)
    return bpe.encode_documents(
        docs,
        public_tokenizers.path("byte_bpe_50k.tiktoken"),
        public_tokenizers.PATTERN,
        outputs=("n_tokens", "ids", "decoded_sha256"),
    )


STAGES: list[tuple[str, Stage]] = [
    ("language_id", identify_language),
    ("exact_dedup", drop_equal_texts),
    ("ngram_jaccard_join", drop_near_copies),
    ("mixing", mix_sources),
    ("byte_bpe", encode_texts),
]

#: a trained network, links over shingles and token ids cannot be stated in SQL
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stage over the whole of ``documents``, written and read again in between."""
    root = f"{stage_root(spark)}/{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, function in STAGES:
        path = f"{root}/{name}"
        function(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
