"""A corpus pipeline of five stages; each takes (spark, docs, sf_dir) and returns what it keeps.

Filtering stages return the columns of documents as they came; the secret scan also rewrites texts (and n_chars); the
last returns token ids. run() writes each stage's result as Parquet in the shared folder, where the next one reads it.

In every stage: texts are taken whole, however long; a null text counts as an empty one; null doc_ids are kept apart from
all others; rows may repeat; other columns stay as they are, whatever their names and types; no rows give no rows."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pricewell.llm import byte_bpe, decontaminate, near_dedup, quality_rules, secret_scan
from pricewell.llm.common import settle, table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep: 20 words or more, few repeats, and no outlier of their language and source.
    A null or empty text goes; equal rows stay or go together; ties of distance share their verdict."""
    return quality_rules.keep_quality(docs)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the smallest doc_id, of equal ids the smallest text hash, of equal rows one.
    Null and empty texts are one group; rows without a doc_id stay only where nothing with one is linked to them."""
    return near_dedup.keep_first(docs)


def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which windows of benchmark items cover less than a twentieth of the words. A null or empty text stays."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The same rows with <kind> in place of each secret; where spans overlap, the first one's kind. A null text stays null."""
    return secret_scan.redact(docs)


def encode_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids): the token ids of every text; a null or empty text has none."""
    encoded = byte_bpe.encode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return encoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [("quality_rules", quality_stage), ("near_dedup", near_dedup_stage), ("decontaminate", decontaminate_stage), ("secret_scan", secret_stage), ("byte_bpe", encode_stage)]

#: SQL has no determinant estimates, SimHash components, automata or byte-pair merges; tests/llm/test_pipeline.py holds run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = settle(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
