"""From raw documents to token ids: toxic documents go, then near duplicates; personal data is replaced; sources are mixed to target weights; what is left is encoded."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quiltwork.llm.hyperminhash import without_near_duplicates
from quiltwork.llm.mixing import mix
from quiltwork.llm.noisy_channel import learn, without_toxic
from quiltwork.llm.piece_codec import encode_documents
from quiltwork.llm.surrogates import replace_entities


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity score rejects go. It is learned from all labels of documents that are here."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return without_toxic(docs, learn(docs, labels, F.lit(True)))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that 0.8 of their five-word shingles join, the one with the least id stays."""
    return without_near_duplicates(docs)


def private_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data and secrets get surrogates; n_chars follows the text."""
    found = replace_entities(docs)
    return found.select(*[F.char_length("text").cast("long").alias(c) if c == "n_chars" else F.col(c) for c in docs.columns])


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources to their target weights: documents come as often as the mix takes them. Columns for shards have no place in a table of documents, so rows aren't put in their order."""
    return mix(docs, arranged=False).select(*docs.columns)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every document, with digests of ids, decoded text and source spans."""
    return encode_documents(docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxicity),
    ("near_dedup", near_dedup),
    ("private_data", private_data),
    ("mixture", mixture),
    ("token_ids", token_ids),
]
#: Scores, sketches and surrogates are beyond SQL; tests/llm/test_pipeline.py checks the stages.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after the other, over all documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
    return docs
