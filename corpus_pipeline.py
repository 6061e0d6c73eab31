"""A training-data pipeline: documents in, token ids of clean, distinct documents out.

Each stage gets what the stage before it kept, as a table, and returns the columns of documents; the last one returns
ids. Stages never change rows that they do not decide on, and each holds for NULL, empty, repeated and very long texts
and for extra columns as the docstring of its operator says. An empty table passes through as an empty table.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tamis.llm import dart_minhash, gam_quality, matrix_bpe, site_spread, tiling
from tamis.llm.common import table
from tamis.session import materialize


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality model rejects go. It learns from labels that are not held out."""
    model = gam_quality.train(docs, table(spark, sf_dir, "labels"))
    return gam_quality.keep_good(docs, model)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines on ten or more sites go from every text; no document goes. ``n_chars`` follows the text."""
    kept = site_spread.drop_boilerplate(docs)
    return kept.withColumn("n_chars", F.length("text").cast(dict(docs.dtypes)["n_chars"]))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near duplicates the document of the least id stays."""
    return dart_minhash.drop_near_duplicates(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that leak a benchmark item go."""
    return tiling.drop_leaking(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids and the digests of the ids and of the bytes that they decode to."""
    coded = matrix_bpe.encode_documents(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return coded.withColumnRenamed("key", "doc_id")


STAGES = [
    ("quality classifier", quality),
    ("line dedup", line_dedup),
    ("MinHash near-dedup", near_dedup),
    ("benchmark decontamination", decontaminate),
    ("byte-level BPE", encode),
]

# SQL expresses neither the fitted model nor the tiling nor BPE; tests hold each stage against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), "stage")
    return STAGES[-1][1](spark, docs, sf_dir)
