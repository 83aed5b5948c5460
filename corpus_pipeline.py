"""A training-corpus pipeline over the table ``documents``.

Each stage takes (spark, docs, sf_dir) and works on all that the one before kept;
it is written as Parquet and read again. All stages but the last return the
columns of ``documents``. A row without an id can't be named by a decision, so
the filtering stages keep it.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.llm import bpe, decontam, pii, simhash, toxicity
from tickloom.llm.common import read, written

#: Score from which a document is rejected as toxic.
TOXIC = 0.7


def _without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """``docs`` without the ids in ``gone``."""
    return docs.join(gone.select("doc_id").distinct(), "doc_id", "left_anti").select(docs.columns)


def toxic_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity models reject go."""
    scored = toxicity.score(docs, read(spark, sf_dir, "labels"))
    return _without(docs, scored.where(F.col("score") >= TOXIC))


def near_copies_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by SimHash (three-word shingles, at most two bits) the smallest id stays."""
    linked = simhash.near_duplicates(docs, words=3)
    return _without(docs, linked.where(F.col("doc_id") > F.col("component_id")))


def benchmark_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold benchmark passages go."""
    judged = decontam.contamination(docs, read(spark, sf_dir, "benchmark"))
    return _without(docs, judged.where("contaminated"))


def private_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data give way to their kind; n_chars follows the text."""
    return pii.redact(docs).withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast("long")))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of the texts that are left, and the texts they decode to."""
    coded = bpe.encode(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    return coded.select("doc_id", "n_tokens", "ids", F.col("decoded").cast("string").alias("decoded"))


STAGES = [
    ("toxicity", toxic_out),
    ("simhash", near_copies_out),
    ("decontamination", benchmark_out),
    ("pii", private_out),
    ("bpe", encoded),
]

#: SQL can't express the models of the first stage; a test holds run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table ``documents``."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
