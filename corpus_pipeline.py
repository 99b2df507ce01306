"""A corpus run in stages: each takes the rows that its predecessor kept, and its decisions take effect."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagspark.llm import decontaminate, exact, minhash, pieces, toxicity
from tagspark.llm.common import held_out
from tagspark.session import written

TOXIC = 0.3
NEAR_PERCENT = 80


def clean_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the factorization machine scores below 0.3; it learns from three quarters of the labels."""
    labels = spark.read.parquet(f"{sf_dir.rstrip('/')}/labels.parquet")
    machine = toxicity.train(docs, labels, ~held_out("doc_id", 4, 2))
    return toxicity.score(docs, machine, name="_toxicity").filter(F.col("_toxicity") < TOXIC).drop("_toxicity")


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the largest id stays."""
    return exact.exact_dedup(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by shared shingles, directly or through others, the smallest id stays."""
    return minhash.near_dedup(docs, percent=NEAR_PERCENT)


def benchmark_free(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir.rstrip('/')}/benchmark.parquet"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Number and digest of the ids of every text that is left, digest of their decoding, and whether it is the text."""
    return pieces.round_trip(docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES = [("toxicity", clean_language), ("exact dedup", exact_copies), ("near dedup", near_copies),
          ("decontamination", benchmark_free), ("sentencepiece", tokens)]
# Learned scores, minimum hashes and token ids are not SQL; tests hold the run against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on `documents`; each result is written and read again as the next one's rows."""
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
