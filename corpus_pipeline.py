"""Corpus pipeline: documents to packed training sequences, one stage after the other.

Each stage takes what the one before it kept, written as Parquet and read again.  All but the last return the
columns of the documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factorloom.llm import exactdedup, jaccardjoin, packing, secretscan, toxicity
from factorloom.llm.catalog import WORD_VOCABULARY
from factorloom.plans.shipping import ship_package
from factorloom.plans.staging import stage


def not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the network predicts toxic (score of 0.3 or more) go."""
    ship_package(spark)
    net = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.keep_below(docs, net, threshold=0.3)


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest id stays."""
    return exactdedup.drop_duplicates(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts linked by five-word shingles at a similarity of 0.8 or more the row with the least id stays."""
    ship_package(spark)
    return jaccardjoin.keep_one_of_each(docs, words=5, percent=80)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays; secrets in its text are replaced by their kind, and the length follows."""
    return secretscan.redact(docs).withColumn("n_chars", F.coalesce(F.char_length("text").cast("long"), "n_chars"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Boundary records of the packed sequences, with the ids of each piece."""
    ship_package(spark)
    return packing.pack_documents(docs, WORD_VOCABULARY)


STAGES = [
    ("toxicity", not_toxic), ("exact_dedup", exact_copies), ("ngram_jaccard", near_copies), ("secret_scan", secrets),
    ("packing", packed),
]

#: The network of the first stage can't be written in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
