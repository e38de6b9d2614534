"""From raw documents to packed training sequences: each stage reads what the stage before it wrote.

All stages but the last give the columns of ``documents``.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketlake.llm import exact, minhash, packing, queries, repeats
from marketlake.llm import toxicity as toxic
from marketlake.llm.common import read
from marketlake.session import bounded_batches, stored

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def stage(fn: Stage) -> Stage:
    """A stage whose workers get rows in batches of bounded size."""
    @wraps(fn)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        bounded_batches(spark)
        return fn(spark, docs, sf_dir)
    return run


@stage
def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below 0.3 stay, with all their columns. The model is that of the query op2: it learns from the same labels."""
    own = "_toxicity"
    while own in docs.columns:
        own += "_"
    scored = toxic.score(docs, queries.toxicity_model(spark, sf_dir, docs), score_col=own)
    return scored.filter(F.col(own) < 0.3).drop(own)


@stage
def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each distinct text stays: the longest original, then the smallest doc_id."""
    return exact.without_copies(docs)


@stage
def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near copies the one with the smallest doc_id stays."""
    return minhash.without_near_copies(docs)


@stage
def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays, without the passages of 200 bytes or more that start anywhere else too."""
    left = repeats.without_repeats(docs, whole_characters=True).select("row.*", F.col("kept").cast("string").alias("text"))
    return left.withColumn("n_chars", F.length("text").cast("long")).select([F.col(f"`{c}`") for c in docs.columns])


@stage
def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in sequences of 2,048 tokens."""
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", toxicity),
    ("exact dedup", exact_dedup),
    ("near dedup", near_dedup),
    ("suffix-array dedup", suffix_dedup),
    ("best-fit packing", best_fit_packing),
]

#: Models, near copies and packing are beyond SQL; tests/llm/test_pipeline.py has the brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each result but the last written to the shared folder and read again."""
    docs = read(spark, sf_dir, "documents")
    for name, step in STAGES[:-1]:
        docs = stored(step(spark, docs, sf_dir), name.replace(" ", "_"))
    return STAGES[-1][1](spark, docs, sf_dir)
