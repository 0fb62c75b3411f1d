"""The corpus pipeline: documents through five stages, each one operator of cadenza.llm.

A stage takes the documents its predecessor kept and returns them with the same
columns; the last returns what to do with each document that is left.  SQL can't
express the language model, the graph of near duplicates or the fitted rates, so
there is no ORACLE_SQL; tests hold the stages against brute force.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza.llm import decontamination, language_id, mixing, near_dedup, substring_dedup
from cadenza.llm.queries import small_batches
from cadenza.llm.storage import removed, saved, shared_folder

#: Ids that are broadcast to the documents, at most; more are joined by a shuffle.
BROADCAST_IDS = 1_000_000


def without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """docs without the rows whose doc_id is in ids; documents are shuffled only if the ids are many."""
    gone = "gone_" + "_".join(docs.columns)  # a name that docs doesn't have
    ids = saved(ids.select(F.col("doc_id").alias(gone)))
    if ids.count() <= BROADCAST_IDS:
        ids = F.broadcast(ids)
    return docs.join(ids, F.col("doc_id").cast("bigint") == F.col(gone), "left_anti")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the labelled ones teach.

    Texts go that are null, empty or without a letter, and those that cost more than
    language_id.MAX_BITS in the best language (random letters, shouted junk, keys);
    rows with a null doc_id stay if their text does.
    """
    small_batches(spark)
    return language_id.keep_identified(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, the one with the smallest doc_id.

    Null and empty texts and rows with a null doc_id are no duplicates and stay; rows
    with one doc_id stay or go together.
    """
    small_batches(spark)
    return without(docs, near_dedup.classes(docs).filter("not kept"))


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that a document with a smaller doc_id has.

    A document that loses every word goes; null and empty texts lose nothing and stay,
    as do rows with a null doc_id.
    """
    small_batches(spark)
    return substring_dedup.strip(docs)


def benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no test item; null and empty texts hold none, rows with a null doc_id are not searched."""
    small_batches(spark)
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return without(docs, decontamination.contaminated(docs, items).select("doc_id").distinct())


def rates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, domain, posterior, rate and copies with which all languages have the same expected tokens."""
    small_batches(spark)
    return mixing.mix(docs, label="lang")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language),
    ("near_dedup", near_duplicates),
    ("substring_dedup", substrings),
    ("decontamination", benchmarks),
    ("mixing", rates),
]
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each stage's rows are written to the shared folder and read again, and go once the next stage's are there."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    place = f"{shared_folder(spark).rstrip('/')}/pipeline-{uuid.uuid4()}"
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs.write.parquet(f"{place}/{k}")
            docs = spark.read.parquet(f"{place}/{k}")
            if k:
                removed(spark, f"{place}/{k - 1}")  # nothing reads it any more
    return docs
