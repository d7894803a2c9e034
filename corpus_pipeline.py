"""From raw documents to packed training sequences, in five stages.

Each stage takes all rows that the one before kept, its decisions take effect,
and its result is written as Parquet and read again for the next one.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark import apply_settings
from tidemark.llm import decontaminate, exact_dedup, ngram_join, packing, toxicity
from tidemark.staging import stage


Step = Callable[[SparkSession, DataFrame, str], DataFrame]


def _with_settings(step: Step) -> Step:
    """Stages are also run one by one, on sessions built elsewhere."""

    @functools.wraps(step)
    def call(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        return step(apply_settings(spark), docs, sf_dir)

    return call


@_with_settings
def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity score rejects go."""
    return toxicity.drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


@_with_settings
def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with the same text, the one with the smallest doc_id stays."""
    return exact_dedup.keep_first(docs)


@_with_settings
def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that links connect, the one with the smallest doc_id stays."""
    return ngram_join.keep_first(docs)


@_with_settings
def remove_benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words of benchmark passages are cut from the texts; a text without any other word goes."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontaminate.remove_spans(docs, decontaminate.contamination(docs, benchmark))


@_with_settings
def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece of a document with its place in a training sequence."""
    placed = packing.pack(docs, columns={"ids_crc32": F.crc32("ids")})
    return placed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_copies),
    ("n-gram Jaccard join", drop_near_copies),
    ("benchmark decontamination", remove_benchmarks),
    ("best-fit packing", pack_sequences),
]

#: Scores, packing and the removal of spans have no SQL twin; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, from the table documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), "pipeline")
    return STAGES[-1][1](spark, docs, sf_dir)
