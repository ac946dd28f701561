"""A corpus pipeline of five stages; each stage's rows are written as Parquet and read again by the next.

quality classifier -> near-duplicates -> repeated passages -> mix of sources -> packing

All stages but the last return the columns of documents. No SQL can express the fitted and iterative stages
(ORACLE_SQL is None); tests hold the stages against brute force.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lithograph.llm.mixing import mix_documents
from lithograph.llm.packing import pack_documents
from lithograph.llm.quality_classifier import keep_good
from lithograph.llm.repeats import without_repeats
from lithograph.llm.simhash import keep_one
from lithograph.session import materialize


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the quality classifier rejects."""
    return keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each SimHash component and, of those, one of each group whose 5-word shingles have a similarity of 0.8 or more."""
    return keep_one(materialize(keep_one(docs), "simhash-kept"), 5, 0.8)


def repeat_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts passages that occur earlier out of the texts."""
    return without_repeats(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Samples and repeats documents towards the target weight of each source."""
    return mix_documents(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the documents into sequences of the permitted lengths."""
    return pack_documents(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_classifier", classify),
    ("near_dedup", near_dedup),
    ("suffix_array_dedup", repeat_dedup),
    ("source_mixing", mix_sources),
    ("best_fit_packing", pack_sequences),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
