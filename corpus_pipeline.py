"""The corpus pipeline: toxicity, exact dedup, near-dedup, decontamination, mixing.

Every stage works on all that the one before has kept. A stage's result is written as Parquet and read again; what a
stage staged for itself is deleted when the next one begins, or the last one has ended.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from tidegauge.llm import decontaminate, exact_dedup, mixing, near_copies, toxicity
from tidegauge.llm.tables import delete, new_folder, stage_of, table


def stage(f: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """A stage; it deletes what the stages before it staged."""

    @wraps(f)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        with stage_of(sf_dir, docs):
            return f(spark, docs, sf_dir)

    return run


@stage
def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression classifier scores below 0.5; it learns from the labels of ``docs``."""
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


@stage
def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of byte-equal texts, the document with the largest id."""
    return exact_dedup.drop_copies(docs)


@stage
def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (5-word Jaccard similarity of 0.8 or more), the document with the least id."""
    return near_copies.keep_one_of_each(docs)


@stage
def without_benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any 10-word passage of a benchmark item."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


@stage
def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixed corpus: shard, position, doc_id, source, epoch, block, words, text; a row per drawn block of a document."""
    return mixing.mixed_corpus(docs)


STAGES = [
    ("toxicity", without_toxic),
    ("exact dedup", without_copies),
    ("near dedup", without_near_copies),
    ("decontamination", without_benchmarks),
    ("mixing", mixed),
]

#: SQL can express neither the classifier, the fingerprints nor the draw: the stages are tested one by one instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mixed corpus of the folder's documents; an empty table gives an empty one, null and repeated ids are documents like any other."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, make in STAGES:
        path = new_folder(spark, name.replace(" ", "-"))
        kept = make(spark, docs, sf_dir)
        kept.write.option("compression", "zstd").parquet(path)
        docs = spark.read.schema(kept.schema).parquet(path)
        if before:
            delete(spark, before)
        before = path
    with stage_of(sf_dir):
        return docs
