"""A training corpus in five stages, each written as Parquet and read again by the next."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from caseflow.llm import exact, mixture, near, packing, quality
from caseflow.llm.common import reachable, shared_folder, table


def _quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts."""
    return quality.keep_good(docs, table(reachable(spark), sf_dir, "labels"))


def _exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text."""
    reachable(spark)
    return exact.keep_first(docs)


def _near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    reachable(spark)
    return near.keep_one(docs)


def _mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of their sources takes them."""
    reachable(spark)
    return mixture.repeated_rows(docs)


def _pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where every token of every document goes: pieces in sequences of several permitted lengths."""
    reachable(spark)
    return packing.packed_documents(docs)


STAGES = [
    ("quality_classifier", _quality),
    ("exact_dedup", _exact),
    ("minhash_near_dedup", _near),
    ("source_mixing", _mix),
    ("best_fit_packing", _pack),
]

#: Ridge scores, near duplicates and best-fit packing have no SQL form; a test compares with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to ``documents``: the packed sequences of the last one."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark)}/corpus-{uuid.uuid4().hex}"
    for i, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{i}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
