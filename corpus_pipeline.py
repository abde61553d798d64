"""From raw documents to packed training sequences, in stages that each read what the last one wrote."""

from __future__ import annotations

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import ledgerloom
from ledgerloom.llm import bin_packing, jaccard_join, mixing, quality_divergence, queries, secret_forest
from ledgerloom.runtime import cut

# Python helpers travel with the tasks, so executors need no installed copy of the package.
cloudpickle.register_pickle_by_value(ledgerloom)

BUDGET_PERCENT = 75


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the quality rules reject."""
    return quality_divergence.kept_documents(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near copies: sets of five words, a similarity of 0.8."""
    return jaccard_join.one_of_each(docs, width=5, percent=80)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces secrets in the texts."""
    return secret_forest.redact(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes documents by the target weights of their domain, language and source, each at most once."""
    domain = mixing.source_domain()
    _, leaves = mixing.plan(docs, domain, BUDGET_PERCENT, 1, queries.WEIGHTS)
    return mixing.copies(docs, leaves, domain).select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns])


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into sequences of 1024 tokens."""
    return bin_packing.pack(docs)


STAGES = [
    ("quality", quality),
    ("near_copies", near_copies),
    ("secrets", secrets),
    ("mix", mix),
    ("pack", pack),
]

# The ids come from a tokenizer library, which SQL has not; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
