"""A corpus pipeline: toxic documents go, then near-duplicates, then leaks; the rest is mixed and sharded.

Each stage is a function of (spark, docs, sf_dir); ``run`` writes what it returns to the shared
folder and reads it back as the next stage's documents. All stages but the last return
the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidewire.llm.bag_minhash import one_of_each
from tidewire.llm.decontaminate import decontaminated
from tidewire.llm.mixing import mixture
from tidewire.llm.registry import table
from tidewire.llm.sharding import assign_shards
from tidewire.llm.toxicity import without_toxic
from tidewire.operators.lineage import stored
from tidewire.session import configure

SHARDS = 40


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents whose toxicity score is below the threshold."""
    return without_toxic(docs, table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class."""
    return one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that don't cover an item of the benchmark."""
    return decontaminated(docs, table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of their sources takes them."""
    return mixture(docs)


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their shard, and the one that they would have with one more."""
    return assign_shards(assign_shards(docs, SHARDS), SHARDS + 1, into="grown_shard")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxicity),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("mixing", mixing),
    ("sharding", sharding),
]

#: Learned scores and similarity classes have no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(configure(spark), sf_dir, "documents")
    for number, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES) - 1:
            docs = stored(docs, name)
    return docs
