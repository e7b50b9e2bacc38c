"""``op10_bag_minhash``; similarity classes are tested against brute force."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidewire.llm.bag_minhash import near_duplicates
from tidewire.llm.registry import query, table


@query("op10_bag_minhash")
def op10_bag_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The near-duplicate class of every document."""
    return near_duplicates(table(spark, sf_dir, "documents"))
