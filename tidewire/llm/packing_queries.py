"""``op13_retrieval_packing``; a greedy packing over a tokenizer's ids has no SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidewire.llm.packing import pack
from tidewire.llm.registry import query, table


@query("op13_retrieval_packing")
def op13_retrieval_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of at most 4,096 tokens."""
    return pack(table(spark, sf_dir, "documents"))
