"""``op11_whitening``; an eigendecomposition has no SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidewire.llm.registry import query, table
from tidewire.llm.whitening import whiten


@query("op11_whitening")
def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The four leading whitened values of every embedding."""
    return whiten(table(spark, sf_dir, "embeddings"))
