"""``op5_compression_bands``; compression has no SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidewire.llm.compression_bands import compression_bands
from tidewire.llm.registry import query, table


@query("op5_compression_bands")
def op5_compression_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, compressed shares and verdict of every document."""
    return compression_bands(table(spark, sf_dir, "documents"))
