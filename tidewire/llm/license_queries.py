"""``op1_license_scan``; chained spans have no SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidewire.llm.license_scan import license_scan
from tidewire.llm.registry import query, table


@query("op1_license_scan")
def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places of license phrases and covered license templates in every document."""
    return license_scan(table(spark, sf_dir, "documents")).drop("spans")
