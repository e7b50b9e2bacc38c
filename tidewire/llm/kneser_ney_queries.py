"""``op8_kneser_ney``; a model's perplexities are tested against brute force."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidewire.llm.kneser_ney import classified
from tidewire.llm.registry import query, table


@query("op8_kneser_ney")
def op8_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The perplexity of every document, and whether it is kept."""
    return classified(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
