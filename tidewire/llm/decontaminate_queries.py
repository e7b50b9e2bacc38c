"""``op2_decontaminate``; greedy tiling has no SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.llm.decontaminate import overlaps
from tidewire.llm.registry import query, table


@query("op2_decontaminate")
def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document that covers a benchmark item, with the item and how much of it."""
    found = overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", F.lit(True).alias("contaminated"), "covered", "tiles", "longest_tile", "item_words")
