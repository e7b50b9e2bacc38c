"""``op12_conversation_repair``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidewire.llm.conversations import damage, summaries
from tidewire.llm.registry import query, table


@query("op12_conversation_repair")
def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults and cheapest repair of every conversation, after damage by a hash."""
    return (
        summaries(damage(table(spark, sf_dir, "conversations")))
        .withColumnsRenamed({"conv": "conv_id", "sha256": "repaired_sha256"})
        .select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
    )
