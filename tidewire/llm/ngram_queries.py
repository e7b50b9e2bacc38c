"""``op7_ngram_trie``; the model's score has no SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidewire.llm.ngram_trie import scored
from tidewire.llm.registry import query, table


@query("op7_ngram_trie")
def op7_ngram_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log probability of every document under the trained model, and under word counts."""
    return scored(table(spark, sf_dir, "documents"))
