"""All queries of this subpackage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidewire.llm import (  # noqa: F401  (register on import)
    bag_minhash_queries,
    compression_queries,
    conversation_queries,
    decontaminate_queries,
    kneser_ney_queries,
    language_queries,
    license_queries,
    mixing_queries,
    ngram_queries,
    packing_queries,
    sharding_queries,
    toxicity_queries,
    whitening_queries,
)
from tidewire.llm.registry import ORACLES, QUERIES, Query
from tidewire.session import configure


def _configured(query: Query) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return query(configure(spark), sf_dir)

    return run


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: _configured(query) for name, query in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
