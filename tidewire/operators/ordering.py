"""Orders and limits of the reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def order_runs(runs: DataFrame, workload: str = "workload") -> DataFrame:
    """Runs by workload name, drivers in the order they were given."""
    return runs.orderBy(workload, "driver_pos")


def order_quantiles(curve: DataFrame, percentile: str = "percentile") -> DataFrame:
    """Curve points by the numeric percentile, also when it was read as text."""
    return curve.orderBy(F.col(percentile).cast("double"))


def take_n(rows: DataFrame, n: int, *order: str) -> DataFrame:
    return rows.orderBy(*order).limit(n)
