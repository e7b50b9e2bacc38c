"""Chart tables from result documents: time series and quantile curves per workload."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewire.functions.latency import percentile_axis
from tidewire.functions.naming import chart_label
from tidewire.operators.filters import percentile_cutoff
from tidewire.operators.windows import sample_seconds
from tidewire.plans.reports import PERIODS_PER_DOCUMENT


def group_by_workload(results: DataFrame) -> DataFrame:
    """Number of runs and drivers of each workload, known by its own name.

    A run that goes on over several documents counts once, by its first part.
    """
    counted = results.groupBy("workload").agg(
        F.count_if(F.coalesce(F.col("part"), F.lit(0)) == 0).alias("documents"),
        F.count_distinct("driver").alias("drivers"),
    )
    return counted.withColumn("workload", chart_label(F.col("workload")))


def series(
    results: DataFrame, metric: str, *, periods_per_document: int = PERIODS_PER_DOCUMENT
) -> DataFrame:
    """(workload, driver, x, y): the i-th value of a run lies at 10 * i seconds."""
    points = results.select(
        chart_label(F.col("workload")).alias("workload"),
        "driver",
        F.coalesce(F.col("part"), F.lit(0)).alias("_part"),
        F.posexplode(metric).alias("_pos", "y"),
    )
    position = F.col("_part") * F.lit(periods_per_document) + F.col("_pos")
    return points.select("workload", "driver", sample_seconds(position).alias("x"), "y")


def series_publish_p99(results: DataFrame) -> DataFrame:
    return series(results, "publishLatency99pct")


def series_publish_rate(results: DataFrame) -> DataFrame:
    return series(results, "publishRate")


def series_consume_rate(results: DataFrame) -> DataFrame:
    return series(results, "consumeRate")


def series_e2e_avg(results: DataFrame) -> DataFrame:
    return series(results, "endToEndLatencyAvg")


def quantile_series(results: DataFrame) -> DataFrame:
    """(workload, driver, percentile, x, y) of publish latency, up to 99.999 %."""
    first_part = results.where(F.coalesce(F.col("part"), F.lit(0)) == 0)
    points = first_part.select(
        chart_label(F.col("workload")).alias("workload"),
        "driver",
        F.explode("aggregatedPublishLatencyQuantiles").alias("_percentile", "y"),
    ).withColumn("percentile", F.col("_percentile").cast("double"))
    return percentile_cutoff(points).select(
        "workload", "driver", "percentile", percentile_axis(F.col("percentile")).alias("x"), "y"
    )
