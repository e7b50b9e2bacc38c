"""Latency histograms as rows, and everything read off them.

A histogram is a set of (keys, bucket, n, deficit_us, bytes) rows;
``deficit_us`` is how far the latencies lie below the bucket's top in total, which keeps
the mean exact without ever summing large latencies into a 64-bit number. Building one is a
hash aggregation that combines on the map side; merging histograms is the same
aggregation over the rows of several. The ordered work (percentiles, curves) sees
distinct buckets only: fewer than 1.4 million for 60 s, 2.6 million for 12 h.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewire.functions.latency import hdr_bucket, us_to_ms, whole_div

# Reported quantiles, as (column suffix, ten-thousandths).
QUANTILES = (
    ("50pct", 5000), ("75pct", 7500), ("95pct", 9500),
    ("99pct", 9900), ("999pct", 9990), ("9999pct", 9999),
)

# Fixed value: points of a quantile curve per halving of the remaining tail.
TICKS_PER_HALVING = 100


def bucket_counts(
    messages: DataFrame, keys: Sequence[str], latency_us: str, size: str | None = None
) -> DataFrame:
    """Histogram of ``latency_us`` per key.

    Rows whose latency is NULL are counted in a NULL bucket: they are messages
    without a recorded latency.
    """
    size_col = F.col(size).cast("bigint") if size else F.lit(0).cast("bigint")
    bucketed = messages.withColumn("bucket", hdr_bucket(F.col(latency_us)))
    deficit = F.col("bucket") - F.col(latency_us)
    return bucketed.groupBy(*keys, "bucket").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(deficit).alias("deficit_us"),
        F.sum(size_col).alias("bytes"),
    )


def merge_histograms(histograms: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Add up histograms that differ in columns other than ``keys``."""
    return histograms.groupBy(*keys, "bucket").agg(
        F.sum("n").alias("n"),
        F.sum("deficit_us").alias("deficit_us"),
        F.sum("bytes").alias("bytes"),
    )


def _recorded(bucket: str = "bucket") -> Column:
    return F.col(bucket).isNotNull()


def cumulative(histogram: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Add ``cum`` and ``total`` counts of recorded latencies in bucket order."""
    counted = F.when(_recorded(), F.col("n")).otherwise(F.lit(0))
    # One order for both frames, so that both sums come from a single window step.
    ordered = Window.partitionBy(*keys).orderBy("bucket")
    upto = ordered.rowsBetween(Window.unboundedPreceding, 0)
    whole = ordered.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return histogram.select(
        "*", F.sum(counted).over(upto).alias("cum"), F.sum(counted).over(whole).alias("total")
    )


def latency_summary(
    histogram: DataFrame,
    keys: Sequence[str],
    quantiles: Sequence[tuple[str, int]] = QUANTILES,
) -> DataFrame:
    """Messages, bytes, recorded latencies and their mean, quantiles and maximum in ms.

    Groups without a recorded latency report 0, as an empty histogram does.
    """
    # The rank of a quantile is ceil(q * N) in whole numbers, at least 1.
    picks = [
        F.expr(
            "coalesce(min(bucket) FILTER (WHERE bucket IS NOT NULL AND "
            f"cum >= greatest((total * {q} + 9999) div 10000, 1)) / 1000.0D, 0.0D)"
        ).alias(f"latency_{suffix}")
        for suffix, q in quantiles
    ]
    total = (
        "coalesce(sum(cast(n AS decimal(20,0)) * bucket)"
        " - sum(deficit_us) FILTER (WHERE bucket IS NOT NULL), 0)"
    )
    mean = (
        f"coalesce(cast({total} AS double)"
        " / nullif(sum(n) FILTER (WHERE bucket IS NOT NULL), 0) / 1000.0D, 0.0D)"
    )
    return cumulative(histogram, keys).groupBy(*keys).agg(
        F.sum("n").alias("messages"),
        F.sum("bytes").alias("bytes"),
        F.expr("coalesce(sum(n) FILTER (WHERE bucket IS NOT NULL), 0)").alias("recorded"),
        F.expr(total).alias("recorded_us"),
        F.expr(mean).alias("latency_avg"),
        *picks,
        F.expr("coalesce(max(bucket) / 1000.0D, 0.0D)").alias("latency_max"),
    )


def quantile_curve(histogram: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Points (percentile, value_ms) of the quantile curve of each key.

    Curve levels are 100 per halving of the tail. With ``p`` of ``N`` counts below
    a bucket and ``c`` up to it, let 2^k be the largest power of two with
    (N-p) * 2^k <= N. The next level above p/N is reached inside the bucket iff
    (j+1) * N <= 200 * (N - (N-c) * 2^k), j = 200 * (N - (N-p) * 2^k) / N.
    Everything is whole-number arithmetic, so no level is lost to rounding.
    """
    steps = F.lit(2 * TICKS_PER_HALVING)
    recorded = cumulative(histogram.where(_recorded()), keys)
    below = F.col("cum") - F.col("n")
    left = F.col("total") - below
    halvings = F.length(F.bin(whole_div(F.col("total"), left))) - F.lit(1)
    scale = F.call_function("shiftleft", F.lit(1).cast("bigint"), halvings)
    staged = recorded.withColumn("_below", below).withColumn("_scale", scale)
    total, c = F.col("total"), F.col("cum")
    step_index = whole_div(steps * (total - (total - F.col("_below")) * F.col("_scale")), total)
    reached = (step_index + F.lit(1)) * total <= steps * (total - (total - c) * F.col("_scale"))
    on_curve = (F.col("_below") == 0) | (c == total) | reached
    return staged.where(on_curve).select(
        *keys,
        (F.lit(100.0) * c / total).alias("percentile"),
        us_to_ms(F.col("bucket")).alias("value_ms"),
    )
