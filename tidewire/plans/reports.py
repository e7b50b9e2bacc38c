"""From message logs to per-period reports and result documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewire.functions.latency import e2e_latency_us, whole_div
from tidewire.operators.aggregates import (
    COUNTERS, PERIOD_MS, backlog, period_counters, period_of, period_rates, running_totals,
)
from tidewire.operators.filters import WARMUP_MS, positive_latency, successful_only
from tidewire.operators.histograms import (
    bucket_counts, latency_summary, merge_histograms, quantile_curve,
)
from tidewire.operators.joins import fill_empty_periods
from tidewire.operators.lineage import stored
from tidewire.schemas import LATENCY_STATS, SIDES

RUN = ["run_id"]
PERIODS_PER_DOCUMENT = 8_640  # one day of 10 s periods


def _suffix(stat: str) -> str:
    return f"latency_{stat.lower()}"


def publish_latencies(sends: DataFrame) -> DataFrame:
    """Successful sends after warm-up, placed in their period."""
    kept = successful_only(sends).where(F.col("send_ms") >= WARMUP_MS)
    return kept.select(
        *RUN, period_of(F.col("send_ms")).alias("period"), "latency_us", "bytes"
    )


def e2e_latencies(receives: DataFrame) -> DataFrame:
    """Deliveries after warm-up; a latency of zero is counted but not recorded."""
    kept = receives.where(F.col("receive_ms") >= WARMUP_MS)
    latency = positive_latency(e2e_latency_us(F.col("publish_ms"), F.col("receive_ms")))
    return kept.select(
        *RUN, period_of(F.col("receive_ms")).alias("period"), latency.alias("latency_us"), "bytes"
    )


def period_histograms(sends: DataFrame, receives: DataFrame) -> DataFrame:
    """Everything a report needs, in one pass over the messages: per run, period and
    side (``kind``) the message counts, bytes and latency buckets.

    All successful sends and all deliveries are counted; latencies are recorded from
    the end of warm-up on, and a delivery with a latency of zero is not recorded.
    """
    sent = successful_only(sends).select(
        *RUN,
        F.lit("publish").alias("kind"),
        F.col("send_ms").alias("at_ms"),
        "latency_us",
        "bytes",
    )
    e2e = positive_latency(e2e_latency_us(F.col("publish_ms"), F.col("receive_ms")))
    received = receives.select(
        *RUN,
        F.lit("endToEnd").alias("kind"),
        F.col("receive_ms").alias("at_ms"),
        e2e.alias("latency_us"),
        "bytes",
    )
    messages = sent.unionByName(received).select(
        *RUN,
        "kind",
        period_of(F.col("at_ms")).alias("period"),
        F.when(F.col("at_ms") >= WARMUP_MS, F.col("latency_us")).alias("latency_us"),
        "bytes",
    )
    return bucket_counts(messages, [*RUN, "period", "kind"], "latency_us", "bytes")


def flagship(sends: DataFrame) -> DataFrame:
    """Publish rate and latency of each 10 s period after warm-up."""
    groups = [*RUN, "period"]
    stats = latency_summary(
        bucket_counts(publish_latencies(sends), groups, "latency_us", "bytes"), groups
    )
    seconds = F.lit(PERIOD_MS / 1000)
    return stats.select(
        *groups,
        "messages",
        (F.col("messages") / seconds).alias("publish_rate"),
        "latency_avg", "latency_50pct", "latency_99pct", "latency_max",
    )


def _of_side(side: str, value: Column | str) -> Column:
    """Value in the row of one side, to be picked out by ``max`` over both rows."""
    return F.max(F.when(F.col("kind") == side, F.col(value) if isinstance(value, str) else value))


def period_report(
    histograms: DataFrame, subscriptions: Column, message_size: Column
) -> DataFrame:
    """One row per run and period, idle ones included: rates, backlog and both latency summaries.

    Totals count from the start of the run; reported periods start after warm-up.
    """
    groups = [*RUN, "period"]
    both = latency_summary(histograms, [*groups, "kind"])
    zero = F.lit(0).cast("bigint")
    counters = [
        F.coalesce(_of_side(side, source), zero).alias(f"{source}_{name}")
        for side, name in (("publish", "sent"), ("endToEnd", "received"))
        for source in ("messages", "bytes")
    ]
    latencies = [
        F.coalesce(_of_side(side, _suffix(s)), F.lit(0.0)).alias(f"{side}_{_suffix(s)}")
        for side in SIDES
        for s in LATENCY_STATS
    ]
    counted = stored(both.groupBy(*groups).agg(*counters, *latencies))
    every = fill_empty_periods(counted, RUN, "period", counted.columns[len(groups) :])
    totals = running_totals(stored(every))
    rated = backlog(period_rates(totals), subscriptions, message_size)
    return rated.where(F.col("period") >= period_of(F.lit(WARMUP_MS)))


def run_summary(histograms: DataFrame) -> DataFrame:
    """Whole-run latency and quantile curve of both sides, one row per run and kind."""
    groups = [*RUN, "kind"]
    merged = merge_histograms(histograms, groups)
    summary = latency_summary(merged, groups).select(
        *groups, *[_suffix(s) for s in LATENCY_STATS]
    )
    curve = quantile_curve(merged, groups)
    # A curve has about 100 points per halving of the tail, however many messages.
    points = curve.groupBy(*groups).agg(
        F.map_from_entries(
            F.array_sort(
                F.collect_list(F.struct(F.col("percentile").cast("string"), F.col("value_ms")))
            )
        ).alias("quantiles")
    )
    return summary.join(points, groups, "left")


def collect_series(
    report: DataFrame, columns: dict[str, str], *, periods_per_document: int = PERIODS_PER_DOCUMENT
) -> DataFrame:
    """Period rows as arrays in period order; ``columns`` maps array name to column.

    ``report`` has all periods of a run from its first to its last. They are numbered
    from the first one. A run longer than ``periods_per_document`` continues in further
    parts, so no array grows without bound and no period is left out.
    """
    firsts = report.groupBy(*RUN).agg(F.min("period").alias("_first"))
    part = whole_div(F.col("period") - F.col("_first"), periods_per_document)
    point = F.struct("period", *[F.col(c).alias(name) for name, c in columns.items()])
    collected = report.join(firsts, RUN).groupBy(*RUN, part.alias("part")).agg(
        F.array_sort(F.collect_list(point)).alias("_points")
    )
    return collected.select(
        *RUN, "part", *[F.col(f"_points.{name}").alias(name) for name in columns]
    )


def series_documents(
    sends: DataFrame, receives: DataFrame, runs: DataFrame, metric: str
) -> DataFrame:
    """Documents with one array only, from no more of the messages than it takes.

    ``metric`` is publishRate, consumeRate or a latency of one side, such as
    endToEndLatencyAvg.
    """
    counters = period_counters(successful_only(sends), receives, RUN)
    every = fill_empty_periods(stored(counters), RUN, "period", COUNTERS)
    report = period_rates(every).where(F.col("period") >= period_of(F.lit(WARMUP_MS)))
    columns = {"publishRate": "publish_rate", "consumeRate": "consume_rate"}
    if metric not in columns:
        side, stat = metric.split("Latency")
        rows = publish_latencies(sends) if side == "publish" else e2e_latencies(receives)
        groups = [*RUN, "period"]
        stats = latency_summary(bucket_counts(rows, groups, "latency_us"), groups)
        report = report.join(stats.select(*groups, _suffix(stat)), groups, "left").withColumn(
            _suffix(stat), F.coalesce(_suffix(stat), F.lit(0.0))
        )
        columns[metric] = _suffix(stat)
    return collect_series(report, {metric: columns[metric]}).join(runs, RUN).drop(*RUN)


def curve_documents(sends: DataFrame, runs: DataFrame) -> DataFrame:
    """Documents with the publish latency's quantile curve only."""
    groups = [*RUN, "kind"]
    published = publish_latencies(sends).withColumn("kind", F.lit(SIDES[0]))
    curves = run_summary(bucket_counts(published, groups, "latency_us")).select(
        *RUN, F.lit(0).cast("bigint").alias("part"), F.col("quantiles").alias("aggregatedPublishLatencyQuantiles")
    )
    return curves.join(runs, RUN).drop(*RUN)


def result_documents(
    sends: DataFrame, receives: DataFrame, runs: DataFrame,
    *, subscriptions: int, message_size: int,
) -> DataFrame:
    """Result documents; ``runs`` gives workload and driver of each run_id."""
    histograms = stored(period_histograms(sends, receives))
    report = period_report(histograms, F.lit(subscriptions), F.lit(message_size))
    columns = {"publishRate": "publish_rate", "consumeRate": "consume_rate", "backlog": "backlog"}
    for side in SIDES:
        columns |= {f"{side}Latency{s}": f"{side}_{_suffix(s)}" for s in LATENCY_STATS}
    series = collect_series(report, columns)
    aggregated = []
    for side in SIDES:
        upper = side[0].upper() + side[1:]
        aggregated += [
            _of_side(side, _suffix(s)).alias(f"aggregated{upper}Latency{s}") for s in LATENCY_STATS
        ]
        of_side = F.first(F.when(F.col("kind") == side, F.col("quantiles")), ignorenulls=True)
        aggregated.append(of_side.alias(f"aggregated{upper}LatencyQuantiles"))
    whole = run_summary(histograms).groupBy(*RUN).agg(*aggregated)
    return series.join(whole, RUN, "left").join(runs, RUN).drop(*RUN)
