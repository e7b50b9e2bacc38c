"""Counter-rate queries over metric samples, evaluated on a time grid.

Samples are (name, labels, ts_ms, value). A query asks, for every grid time t, about
the samples of one series in [t - look-back, t].

Each series is cut into blocks of time and every sample is placed in the block of
each grid time it can serve: its own block and, near the end of a block, the next.
With blocks much longer than the look-back that copies few samples, bounds every
sort by the length of a block rather than of a series, and needs one shuffle for
any look-back and step. Inside a block each sample knows its predecessor, its
successor and its look-back, and is turned into exactly the grid times at which it
is the latest.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewire.functions.labels import label, label_match, series_id
from tidewire.functions.latency import whole_div

STEP_MS = 15_000
INSTANT_MS = 5 * 60_000
BLOCK_MS = 24 * 3_600_000

Selector = tuple[str, str, str]


def select_series(samples: DataFrame, name: str, *selectors: Selector) -> DataFrame:
    chosen = samples.where(F.col("name") == name)
    for key, op, value in selectors:
        chosen = chosen.where(label_match(F.col("labels"), key, op, value))
    return chosen


def _placed(samples: DataFrame, range_ms: int, block_ms: int) -> tuple[DataFrame, Window]:
    """Samples copied into every block they can serve, and the window of one block."""
    ts = F.col("ts_ms")
    blocks = F.sequence(whole_div(ts, block_ms), whole_div(ts + F.lit(range_ms), block_ms))
    placed = samples.withColumn("_series", series_id(F.col("name"), F.col("labels"))).withColumn(
        "_block", F.explode(blocks)
    )
    return placed, Window.partitionBy("_series", "_block").orderBy("ts_ms")


def _grid(range_ms: int, step_ms: int, block_ms: int) -> Column:
    """Grid times of this block at which the row is the latest sample of its series, as an array."""
    step = F.lit(step_ms).cast("bigint")
    first_ms = F.greatest(F.col("ts_ms"), F.col("_block") * F.lit(block_ms))
    first = whole_div(first_ms + step - 1, step_ms) * step
    last = F.least(
        F.coalesce(F.col("_next") - 1, F.lit(2**62)),
        F.col("ts_ms") + F.lit(range_ms),
        (F.col("_block") + 1) * F.lit(block_ms) - 1,
    )
    return F.when(first <= last, F.sequence(first, last, step)).otherwise(F.array().cast("array<bigint>"))


def _grid_times(range_ms: int, step_ms: int, block_ms: int) -> Column:
    return F.explode(_grid(range_ms, step_ms, block_ms))


def irate(
    samples: DataFrame, range_ms: int, *, step_ms: int = STEP_MS, block_ms: int = BLOCK_MS
) -> DataFrame:
    """Per-second rate from the last two samples of the look-back.

    A drop means the counter restarted, so the new value is the growth. With fewer
    than two samples there is no point.
    """
    placed, block = _placed(samples, range_ms, block_ms)
    seen = (
        placed.withColumn("_next", F.lead("ts_ms").over(block))
        .withColumn("_prev_ts", F.lag("ts_ms").over(block))
        .withColumn("_prev", F.lag("value").over(block))
    )
    points = seen.select("*", _grid_times(range_ms, step_ms, block_ms).alias("t_ms"))
    pair = points.where(F.col("_prev_ts") >= F.col("t_ms") - F.lit(range_ms))
    grown = F.when(F.col("value") < F.col("_prev"), F.col("value")).otherwise(
        F.col("value") - F.col("_prev")
    )
    seconds = (F.col("ts_ms") - F.col("_prev_ts")) / F.lit(1000.0)
    return pair.select("name", "labels", "t_ms", (grown / seconds).alias("value"))


def instant(
    samples: DataFrame,
    range_ms: int = INSTANT_MS,
    *,
    step_ms: int = STEP_MS,
    block_ms: int = BLOCK_MS,
) -> DataFrame:
    """Latest sample at or before each grid time, if it is recent enough."""
    placed, block = _placed(samples, range_ms, block_ms)
    seen = placed.withColumn("_next", F.lead("ts_ms").over(block))
    return seen.select(
        "name", "labels", _grid_times(range_ms, step_ms, block_ms).alias("t_ms"), "value"
    )


def increase(
    samples: DataFrame, range_ms: int, *, step_ms: int = STEP_MS, block_ms: int = BLOCK_MS
) -> DataFrame:
    """Growth over the look-back, corrected for restarts and extended to its edges.

    The sampled span is stretched towards either edge of the look-back: all the way
    when the edge is closer than 1.1 mean sample distances, else by half a
    distance; at the start never to before the point where the counter was zero.
    """
    placed, block = _placed(samples, range_ms, block_ms)
    dropped = F.when(F.col("value") < F.col("_prev"), F.col("_prev")).otherwise(F.lit(0.0))
    seen = (
        placed.withColumn("_next", F.lead("ts_ms").over(block))
        .withColumn("_prev", F.lag("value").over(block))
        .withColumn("_lift", F.sum(dropped).over(block.rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("_rank", F.row_number().over(block))
    )
    # Every sample, and behind the start of each look-back a mark; backwards in time a mark has just passed
    # the first sample of its look-back.
    sample = F.struct("ts_ms", "value", "_lift", "_rank")
    grid = _grid(range_ms, step_ms, block_ms)
    marks = F.transform(grid, lambda t: F.struct((t - F.lit(range_ms)).alias("_at"), t.alias("t_ms")))
    own = F.array(F.struct(F.col("ts_ms").alias("_at"), F.lit(None).cast("bigint").alias("t_ms")))
    merged = seen.select("_series", "_block", "name", "labels", sample.alias("_last"), F.inline(F.concat(own, marks)))
    is_mark = F.col("t_ms").isNotNull()
    backwards = Window.partitionBy("_series", "_block").orderBy(F.desc("_at"), is_mark, F.desc("_last._rank"))
    first = F.last(F.when(~is_mark, F.col("_last")), ignorenulls=True)
    passed = backwards.rowsBetween(Window.unboundedPreceding, 0)
    inside = (
        merged.withColumn("_first", first.over(passed))
        .where(is_mark & (F.col("_first._rank") < F.col("_last._rank")))
        .select("name", "labels", "t_ms", "_first", "_last.*")
    )
    start, first = F.col("t_ms") - F.lit(range_ms), F.col("_first")
    growth = (F.col("value") + F.col("_lift")) - (first["value"] + first["_lift"])
    sampled = (F.col("ts_ms") - first["ts_ms"]) / F.lit(1000.0)
    distance = sampled / (F.col("_rank") - first["_rank"])
    limit = distance * F.lit(1.1)
    to_start = (first["ts_ms"] - start) / F.lit(1000.0)
    to_end = (F.col("t_ms") - F.col("ts_ms")) / F.lit(1000.0)
    to_zero = F.when(
        (growth > 0) & (first["value"] >= 0), sampled * (first["value"] / growth)
    )
    near_start = F.least(to_start, to_zero)
    stretched = (
        sampled
        + F.when(near_start < limit, near_start).otherwise(distance / 2)
        + F.when(to_end < limit, to_end).otherwise(distance / 2)
    )
    return inside.select("name", "labels", "t_ms", (growth * stretched / sampled).alias("value"))


def sum_by(points: DataFrame, *names: str) -> DataFrame:
    return _by(points, names, F.sum("value"))


def avg_by(points: DataFrame, *names: str) -> DataFrame:
    return _by(points, names, F.avg("value"))


def _by(points: DataFrame, names: Sequence[str], value: Column) -> DataFrame:
    keyed = points.select(
        "t_ms", "value", *[label(F.col("labels"), n).alias(f"_l_{n}") for n in names]
    )
    totals = keyed.groupBy("t_ms", *[f"_l_{n}" for n in names]).agg(value.alias("value"))
    kept = [x for n in names for x in (F.lit(n), F.col(f"_l_{n}"))]
    labels = F.create_map(*kept) if kept else F.expr("cast(map() as map<string,string>)")
    return totals.select(labels.alias("labels"), "t_ms", "value")
