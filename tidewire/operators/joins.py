"""Joins between sends, acknowledgements, deliveries and their dimensions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewire.functions.latency import whole_div
from tidewire.operators.scan import DEFAULT_SPAN, Running, running


def join_send_ack(sends: DataFrame, acks: DataFrame) -> DataFrame:
    """Pair each send with its acknowledgement on (producer_id, producer_seq).

    ``outcome`` is ok, failed (the answer carries another message's id) or pending.
    The pair is unique, so the join has no hot key.
    """
    outcome = (
        F.when(F.col("ack_ms").isNull(), F.lit("pending"))
        .when(F.col("ack_id") == F.col("seq"), F.lit("ok"))
        .otherwise(F.lit("failed"))
    )
    answers = acks.select("producer_id", "producer_seq", "ack_id", "ack_ms")
    joined = sends.join(answers, ["producer_id", "producer_seq"], "left")
    return joined.withColumn("outcome", outcome).drop("ack_id")


def join_cumulative_ack(
    sends: DataFrame, answers: DataFrame, *, span: int = DEFAULT_SPAN
) -> DataFrame:
    """Settle sends by single answers and by answers that cover all tags up to theirs.

    ``sends`` has (channel, tag, ...), ``answers`` (channel, tag, at_ms, multiple,
    positive). The earliest answer settles a send; on a tie a refusal wins. Adds
    ``settled_ms`` and ``outcome`` (ok, failed, pending).

    Sends and answers are put in one line per channel, by tag. An answer for "all tags
    up to mine" is then a running minimum from the largest tag down and an answer for
    one tag a minimum over that tag: one shuffle, no pairs, and a busy channel is cut
    into blocks of tags.
    """
    # time and verdict in one number: earlier first, a refusal before an acceptance
    answer = F.col("at_ms") * F.lit(2) + F.col("positive").cast("bigint")
    given = answers.select(
        "channel",
        "tag",
        F.when(~F.col("multiple"), answer).alias("_single"),
        F.when(F.col("multiple"), answer).alias("_multi"),
    )
    line = sends.withColumn("_sent", F.lit(True)).unionByName(given, allowMissingColumns=True)
    swept = running(
        line,
        ["channel"],
        "tag",
        {
            "_covering": Running(F.col("_multi"), "min"),
            "_own": Running(F.col("_single"), "min", peers_only=True),
        },
        span=span,
        descending=True,
        with_ties=True,
    )
    first = F.least("_own", "_covering")
    outcome = (
        F.when(first.isNull(), F.lit("pending"))
        .when(first.bitwiseAND(F.lit(1)) == 1, F.lit("ok"))
        .otherwise(F.lit("failed"))
    )
    return swept.where("_sent").select(
        *sends.columns, F.shiftright(first, 1).alias("settled_ms"), outcome.alias("outcome")
    )


def join_publish_receive(sends: DataFrame, receives: DataFrame) -> DataFrame:
    """Pair every delivery with the message it delivers, on (topic, partition, seq)."""
    delivered = receives.select("topic", "partition", "seq", "subscription", "receive_ms")
    return sends.join(delivered, ["topic", "partition", "seq"])


def fan_out(sends: DataFrame, subscriptions: DataFrame) -> DataFrame:
    """Give each subscription of a topic every message of that topic.

    ``subscriptions`` has (topic, subscription, consumers); consumers of one
    subscription share its partitions. Whether that table is broadcast is left to
    its size at run time; when it is not, AQE splits a hot topic.
    """
    return sends.join(subscriptions, "topic").withColumn(
        "consumer_id", F.pmod(F.col("partition"), F.col("consumers"))
    )


def run_matrix(workloads: DataFrame, drivers: Sequence[Mapping[str, str]]) -> DataFrame:
    """Every workload with every configured driver, drivers in the given order.

    Drivers are the short list of configurations a run is started with, so they
    travel as a constant and the matrix is a projection of the workloads.
    """
    listed = F.array(*[F.struct(*[F.lit(v).alias(k) for k, v in d.items()]) for d in drivers])
    return workloads.select("*", F.posexplode(listed).alias("driver_pos", "_driver")).select(
        *workloads.columns, "driver_pos", "_driver.*"
    )


def attach_target_labels(samples: DataFrame, targets: DataFrame) -> DataFrame:
    """Add each scrape target's job and group labels to its samples.

    A target listed in several groups yields one copy of its samples per group.
    Labels of the sample itself win over those of the target.
    """
    own = F.col("labels")
    given = F.create_map(F.lit("job"), F.col("job"), F.lit("group"), F.col("group"))
    added = F.map_filter(given, lambda k, _: ~F.array_contains(F.map_keys(own), k))
    joined = samples.join(targets.select("target", "job", "group"), "target")
    return joined.withColumn("labels", F.map_concat(own, added)).drop("job", "group")


def fill_empty_periods(
    stats: DataFrame,
    keys: Sequence[str],
    period: str,
    zero: Sequence[str],
    *,
    first: Column | None = None,
    span: int = DEFAULT_SPAN,
) -> DataFrame:
    """Add the missing periods of each group, with 0 in the ``zero`` columns.

    The calendar of a long group is laid out block by block, so it is produced by
    as many tasks as it has blocks.
    """
    start = F.min(period) if first is None else first
    ranges = stats.groupBy(*keys).agg(start.alias("_from"), F.max(period).alias("_to"))
    span_lit = F.lit(span).cast("bigint")
    blocks = ranges.withColumn(
        "_block",
        F.explode(F.sequence(whole_div(F.col("_from"), span), whole_div(F.col("_to"), span))),
    ).repartition(*keys, "_block")
    low = F.greatest(F.col("_from"), F.col("_block") * span_lit)
    high = F.least(F.col("_to"), (F.col("_block") + 1) * span_lit - 1)
    calendar = blocks.select(*keys, F.explode(F.sequence(low, high)).alias(period))
    filled = calendar.join(stats, [*keys, period], "left")
    return filled.select(
        *[F.coalesce(F.col(c), F.lit(0)).alias(c) if c in zero else F.col(c) for c in stats.columns]
    )
