"""Payload stamping, JSON payload fields, publish-time carriers, routing keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewire.functions.latency import whole_div

STAMP_BYTES = 8


def stamp_payload(payload: Column, epoch_ms: Column) -> Column:
    """Prefix a binary payload with its send time as 8 big-endian bytes."""
    stamp = F.unhex(F.lpad(F.hex(epoch_ms.cast("bigint")), 2 * STAMP_BYTES, "0"))
    return F.concat(stamp, payload.cast("binary"))


def stamped_time(stamped: Column) -> Column:
    """Send time in front of a stamped payload; NULL when it is too short to hold one."""
    head = F.hex(F.substring(stamped, 1, STAMP_BYTES))
    value = F.conv(head, 16, -10).cast("bigint")
    return F.when(F.octet_length(stamped) >= F.lit(STAMP_BYTES), value)


def unstamped_payload(stamped: Column) -> Column:
    rest = F.substring(stamped, F.lit(STAMP_BYTES + 1), F.octet_length(stamped))
    return F.when(F.octet_length(stamped) >= F.lit(STAMP_BYTES), rest).otherwise(stamped)


def set_json_field(payload: Column, name: str, value: Column) -> Column:
    """Set one top-level field of a JSON object given as text.

    Text that is empty, malformed or not an object comes back unchanged.
    """
    fields = F.from_json(payload, "map<string,variant>")
    others = F.map_filter(fields, lambda k, _: k != F.lit(name))
    added = F.create_map(F.lit(name), F.parse_json(value.cast("string")))
    changed = F.to_json(F.map_concat(others, added))
    is_object = F.ltrim(payload).startswith("{")
    return F.when(is_object, F.coalesce(changed, payload)).otherwise(payload)


def normalize_publish_ts(
    system: Column, clock: Column, reply_to: Column, stamped: Column
) -> Column:
    """Epoch milliseconds at which a message was published, whatever carried it.

    ``clock`` is the number in the record, property or id of the system in that
    system's unit; ``reply_to`` is a decimal string; ``stamped`` is a payload with
    a leading stamp. Unknown systems and missing carriers give NULL.
    """
    in_ms = system.isin("kafka", "pulsar", "rocketmq", "artemis", "nsq", "distributedlog")
    return (
        F.when(in_ms, clock)
        .when(system == "rabbitmq", clock * F.lit(1000))
        .when(system == "nats-streaming", whole_div(clock, 1_000_000))
        .when(system == "nats", reply_to.try_cast("bigint"))
        .when(system == "stamped-stream", stamped_time(stamped))
    )


def routing_key(system: Column, key: Column) -> Column:
    """A missing key routes as the empty string on one system and stays absent on the rest."""
    return F.when(system == "rabbitmq", F.coalesce(key, F.lit(""))).otherwise(key)
