"""Canonical schemas; readers never infer."""

from __future__ import annotations

from pyspark.sql import types as T

_STRING, _LONG, _DOUBLE = T.StringType(), T.LongType(), T.DoubleType()


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


MESSAGES_SENT = _struct(
    run_id=_LONG, worker=_LONG, producer_id=_LONG, topic=_STRING, partition=_LONG, seq=_LONG,
    key=_STRING, payload=T.BinaryType(), send_us=_LONG, ack_us=_LONG, status=_STRING,
)

MESSAGES_RECEIVED = _struct(
    run_id=_LONG, worker=_LONG, topic=_STRING, partition=_LONG, subscription=_LONG,
    consumer_id=_LONG, seq=_LONG, payload_len=_LONG, publish_ms=_LONG, receive_ms=_LONG,
)

EVENTS = T.StructType(
    [
        T.StructField("event_id", _LONG),
        T.StructField("ts", T.TimestampNTZType()),
        T.StructField("user_id", _LONG),
        T.StructField("event_type", _STRING),
        T.StructField("value", _DOUBLE),
        T.StructField("props", _STRING),
    ]
)

# Field of a workload file -> (column, type).
WORKLOAD_FIELDS: dict[str, tuple[str, str]] = {
    "name": ("name", "string"),
    "topics": ("topics", "int"),
    "partitionsPerTopic": ("partitions_per_topic", "int"),
    "keyDistributor": ("key_distributor", "string"),
    "messageSize": ("message_size", "int"),
    "payloadFile": ("payload_file", "string"),
    "subscriptionsPerTopic": ("subscriptions_per_topic", "int"),
    "producersPerTopic": ("producers_per_topic", "int"),
    "consumerPerSubscription": ("consumer_per_subscription", "int"),
    "producerRate": ("producer_rate", "int"),
    "consumerBacklogSizeGB": ("backlog_gb", "bigint"),
    "testDurationMinutes": ("test_duration_minutes", "int"),
}

METRIC_SAMPLES = T.StructType(
    [
        T.StructField("name", _STRING),
        T.StructField("labels", T.MapType(_STRING, _STRING)),
        T.StructField("ts_ms", _LONG),
        T.StructField("value", _DOUBLE),
    ]
)

# The statistics kept for either latency, in document order.
LATENCY_STATS = ("Avg", "50pct", "75pct", "95pct", "99pct", "999pct", "9999pct", "Max")
SIDES = ("publish", "endToEnd")


def _result_schema() -> T.StructType:
    doubles = T.ArrayType(_DOUBLE)
    fields = [
        T.StructField("workload", _STRING),
        T.StructField("driver", _STRING),
        T.StructField("publishRate", doubles),
        T.StructField("consumeRate", doubles),
        T.StructField("backlog", T.ArrayType(_LONG)),
    ]
    for side in SIDES:
        upper = side[0].upper() + side[1:]
        fields += [T.StructField(f"{side}Latency{s}", doubles) for s in LATENCY_STATS]
        fields += [T.StructField(f"aggregated{upper}Latency{s}", _DOUBLE) for s in LATENCY_STATS]
        fields.append(
            T.StructField(f"aggregated{upper}LatencyQuantiles", T.MapType(_STRING, _DOUBLE))
        )
    # Not in foreign documents: which stretch of a very long run this document holds.
    fields.append(T.StructField("part", _LONG))
    return T.StructType(fields)


RESULT = _result_schema()
