"""Names of topics, subscriptions, streams, queues, runs and charts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Topic prefix of each messaging system.
TOPIC_PREFIXES = {
    "kafka": "test-topic",
    "rabbitmq": "test-topic",
    "rocketmq": "RocketMQ-Benchmark",
    "artemis": "test",
    "nats": "Nats-benchmark",
    "nats-streaming": "Nats-streaming-benchmark",
    "nsq": "Nsq-Benchmark",
    "distributedlog": "test-stream",
}

TOKEN_BYTES = 5
KEY_BYTES = 7


def topic_prefix(system: Column, configured: Column | None = None) -> Column:
    """Prefix for a system; systems that build theirs from configuration pass it in."""
    known = F.create_map(*[F.lit(x) for pair in TOPIC_PREFIXES.items() for x in pair])
    found = F.try_element_at(known, system)
    return found if configured is None else F.coalesce(configured, found)


def random_token(seed: str, ident: Column, n_bytes: int = TOKEN_BYTES) -> Column:
    """URL-safe base64 of ``n_bytes`` bytes drawn from a hash of (seed, ident).

    The same row gives the same token on every attempt, so a retried task
    cannot rename what an earlier one wrote.
    """
    digest = F.sha2(F.concat(F.lit(seed), ident.cast("string")), 256)
    raw = F.unhex(F.substring(digest, 1, 2 * n_bytes))
    return F.rtrim(F.translate(F.base64(raw), "+/", "-_"), F.lit("="))


def topic_name(prefix: Column, token: Column, index: Column) -> Column:
    return F.format_string("%s-%s-%04d", prefix, token, index)


def subscription_name(index: Column, token: Column) -> Column:
    return F.format_string("sub-%03d-%s", index, token)


def substream_name(topic: Column, partition: Column) -> Column:
    return F.format_string("%s/%06d", topic, partition)


def queue_name(topic: Column, subscription: Column) -> Column:
    return F.concat_ws("-", topic, subscription)


def clean_name(name: Column) -> Column:
    return F.regexp_replace(name, "[^A-Za-z0-9-]", "")


def run_name(workload: Column, driver: Column, started: Column) -> Column:
    stamp = F.date_format(started, "yyyy-MM-dd-HH-mm-ss")
    return F.format_string("%s-%s-%s", workload, driver, stamp)


def workload_stem(file_name: Column) -> Column:
    """File name without directory and without its last extension."""
    base = F.regexp_replace(file_name, "^.*/", "")
    return F.regexp_replace(base, r"\.[^.]*$", "")


def chart_label(workload: Column) -> Column:
    return F.replace(workload, F.lit("/"), F.lit("-"))
