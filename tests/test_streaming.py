"""Streams: what arrives late or twice, restarts, commits, counters."""

import random
import time
from collections import Counter
from datetime import datetime
from types import SimpleNamespace

import pandas as pd
from pyspark.sql import functions as F

from tidewire.plans.catalog import streams
from tidewire.schemas import EVENTS
from tidewire.sources import message_log
from tidewire.streaming import hooks, live, pairing, stats, tables

AT = "timestamp_millis(ms)"


def log(spark, folder, *batches, schema="id bigint, ms bigint"):
    """A log whose files arrive one per micro-batch, in order."""
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)
        time.sleep(1.1)  # files are ordered by modification time
    return message_log.stream_message_log(
        spark, folder, spark.createDataFrame([], schema).schema, max_files_per_trigger=1
    ).withColumn("event_time", F.expr(AT))


def test_unanswered_sends_come_out_after_the_timeout(spark, tmp_path):
    schema = "producer_id bigint, producer_seq bigint, ms bigint"
    sends = log(spark, str(tmp_path / "s"), [(1, 0, 1000), (1, 1, 2000)], [(1, 2, 300_000)], [(1, 3, 301_000)], schema=schema)
    acks = log(spark, str(tmp_path / "a"), [(1, 0, 1250)], [(1, 2, 300_100)], [(1, 3, 301_100)], schema=schema)
    paired = tables.run_into_table(
        pairing.send_ack(sends.drop("ms"), acks), str(tmp_path / "out")
    ).collect()
    got = {r.producer_seq: r.latency_us for r in paired}
    assert got == {0: 250_000, 1: None, 2: 100_000, 3: 100_000}


def test_repeats_within_the_watermark_are_dropped(spark, tmp_path):
    stream = log(spark, str(tmp_path / "s"), [(1, 0), (2, 10)], [(1, 20), (3, 30)])
    kept = pairing.drop_repeats_live(stream, ["id"]).select("id")
    rows = tables.run_into_table(kept, str(tmp_path / "out")).collect()
    assert sorted(r.id for r in rows) == [1, 2, 3]


def test_last_update_of_a_key_wins(spark):
    updates = spark.createDataFrame([("a", 1, 0), ("a", 5, 2), ("b", 2, 1), ("a", 3, 1)], "k string, v int, batch_id bigint")
    assert sorted(map(tuple, tables.latest_by_key(updates, ["k"]).collect())) == [("a", 5), ("b", 2)]


def test_batches_without_commit_are_not_read(spark, tmp_path):
    stream = log(spark, str(tmp_path / "s"), [(1, 0)], [(2, 0)]).select("id")
    path = str(tmp_path / "out")
    tables.transactional_sink(stream, path, str(tmp_path / "c")).awaitTermination()
    spark.createDataFrame([(99,)], "id bigint").write.parquet(f"{path}/rows/batch_id=7")
    rows = tables.read_committed(spark, path, stream.schema).collect()
    assert sorted(r.id for r in rows) == [1, 2]


def test_nothing_is_committed_before_the_first_commit(spark, tmp_path):
    schema = spark.createDataFrame([], "id bigint").schema
    spark.createDataFrame([(99,)], "id bigint").write.parquet(str(tmp_path / "rows" / "batch_id=0"))
    assert tables.read_committed(spark, str(tmp_path), schema).count() == 0


def test_a_batch_that_runs_again_replaces_itself(spark, tmp_path):
    path = str(tmp_path / "out")
    for _ in range(2):  # the second run has no checkpoint and starts over
        stream = message_log.stream_message_log(spark, "/root/testdata/sf0.001/events.parque[t]", EVENTS)
        tables.into_table(stream.select("event_id"), path, str(tmp_path / f"c{_}")).awaitTermination()
    table = tables.read_table(spark, path, stream.select("event_id").schema)
    assert table.count() == table.select("event_id").distinct().count() == 1000


def test_late_rows_are_counted(spark, sf_dir):
    dropped = streams.t12_late_rows(spark, sf_dir).agg(F.sum("dropped").alias("n")).first().n
    assert dropped > 0


def test_a_log_is_taken_in_the_order_of_its_parts(spark, tmp_path):
    rows = spark.createDataFrame([(i, 7 - i) for i in range(8)], "id bigint, part bigint")
    folder = message_log.lay_out(rows, str(tmp_path / "log"), F.col("part"), 8, "id")
    stream = message_log.stream_message_log(spark, folder, rows.schema, max_files_per_trigger=1)
    found = tables.run_into_table(stream, str(tmp_path / "out")).collect()
    assert {(r.id, r.batch_id) for r in found} == {(i, 7 - i) for i in range(8)}


MINUTES = "run_id bigint, worker bigint, ms bigint"


def side(spark, folder):
    stream = message_log.stream_message_log(spark, folder, spark.createDataFrame([], MINUTES).schema, max_files_per_trigger=1)
    return stream.withColumn("event_time", F.expr(AT))


def totals_of(spark, folder, out):
    rows = live.live_totals(side(spark, f"{folder}/s"), side(spark, f"{folder}/r"), delay="5 seconds")
    return tables.run_into_table(rows, out, conf=live.STATE_STORE | {"spark.sql.shuffle.partitions": "2"})


def test_closed_periods_come_out_once_also_after_a_restart(spark, tmp_path):
    """A run that stops after two files and goes on gives what a run in one go gives."""
    rng = random.Random(1)
    parts = [[(w % 2, w, 30_000 * k + rng.randrange(30_000)) for w in range(3) for _ in range(40)] for k in range(4)]
    folder = str(tmp_path / "log")

    def arrive(rows):
        for name in ("s", "r"):
            spark.createDataFrame(rows, MINUTES).coalesce(1).write.mode("append").parquet(f"{folder}/{name}")
        time.sleep(1.1)

    for rows in parts[:2]:
        arrive(rows)
    totals_of(spark, folder, str(tmp_path / "stopped"))
    for rows in parts[2:]:
        arrive(rows)
    resumed = totals_of(spark, folder, str(tmp_path / "stopped"))
    columns = ["run_id", "worker", "at_ms", "sent", "received", "total_sent", "total_received"]
    closed = [tuple(r) for r in resumed.where("kind = 'closed'").select(columns).collect()]
    every = [m for rows in parts for m in rows]
    end, want = max(ms for *_, ms in every) - 5_000, []
    for worker in range(3):
        own, total = [ms for _, w, ms in every if w == worker], 0
        for start in sorted({ms // 10_000 * 10_000 for ms in own}):
            n = sum(start <= ms < start + 10_000 for ms in own)
            total += n
            if start + 10_000 <= end:
                want.append((worker % 2, worker, start, n, n, total, total))
    assert sorted(closed) == sorted(want)
    whole = totals_of(spark, folder, str(tmp_path / "whole"))
    assert sorted(map(tuple, whole.where("kind = 'closed'").select(columns).collect())) == sorted(want)
    now = {r.run_id: (r.total_sent, r.total_received) for r in live.current_totals(resumed, ["run_id"]).collect()}
    assert now == {0: (320, 320), 1: (160, 160)}


def test_a_silent_worker_is_reported_once(spark, tmp_path):
    rows = [[(0, 0, 1_000), (0, 1, 1_500)], [(0, 0, 20_000)], [(0, 0, 80_000)], [(0, 0, 81_000)]]
    for part in rows:
        for name in ("s", "r"):
            spark.createDataFrame(part, MINUTES).coalesce(1).write.mode("append").parquet(str(tmp_path / "log" / name))
        time.sleep(1.1)
    found = totals_of(spark, str(tmp_path / "log"), str(tmp_path / "out")).where("kind = 'idle'")
    assert sorted((r.worker, r.at_ms, r.total_sent) for r in found.collect()) == [(0, 20_000, 2), (1, 1_500, 1)]


def test_closed_periods_are_written_once(spark, sf_dir, tmp_path):
    """However many micro-batches there are, a period's rows are written with one of them."""
    log = streams._arrived(spark, sf_dir)
    sent = streams._sends(spark, log)
    rows = tables.run_into_table(stats.period_buckets(sent, ["run_id"]), str(tmp_path / "out"))
    assert rows.select("batch_id").distinct().count() > 2
    assert rows.count() == rows.dropDuplicates(["run_id", "period_ms", "bucket"]).count()
    assert rows.groupBy("run_id", "period_ms").agg(F.count_distinct("batch_id").alias("n")).where("n > 1").isEmpty()


def test_periods_that_are_open_at_the_end_of_a_log_are_reported(spark, tmp_path):
    """The last period of a log counts, though no watermark has passed it; no period counts twice."""
    at = datetime(2024, 1, 1)
    rows = [(i, at, 1, "a", 2.5, "{}") for i in range(400)]
    spark.createDataFrame(rows, EVENTS).coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    found = {(r.run_id, r.period_ms): r.messages for r in streams.t1_stream_period_stats(spark, str(tmp_path)).collect()}
    want = Counter((i % 3, streams.EPOCH + i * 360 // 10_000 * 10_000) for i in range(400) if i % 97)
    assert found == want


def test_drain_ends_with_nothing_left(spark, sf_dir):
    rows = streams.t10_drain(spark, sf_dir).orderBy("batch_id").collect()
    left = [r.backlog for r in rows]
    assert left == sorted(left, reverse=True) and left[-1] == 0
    assert rows[-1].total_received == 1000 and rows[-1].drained


def test_counters_and_late_rows_of_more_batches_than_a_query_remembers(spark, tmp_path):
    arrived = str(tmp_path / "arrived")
    rows = spark.createDataFrame([(i, 1 << 60) for i in range(105)], "seq bigint, big bigint")
    rows.repartition(105, "seq").write.option("maxRecordsPerFile", 1).parquet(arrived)
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(arrived)
    scope = hooks.MetricScope("x")
    scope.counter("rows")
    scope.gauge("big", F.max("big"))
    late = hooks.LateRows()
    few = {"spark.sql.shuffle.partitions": "1"}
    spark.streams.addListener(late)
    try:
        with tables.settings(spark, few):
            got = hooks.observed_batches(scope.observe(stream), str(tmp_path / "n"), str(tmp_path / "c"), str(tmp_path / "m")).collect()
        counted = stream.groupBy((F.col("seq") % 2).alias("k")).count()
        query = tables.into_table(counted, str(tmp_path / "r"), str(tmp_path / "d"), mode="update", conf=few)
        query.awaitTermination()
        assert late.table(query).select("batch_id").distinct().count() == 105
    finally:
        spark.streams.removeListener(late)
    assert spark.conf.get("spark.sql.shuffle.partitions") != "1"
    assert sum(r.value for r in got if r.metric == "x_rows") == 105
    assert {r.value for r in got if r.metric == "x_big"} == {1 << 60} and len(got) == 210


def test_listener_receives_counters(spark, tmp_path):
    seen = []
    listener = hooks.CounterListener(lambda query, batch, counters: seen.append(counters))
    spark.streams.addListener(listener)
    try:
        scope = hooks.MetricScope("x")
        scope.counter("rows")
        stream = scope.observe(log(spark, str(tmp_path / "s"), [(1, 0), (2, 0)]))
        tables.run_into_table(stream, str(tmp_path / "out"))
        deadline = time.time() + 20
        while not any(c["x_rows"] == 2 for c in seen) and time.time() < deadline:
            time.sleep(0.2)
    finally:
        spark.streams.removeListener(listener)
    assert any(c["x_rows"] == 2 for c in seen)


def test_a_log_without_files_gives_an_empty_table(spark, tmp_path):
    (tmp_path / "s").mkdir()
    stream = message_log.stream_message_log(spark, str(tmp_path / "s"), EVENTS).select("event_id")
    assert tables.run_into_table(stream, str(tmp_path / "out")).count() == 0


class Kept:
    """A value or a map of state, and how often any is used."""

    calls = 0

    def __init__(self):
        self.kept = {}

    def __getattr__(self, name):
        found = {
            "exists": lambda: bool(self.kept), "get": lambda: self.kept[()], "update": lambda v: self.kept.update({(): v}),
            "containsKey": lambda k: k in self.kept, "getValue": lambda k: self.kept[k], "removeKey": lambda k: self.kept.pop(k),
            "updateValue": lambda k, v: self.kept.update({k: v}), "keys": lambda: list(self.kept),
        }[name]

        def counted(*given):
            Kept.calls += 1
            return found(*given)

        return counted


class Handle:
    def __init__(self):
        self.timers = set()

    def getValueState(self, name, schema):  # noqa: N802
        return Kept()

    getMapState = lambda self, name, *schemas: Kept()  # noqa: E731, N815

    def registerTimer(self, at):  # noqa: N802
        Kept.calls += 1
        self.timers.add(at)

    deleteTimer = registerTimer  # noqa: N815


def test_many_periods_of_one_batch_take_few_state_calls(monkeypatch):
    """Periods of a long micro-batch are read, written and closed by blocks."""
    rng, periods, n = random.Random(3), 20_000, 60_000
    at = [rng.randrange(periods * 10_000) for _ in range(n)] + [None]
    sent = [rng.randrange(2) for _ in at]
    monkeypatch.setattr(live, "MOST_ROWS", 30_000, raising=False)
    batches = [pd.DataFrame({"at_ms": at[k : k + 7_000], "sent": sent[k : k + 7_000], "received": [1 - s for s in sent[k : k + 7_000]]}) for k in range(0, n + 1, 7_000)]
    totals, handle = live._Totals(["run"], 10_000, 30_000), Handle()
    totals.init(handle)
    Kept.calls = 0

    def passed(watermark):
        times, out = SimpleNamespace(getCurrentWatermarkInMs=lambda: watermark), []
        while due := sorted(t for t in handle.timers if t <= watermark):
            expired = SimpleNamespace(getExpiryTimeInMs=lambda: due[0])
            out += list(totals.handleExpiredTimer((7,), times, expired))
            handle.timers.discard(due[0])
        return [row for df in out for row in df[df.kind == "closed"][["at_ms", "sent", "received", "total_sent", "total_received"]].itertuples(index=False, name=None)]

    for some in (batches[:5], batches[5:]):
        list(totals.handleInputRows((7,), iter(some), None))
    half = periods // 2 * 10_000
    found = [passed(half), passed(periods * 10_000)]
    assert Kept.calls < 300
    want, running = [], [0, 0]
    counts = {}
    for ms, s in zip(at[:-1], sent[:-1], strict=True):
        own = counts.setdefault(ms // 10_000 * 10_000, [0, 0])
        own[1 - s] += 1
    for start in sorted(counts):
        running = [a + b for a, b in zip(running, counts[start], strict=True)]
        want.append((start, *counts[start], *running))
    assert found == [[w for w in want if w[0] + 10_000 <= half], [w for w in want if w[0] + 10_000 > half]]
