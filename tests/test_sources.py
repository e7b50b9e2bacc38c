"""Files in and out: workloads, drivers, payloads, results, exposition text, plug-ins."""

import json

import pytest
from pyspark.sql import functions as F

from tidewire.operators import filters, joins
from tidewire.plans import charts
from tidewire.plans.catalog import documents
from tidewire.session import shared_folder
from tidewire.sources import configs, message_log, metrics, results

WORKLOAD = """
# comment: not a field

name: 10 topics: mixed
topics: 10
partitionsPerTopic: 4
messageSize: 5
payloadFile: "payload/five.data"
keyDistributor: "SOMETHING_ELSE"
producerRate: 1000
unknownField: 7
"""

DRIVER = """
# settings
name: Broker
driverClass: bench.Broker

client:
  serviceUrl: pulsar://localhost:6650
  persistence:
    ackQuorum: 2
  authentication:
    plugin:
producerConfig: |
  acks=all
  # kept as text
  linger.ms=1

consumerConfig: |
  auto.offset.reset=earliest
enableTiering: false
"""


def test_workload_files(spark, tmp_path):
    (tmp_path / "b.v1.yaml").write_text(WORKLOAD)
    (tmp_path / "a.yaml").write_text("name: A\nconsumerBacklogSizeGB: 3\nkeyDistributor: RANDOM_NANO\n")
    rows = configs.read_workloads(spark, str(tmp_path)).collect()
    assert [r.workload for r in rows] == ["a", "b.v1"]
    a, b = rows
    assert (a.backlog_gb, a.topics, a.key_distributor) == (3, 0, "RANDOM_NANO")
    assert (b.name, b.topics, b.message_size, b.backlog_gb) == ("10 topics: mixed", 10, 5, 0)
    assert (b.payload_file, b.key_distributor) == ("payload/five.data", "NO_KEY")


def test_driver_files(spark, tmp_path):
    (tmp_path / "d.yaml").write_text(DRIVER)
    [d] = configs.read_drivers(spark, str(tmp_path)).collect()
    assert (d.name, d.driver_class) == ("Broker", "bench.Broker")
    assert d.extra == {
        "client.serviceUrl": "pulsar://localhost:6650",
        "client.persistence.ackQuorum": "2",
        "producerConfig": "acks=all\n# kept as text\nlinger.ms=1\n",
        "consumerConfig": "auto.offset.reset=earliest\n",
        "enableTiering": "false",
    }


def test_payload_files_of_wrong_length_and_missing(spark, tmp_path):
    (tmp_path / "five.data").write_bytes(b"12345")
    (tmp_path / "six.data").write_bytes(b"123456")
    workloads = spark.createDataFrame(
        [("ok", "p/five.data", 5), ("long", "p/six.data", 5), ("none", "p/nine.data", 5)],
        "name string, payload_file string, message_size bigint",
    )
    checked = configs.check_payloads(workloads, configs.read_payloads(spark, str(tmp_path)))
    nothing = F.lit(None)
    rules = checked.withColumns({
        "backlog_gb": F.lit(0), "producer_rate": F.lit(1), "n_workers": nothing.cast("int"),
        "worker_list": nothing.cast("string"), "workers_file": nothing.cast("string"),
    })
    found = {(r.workload, r.reason) for r in filters.invalid_configs(rules).collect()}
    assert found == {("long", "payload length mismatch"), ("none", "missing payload")}


def test_foreign_result_documents(spark, tmp_path):
    """Indented documents, one per file, with fields this engine does not know."""
    for i, driver in enumerate(["a", "b"]):
        document = {
            "workload": "w/1", "driver": driver, "publishRate": [1.0, 2.0 + i],
            "publishLatency99pct": [3.0], "later": {"x": 1},
            "aggregatedPublishLatencyQuantiles": {"0.0": 1.0, "50.0": 2.0, "100.0": 9.0, "9.5": 1.5},
        }
        (tmp_path / f"{i}.json").write_text(json.dumps(document, indent=2))
    documents = results.read_results(spark, str(tmp_path))
    assert documents.count() == 2
    points = charts.series_publish_rate(documents).orderBy("driver", "x").collect()
    assert [(p.workload, p.driver, p.x, p.y) for p in points] == [
        ("w-1", "a", 0, 1.0), ("w-1", "a", 10, 2.0), ("w-1", "b", 0, 1.0), ("w-1", "b", 10, 3.0),
    ]
    curve = charts.quantile_series(documents).where("driver = 'a'").orderBy("percentile").collect()
    assert [p.percentile for p in curve] == [0.0, 9.5, 50.0]
    assert curve[0].x == 0.0


def test_results_round_trip(spark, tmp_path):
    from tidewire.schemas import RESULT

    row = {f.name: None for f in RESULT.fields} | {
        "workload": "a/b", "driver": "d", "publishRate": [1.5], "backlog": [7], "part": 0,
        "aggregatedPublishLatencyQuantiles": {"50.0": 1.0},
    }
    df = spark.createDataFrame([tuple(row[f.name] for f in RESULT.fields)], RESULT)
    for _ in range(2):  # the second time replaces the first
        results.write_results(df, str(tmp_path / "out"))
    [back] = results.read_results(spark, str(tmp_path / "out"), one_per_file=False).collect()
    assert (back.workload, back.driver, back.publishRate, back.backlog) == ("a/b", "d", [1.5], [7])
    assert back.aggregatedPublishLatencyQuantiles == {"50.0": 1.0}


def test_runs_at_two_times_stay_apart(spark, tmp_path):
    from tidewire.schemas import RESULT

    row = {f.name: None for f in RESULT.fields} | {"workload": "a/b", "driver": "d", "part": 0}
    df = spark.createDataFrame([tuple(row[f.name] for f in RESULT.fields)], RESULT)
    for hour in (1, 2, 2):
        results.write_results(df, str(tmp_path / "out"), F.make_timestamp(*map(F.lit, (2024, 5, 6, hour, 0, 0))))
    found = results.read_results(spark, str(tmp_path / "out"), one_per_file=False).select("run").collect()
    assert sorted(r.run for r in found) == ["a-b-d-2024-05-06-01-00-00", "a-b-d-2024-05-06-02-00-00"]


def test_exposition_text(spark, tmp_path):
    (tmp_path / "m.txt").write_text(
        '# HELP a text\na{x="1",y="p, \\"q\\""} 1.5 1000\nb 2e3\nc{} +Inf 5\nbroken{ 1\n\n'
    )
    rows = {r.name: r for r in metrics.read_exposition(spark, str(tmp_path)).collect()}
    assert set(rows) == {"a", "b", "c"}
    assert rows["a"].labels == {"x": "1", "y": 'p, \\"q\\"'}
    assert (rows["a"].value, rows["a"].ts_ms) == (1.5, 1000)
    assert (rows["b"].labels, rows["b"].value, rows["b"].ts_ms) == ({}, 2000.0, None)
    assert rows["c"].value == float("inf")


def test_synthesized_messages_are_dense_per_producer(spark):
    producers = spark.createDataFrame([(1, 25), (2, 0), (3, 1)], "producer_id bigint, n int")
    made = message_log.synthesize_messages(
        producers, count=F.col("n"), payload=F.lit("x"), spacing_ms=5, block=4
    ).collect()
    assert sorted((r.producer_id, r.seq) for r in made) == [(1, i) for i in range(25)] + [(3, 0)]
    assert all(r.key is None and r.send_ms == 5 * r.seq for r in made)


def test_shared_folder_follows_the_session(spark, monkeypatch):
    assert shared_folder(spark, "x") != shared_folder(spark, "x")

    class Conf:
        def __init__(self, folder):
            self.folder = folder

        def get(self, key, default=None):
            return self.folder if key == "spark.checkpoint.dir" else default

    class Session:
        class sparkContext:
            master = "yarn"

    Session.conf = Conf("hdfs:///shared")
    assert shared_folder(Session, "p").startswith("hdfs:///shared/p-")
    Session.conf = Conf(None)
    with pytest.raises(RuntimeError):
        shared_folder(Session, "p")


def test_workload_values_with_comments_repeats_and_bad_numbers(spark):
    text = 'name: "a # b" # c\ntopics: 3 # few\ntopics: 5\nproducerRate: fast\nmessageSize: 1e\npayloadFile: x#y\n'
    row = configs.parse_workloads(spark.createDataFrame([("/w.yaml", text)], "path string, text string")).first()
    assert (row["name"], row.topics, row.producer_rate, row.payload_file) == ("a # b", 5, 0, "x#y")
    assert sorted(row.unreadable) == ["messageSize", "producerRate"]


def test_driver_lines_that_are_no_settings_are_reported(spark):
    text = "name: a\nservers:\n  - one\n  - two\n# note\nclient:\n  threads: 3\n"
    row = configs.parse_drivers(spark.createDataFrame([("/d.yaml", text)], "path string, text string")).first()
    assert row.unread == ["- one", "- two"] and row.extra == {"client.threads": "3"}


def test_drivers_folded_by_lines(spark):
    """Dotted names, block text with blank and deeper lines, lists, comments, repeated keys, closing blocks."""
    text = "\n".join([
        "# head", "name: 'a b'", "driverClass: x.Y", "", "client:", "  io: 4", "  deep:", "    er: \"q\"", "  io: 5", "block: |", "  one=1", "",
        "    two=2", "after: v # kept", "- item", "odd line", "  nested:", "      x: 1", "   y: 2", "block: |", "  three", "empty:",
    ])
    files = spark.createDataFrame([("/d", text), ("/e", ""), ("/f", None)], "path string, text string")
    rows = {r.path: r for r in configs.parse_drivers(files).collect()}
    row = rows["/d"]
    assert (row.name, row.driver_class) == ("a b", "x.Y")
    assert row.extra == {
        "client.io": "5", "client.deep.er": "q", "block": "three\n", "after": "v # kept", "nested.x": "1", "nested.y": "2",
    }
    assert row.unread == ["- item", "odd line"]
    assert rows["/e"].extra == {} and rows["/e"].unread == []


def test_files_written_and_read(spark, tmp_path):
    files = spark.createDataFrame([("w-1.v2.yaml", "topics: 3\nname: n"), ("x.yaml", "topics: 4")], "file string, text string")
    configs.write_texts(files, str(tmp_path / "w"))
    assert {(r.workload, r.topics) for r in configs.read_workloads(spark, str(tmp_path / "w")).collect()} == {("w-1.v2", 3), ("x", 4)}
    payloads = configs.read_payloads(spark, str(tmp_path / "w"), pattern="part-*")
    assert {(r.path.rsplit("/", 1)[1], r.length) for r in payloads.select("path", "length").collect()} == {("w-1.v2.yaml", 18), ("x.yaml", 10)}
    assert "content" not in payloads.select("path", "length")._jdf.queryExecution().executedPlan().toString().split("ReadSchema")[1]


def test_bucketed_logs_are_joined_where_they_lie(spark):
    keys = ["topic", "partition", "seq"]
    rows = spark.createDataFrame([("t", i % 3, i, 10 * i) for i in range(500)], "topic string, partition int, seq bigint, send_ms bigint")
    received = rows.selectExpr(*keys, "1 AS subscription", "send_ms + 5 AS receive_ms").where("seq % 7 <> 0")
    sent, got = (message_log.bucketed_log(log, keys, 4) for log in (rows, received))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        paired = joins.join_publish_receive(sent, got)
        assert "Exchange" not in paired._jdf.queryExecution().executedPlan().toString()
        assert paired.where("receive_ms = send_ms + 5").count() == received.count()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_many_texts_lie_in_few_files(spark, tmp_path):
    """Texts are packed; files as they are, beside them, are read too, and texts of one name come together in order."""
    files = spark.range(3000).selectExpr("format_string('d-%d.yaml', id) AS file", "concat('name: é', id) AS text")
    more = spark.createDataFrame([("two", "name: a"), ("two", "name: b"), ("none", None)], "file string, text string").coalesce(1)
    folder = tmp_path / "w"
    configs.write_texts(files.union(more), str(folder))
    (folder / "own.yaml").write_text("name: own")
    assert sum(p.is_file() for p in folder.rglob("*")) < 300
    found = {r.path.rsplit("/", 1)[1]: r.text for r in configs.read_texts(spark, [str(folder)]).collect()}
    assert len(found) == 3003 and found["d-7.yaml"] == "name: é7\n" and found["own.yaml"] == "name: own"
    assert (found["two"], found["none"]) == ("name: a\nname: b\n", "\n")
    drivers = {r.path.rsplit("/", 1)[1]: r.name for r in configs.read_drivers(spark, str(folder)).collect()}
    assert drivers["d-2999.yaml"] == "é2999" and drivers["two"] == "b"
    payloads = {r.path.rsplit("/", 1)[1]: (r.content.decode(), r.length) for r in configs.read_payloads(spark, str(folder)).collect()}
    assert payloads["d-7.yaml"] == ("name: é7\n", 10) and payloads["own.yaml"] == ("name: own", 9)


def test_workloads_of_every_part_are_read(spark, tmp_path):
    part = spark.range(50).selectExpr("id AS p_partkey", "concat('n', id) AS p_name", "cast(id AS int) AS p_size")
    part.write.parquet(str(tmp_path / "part.parquet"))
    rows = {r.workload: (r.name, r.topics) for r in documents.s3_read_workloads(spark, str(tmp_path)).collect()}
    assert rows == {f"w-{i}.v2": (f"n{i}-{i:06d}", i % 5) for i in range(50)}
