"""Runs of more than a day, with an idle stretch, against the same SQL."""

from pathlib import Path

import duckdb
import pytest
from compare import TABLES, difference
from pyspark.sql import functions as F

import __spark_entry__ as entry_points
from tidewire.operators import aggregates
from tidewire.plans import charts, reports

QUERIES, ORACLES = entry_points.queries(), entry_points.oracle_sql()
ON_LONG_RUNS = (
    "a1_period_counters", "a4_backlog", "a11_mean_rates", "a16_axis_max", "a17_collect_series",
    "a19_group_by_workload", "p16_summary_lines", "r1_series_publish_p99", "r2_series_publish_rate",
    "r3_series_consume_rate", "r4_series_e2e_avg", "r5_quantile_series", "s1_read_results",
    "s2_write_results", "w5_sample_seconds",
)


@pytest.fixture(scope="module")
def long_dir(tmp_path_factory):
    """26 hours: every eighth event of a larger log, none for 20 minutes."""
    folder = tmp_path_factory.mktemp("long")
    for name in TABLES:
        (folder / f"{name}.parquet").symlink_to(Path("/root/testdata/sf0.001") / f"{name}.parquet")
    (folder / "events.parquet").unlink()
    duckdb.execute(
        f"""COPY (SELECT * REPLACE (event_id * 8 AS event_id) FROM '/root/testdata/sf0.1/events.parquet'
        WHERE event_id < 32500 AND event_id * 8 * 360 NOT BETWEEN 40000000 AND 41200000)
        TO '{folder}/events.parquet' (FORMAT parquet)"""
    )
    return str(folder)


@pytest.mark.parametrize("name", ON_LONG_RUNS)
def test_long_run_equals_sql(spark, long_dir, name):
    assert difference(spark, QUERIES[name], ORACLES[name], long_dir) is None


def test_parts_are_numbered_from_the_first_period(spark):
    rows = [(run, period, period * 10) for run, first in ((0, 5), (1, 1_000_003)) for period in range(first, first + 25)]
    report = spark.createDataFrame(rows, "run_id bigint, period bigint, y bigint")
    parts = reports.collect_series(report, {"y": "y"}, periods_per_document=10)
    assert sorted((r.run_id, r.part, len(r.y)) for r in parts.collect()) == [
        (run, part, n) for run in (0, 1) for part, n in ((0, 10), (1, 10), (2, 5))
    ]
    named = parts.withColumns({"workload": F.concat(F.lit("w/"), F.col("run_id").cast("string")), "driver": F.lit("d")})
    points = charts.series(named, "y", periods_per_document=10).collect()
    for workload, first in (("w-0", 5), ("w-1", 1_000_003)):
        got = sorted((p.x, p.y) for p in points if p.workload == workload)
        assert got == [(10 * i, 10 * (first + i)) for i in range(25)]
    assert {(r.workload, r.documents) for r in charts.group_by_workload(named).collect()} == {("w-0", 1), ("w-1", 1)}


def test_workloads_whose_labels_agree_stay_apart(spark):
    rows = [("a/b", "x", 0), ("a-b", "x", 0), ("a-b", "y", 0), ("a-b", "y", 1)]
    found = charts.group_by_workload(spark.createDataFrame(rows, "workload string, driver string, part int"))
    assert sorted((r.workload, r.documents, r.drivers) for r in found.collect()) == [("a-b", 1, 1), ("a-b", 2, 2)]


def test_times_before_the_start_have_periods_of_their_own(spark):
    rows = spark.createDataFrame([(t,) for t in (-10_001, -10_000, -1, 0, 9_999, 10_000)], "t bigint")
    got = rows.orderBy("t").select(aggregates.period_of(F.col("t")).alias("p")).collect()
    assert [r.p for r in got] == [-2, -1, -1, 0, 0, 1]
