"""Ordered, joined and aggregated operators against brute force on small fixtures."""

import bisect
import random
from fractions import Fraction

from pyspark.sql import functions as F

from tidewire.operators import assign, filters, histograms, joins, lookback, scan, sketches, windows


def hot_rows(seed, n=600):
    """One key holds a third of the rows and order values are sparse."""
    rng = random.Random(seed)
    used, rows = set(), []
    while len(rows) < n:
        key = 0 if len(rows) % 3 == 0 else rng.randrange(1, 40)
        at = rng.randrange(5_000)
        if (key, at) not in used:
            used.add((key, at))
            rows.append((key, at, rng.randrange(-50, 50) if rng.random() > 0.1 else None))
    return rows


def grouped(rows):
    found = {}
    for key, at, v in rows:
        found.setdefault(key, []).append((at, v))
    return {k: sorted(v) for k, v in found.items()}


def test_running_equals_brute_force_across_blocks(spark):
    rows = hot_rows(1)
    df = spark.createDataFrame(rows, "k bigint, at bigint, v bigint")
    columns = {n: scan.Running(F.col("v"), n) for n in ("sum", "min", "max")}
    got = {(r.k, r.at): (r["sum"], r["min"], r["max"])
           for r in scan.running(df, ["k"], "at", columns, span=37).collect()}
    assert len(got) == len(rows)
    for key, items in grouped(rows).items():
        for i, (at, _) in enumerate(items):
            seen = [v for _, v in items[: i + 1] if v is not None]
            want = (sum(seen), min(seen), max(seen)) if seen else (None, None, None)
            assert got[key, at] == want


def test_running_downwards_with_ties(spark):
    rows = [(1, at % 20, at) for at in range(60)] + [(2, 5, 1)]
    df = spark.createDataFrame(rows, "k bigint, at bigint, v bigint")
    got = scan.running(df, ["k"], "at", {"low": scan.Running(F.col("v"), "min")},
                       span=3, descending=True, with_ties=True).collect()
    for r in got:
        assert r.low == min(v for k, at, v in rows if k == r.k and at >= r["at"])


def test_previous_equals_brute_force_across_blocks(spark):
    rows = hot_rows(2)
    df = spark.createDataFrame(rows, "k bigint, at bigint, v bigint")
    got = {(r.k, r.at): (r.pa, r.pv)
           for r in scan.previous(df, ["k"], "at", {"pa": "at", "pv": "v"}, span=37).collect()}
    for key, items in grouped(rows).items():
        for i, (at, _) in enumerate(items):
            assert got[key, at] == (items[i - 1] if i else (None, None))


def test_dense_index_numbers_everything_once(spark):
    ids = random.Random(3).sample(range(100_000), 700)
    df = spark.createDataFrame([(i,) for i in ids], "id bigint")
    got = {r.id: (r.idx, r.n) for r in scan.dense_index(df, "id", total="n", span=1000).collect()}
    assert got == {v: (i, 700) for i, v in enumerate(sorted(ids))}


def test_dense_index_of_sparse_and_crowded_ids(spark):
    sparse = [i * 10**12 for i in range(3000)]
    crowded = [*range(5000), 10**15, *(10**15 - i for i in range(1, 2000))]
    for ids in (sparse, crowded, [7] * 50, []):
        df = spark.createDataFrame([(i, n) for n, i in enumerate(ids)], "id bigint, n bigint")
        got = sorted((r.idx, r.id, r.n) for r in scan.dense_index(df, "id", ties=["n"]).collect())
        want = sorted((i, n) for n, i in enumerate(ids))
        assert got == [(place, i, n) for place, (i, n) in enumerate(want)]
        short = sorted((r.idx, r.id) for r in scan.dense_index(df, "id", ties=["n"], span=97).collect())
        assert short == [(place, i) for place, (i, _) in enumerate(want)]


def test_dense_index_of_ten_million_rows(spark):
    """Ids 10^11 apart, up to 10^18: every block gets its share, also of one value in a third of all rows."""
    n = 10_000_000
    far = F.col("id") * 10**11
    ids = spark.range(n).select("id", far.alias("far"), F.when(F.col("id") % 3 == 0, 0).otherwise(far).alias("hot"))
    placed = scan.dense_index(ids, "far", total="n")
    assert placed.where("idx <> id OR n <> 10000000").isEmpty()
    rows = scan.dense_index(ids, "hot", ties=["id"]).select("idx", "hot", "id")
    assert rows.agg(F.count_distinct("idx"), F.min("idx"), F.max("idx")).first()[:] == (n, 0, n - 1)
    zeros = rows.where("hot = 0").agg(F.max("idx").alias("last"), F.sum((F.col("idx") * 3 != F.col("id")).cast("int")).alias("bad")).first()
    assert (zeros.last, zeros.bad) == (-(-n // 3) - 1, 0)


def test_dense_index_blocks_grow_with_the_rows(spark):
    sizes = {}
    for n in (1_000, 4_000):
        same = spark.range(n).select(F.lit(7).alias("id"), F.col("id").alias("n"))
        plan = scan.dense_index(same, "id", span=100)
        assert "row_number" not in plan._jdf.queryExecution().optimizedPlan().toString()
        block = F.shiftrightunsigned("_row", 33)
        folder = plan.inputFiles()[0].rsplit("/", 1)[0]
        sizes[n] = [r["count"] for r in spark.read.parquet(folder).groupBy(block).count().collect()]
    assert len(sizes[1_000]) == 10 and len(sizes[4_000]) == 40
    assert max(sizes[1_000] + sizes[4_000]) < 250


def test_round_robin_with_more_buckets_than_items(spark):
    df = spark.createDataFrame([(10,), (30,), (20,)], "id bigint")
    got = sorted(((r.bucket, r.id) for r in assign.assign_round_robin(df, "id", 5).collect()))
    assert got == [(0, 10), (1, 20), (2, 30), (3, None), (4, None)]
    got = sorted(((r.bucket, r.id) for r in assign.assign_round_robin(df, "id", 2).collect()))
    assert got == [(0, 10), (0, 30), (1, 20)]
    assert assign.assign_round_robin(df, "id", 0).count() == 0
    assert assign.assign_round_robin(df.where("id < 0"), "id", 3).count() == 0


def test_roles_leave_an_odd_worker_idle(spark):
    df = spark.range(5).withColumnRenamed("id", "w")
    roles = [r.role for r in assign.worker_roles(df, "w").orderBy("w").collect()]
    assert roles == ["produce", "produce", "consume", "consume", "idle"]


def test_shuffle_is_a_permutation_and_repeats(spark):
    df = spark.range(500)
    one = {r.id: r.position for r in assign.shuffle_assignments(df, ["id"], "a").collect()}
    again = {r.id: r.position for r in assign.shuffle_assignments(df.repartition(7), ["id"], "a").collect()}
    other = {r.id: r.position for r in assign.shuffle_assignments(df, ["id"], "b").collect()}
    assert one == again != other
    assert sorted(one.values()) == list(range(500))


def test_cumulative_answers_on_a_hot_channel(spark):
    rng = random.Random(11)
    sends = [(0 if i % 3 else rng.randrange(1, 5), i) for i in range(400)]
    answers = []
    for channel, tag in sends:
        if rng.random() < 0.25:
            answers.append((channel, tag + rng.randrange(3), rng.randrange(50), rng.random() < 0.4, rng.random() < 0.7))
    s = spark.createDataFrame(sends, "channel bigint, tag bigint")
    a = spark.createDataFrame(answers, "channel bigint, tag bigint, at_ms bigint, multiple boolean, positive boolean")
    got = {(r.channel, r.tag): (r.settled_ms, r.outcome)
           for r in joins.join_cumulative_ack(s, a, span=16).collect()}
    assert len(got) == len(sends)
    for channel, tag in sends:
        settling = [(at, pos) for c, t, at, multi, pos in answers
                    if c == channel and (t == tag or (multi and t >= tag))]
        want = (None, "pending")
        if settling:
            at, positive = min(settling)
            want = (at, "ok" if positive else "failed")
        assert got[channel, tag] == want


def test_empty_periods_of_long_gaps(spark):
    df = spark.createDataFrame([(1, 3, 5), (1, 40, 6), (2, 7, 1)], "run bigint, period bigint, n bigint")
    got = sorted(tuple(r) for r in joins.fill_empty_periods(df, ["run"], "period", ["n"], span=8).collect())
    want = [(1, p, {3: 5, 40: 6}.get(p, 0)) for p in range(3, 41)] + [(2, 7, 1)]
    assert got == want


def test_test_window_keeps_the_ending_period(spark):
    df = spark.createDataFrame([(p, p == 4) for p in range(10)], "period bigint, drain boolean").withColumn("run", F.lit(1))
    kept = filters.test_window(df, ["run"], "period", period_ms=10, duration_ms=F.lit(50), draining=F.col("drain"), span=3)
    assert sorted(r.period for r in kept.collect()) == [0, 1, 2, 3, 4, 5]
    endless = filters.test_window(df, ["run"], "period", period_ms=10, duration_ms=F.lit(0))
    assert endless.count() == 10


def ladder_curve(counts):
    """Walk the buckets once, moving the level up after each point, in exact arithmetic."""
    total, level, seen, points = sum(n for _, n in counts), Fraction(0), 0, []
    for bucket, n in counts:
        seen += n
        share = Fraction(100 * seen, total)
        if share >= level or seen == total:
            points.append((float(100.0 * seen / total), bucket / 1000.0))
        while level <= share and share < 100:
            halvings = 0
            while 100 - level <= Fraction(100, 2 ** (halvings + 1)):
                halvings += 1
            level += Fraction(100, 100 * 2 ** (halvings + 1))
    return points


def test_quantile_curve_equals_walking_the_ladder(spark):
    rng = random.Random(13)
    rows, want = [], {}
    for h in range(25):
        buckets = sorted(rng.sample(range(5_000), rng.randrange(1, 200)))
        counts = [(b, rng.randrange(1, 10 ** rng.randrange(1, 6))) for b in buckets]
        rows += [(h, b, n, 0, 0) for b, n in counts]
        want[h] = ladder_curve(counts)
    df = spark.createDataFrame(rows, "h int, bucket bigint, n bigint, deficit_us bigint, bytes bigint")
    got = {}
    for r in histograms.quantile_curve(df, ["h"]).collect():
        got.setdefault(r.h, []).append((r.percentile, r.value_ms))
    assert {h: sorted(p) for h, p in got.items()} == want


def test_merged_workers_equal_one_worker(spark):
    rng = random.Random(17)
    rows = [(rng.randrange(4), rng.randrange(10**6), 10) for _ in range(2_000)]
    df = spark.createDataFrame(rows, "worker int, us bigint, size bigint").withColumn("run", F.lit(1))
    single = histograms.bucket_counts(df, ["run"], "us", "size")
    split = histograms.merge_histograms(histograms.bucket_counts(df, ["run", "worker"], "us", "size"), ["run"])
    assert sorted(single.collect()) == sorted(split.collect())
    [r] = histograms.latency_summary(split, ["run"]).collect()
    assert r.messages == r.recorded == 2_000
    assert abs(r.latency_avg - sum(us for _, us, _ in rows) / 2_000 / 1000) < 1e-9


def test_huge_latencies_do_not_overflow_the_mean(spark):
    df = spark.createDataFrame([(1, 43_200_000_000, 10**12, 0, 0)], "run int, bucket bigint, n bigint, deficit_us bigint, bytes bigint")
    [r] = histograms.latency_summary(df, ["run"]).collect()
    assert r.latency_avg == 43_200_000.0


def test_nothing_recorded_reports_zero(spark):
    df = spark.createDataFrame([(1, None, 5)], "run int, us bigint, size bigint")
    [r] = histograms.latency_summary(histograms.bucket_counts(df, ["run"], "us", "size"), ["run"]).collect()
    assert (r.messages, r.bytes, r.recorded) == (1, 5, 0)
    assert (r.latency_avg, r.latency_99pct, r.latency_max) == (0.0, 0.0, 0.0)


def series(rng, n=120):
    at, value, samples = 0, 0.0, []
    for _ in range(n):
        at += rng.choice([1, 2, 3, 9]) * 5_000
        value = rng.randrange(20) if rng.random() < 0.1 else value + rng.randrange(50)
        samples.append((at, float(value)))
    return samples


def extrapolated(window, t, span):
    (first_ts, first), (last_ts, _) = window[0], window[-1]
    growth = sum(b - a if b >= a else b for (_, a), (_, b) in zip(window, window[1:], strict=False))
    sampled = (last_ts - first_ts) / 1000
    distance = sampled / (len(window) - 1)
    to_start, to_end = (first_ts - (t - span)) / 1000, (t - last_ts) / 1000
    if growth > 0 and first >= 0:
        to_start = min(to_start, sampled * (first / growth))
    reach = sampled
    reach += to_start if to_start < distance * 1.1 else distance / 2
    reach += to_end if to_end < distance * 1.1 else distance / 2
    return growth * reach / sampled


def test_lookbacks_equal_brute_force_across_blocks(spark):
    rng = random.Random(19)
    data = {f"w{i}": series(rng) for i in range(3)}
    rows = [("m", {"instance": i}, ts, v) for i, s in data.items() for ts, v in s]
    df = spark.createDataFrame(rows, "name string, labels map<string,string>, ts_ms bigint, value double")
    step, span, block = 10_000, 60_000, 100_000
    rates, growths, latest = {}, {}, {}
    for name, samples in data.items():
        for t in range(0, samples[-1][0] + span + step, step):
            window = [s for s in samples if t - span <= s[0] <= t]
            if window:
                latest[name, t] = window[-1][1]
            if len(window) > 1:
                (t0, a), (t1, b) = window[-2:]
                rates[name, t] = (b if b < a else b - a) / ((t1 - t0) / 1000)
                growths[name, t] = extrapolated(window, t, span)

    def collected(points):
        return {(r.labels["instance"], r.t_ms): r.value for r in points.collect()}

    options = {"step_ms": step, "block_ms": block}
    assert collected(lookback.instant(df, span, **options)) == latest
    got = collected(lookback.irate(df, span, **options))
    assert got.keys() == rates.keys()
    assert all(abs(got[k] - rates[k]) < 1e-9 for k in rates)
    got = collected(lookback.increase(df, span, **options))
    assert got.keys() == growths.keys()
    assert all(abs(got[k] - growths[k]) < 1e-6 for k in growths)


def test_verdict_needs_a_shortfall(spark):
    rows = [(94.0, 94.0), (95.0, 93.0), (95.0, 93.2), (100.0, 98.0)]
    df = spark.createDataFrame(rows, "p double, r double")
    got = [r.v for r in df.select(windows.sustain_verdict(F.col("p"), F.col("r"), F.lit(100.0)).alias("v")).collect()]
    assert got == ["producer-bound", "consumer-bound", "ok", "ok"]


def test_sketches_merge_in_any_order(spark):
    rng = random.Random(8)
    values = [int(rng.lognormvariate(9, 2)) for _ in range(60_000)]
    rows = spark.createDataFrame([(i % 50, v) for i, v in enumerate(values)], "worker int, latency_us bigint")
    single = sketches.latency_sketches(rows, ["worker"])
    ranked = sorted(values)
    for order in ("worker", F.desc("worker")):
        merged = sketches.merge_sketches(single.orderBy(order).withColumn("run_id", F.lit(1)), ["run_id"])
        for r in sketches.sketch_quantiles(merged, ["run_id"], [0.01, 0.5, 0.99, 1.0]).collect():
            low, high = bisect.bisect_left(ranked, r.latency_us), bisect.bisect_right(ranked, r.latency_us)
            assert r.messages == 60_000
            assert low - 120 <= r.quantile * 60_000 <= high + 120
    assert sketches.latency_sketches(rows.where("worker < 0"), ["worker"]).count() == 0


def test_increase_holds_no_lists(spark):
    samples = spark.createDataFrame([("c", {"a": "b"}, 1000 * i, float(i % 700)) for i in range(2000)], "name string, labels map<string,string>, ts_ms bigint, value double")
    df = lookback.increase(samples, 300_000)
    assert "collect_list" not in df._jdf.queryExecution().optimizedPlan().toString()
    points = {r.t_ms: r.value for r in df.collect()}
    for t in (15_000, 600_000, 705_000, 900_000):  # one restart at 700 s
        inside = [(1000 * i, float(i % 700)) for i in range(2000) if t - 300_000 <= 1000 * i <= t]
        growth = sum(b if b < a else b - a for (_, a), (_, b) in zip(inside, inside[1:], strict=False))
        sampled = (inside[-1][0] - inside[0][0]) / 1000
        edge = min((inside[0][0] - t + 300_000) / 1000, sampled * inside[0][1] / growth)
        stretched = sampled + (edge if edge < 1.1 else 0.5) + (t - inside[-1][0]) / 1000
        assert abs(points[t] - growth * stretched / sampled) < 1e-6
