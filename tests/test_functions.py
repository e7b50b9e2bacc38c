"""Scalar functions on hand-sized values."""

import random
from decimal import ROUND_HALF_EVEN, Decimal

from pyspark.sql import functions as F

from tidewire.functions import config, keys, labels, latency, naming, payload, text


def values(spark, rows, schema, **columns):
    df = spark.createDataFrame(rows, schema)
    return df.select(*[c.alias(n) for n, c in columns.items()]).collect()


def top_of_bucket(v):
    bits = max(v.bit_length() - 18, 0)
    return v | ((1 << bits) - 1)


def test_bucket_is_the_highest_equivalent_value(spark):
    rng = random.Random(5)
    cases = [0, 1, 262_143, 262_144, 262_145, 524_287, 524_288, 43_200_000_000, 2**40 + 1]
    cases += [rng.randrange(2 ** rng.randrange(1, 45)) for _ in range(500)]
    rows = values(spark, [(v,) for v in cases], "v bigint", v=F.col("v"), b=latency.hdr_bucket(F.col("v")))
    for r in rows:
        assert r.b == top_of_bucket(r.v)
        assert r.b >= r.v
        assert r.b - r.v <= r.v / 100_000


def test_bucket_of_nothing_is_nothing(spark):
    [r] = values(spark, [(None,)], "v bigint", b=latency.hdr_bucket(F.col("v")))
    assert r.b is None


def test_latencies_are_clamped_and_unknown_times_stay_unknown(spark):
    rows = [(0, 1_999), (5_000, 0), (0, 10**12), (None, 5)]
    got = values(spark, rows, "a bigint, b bigint",
                 p=latency.publish_latency_us(F.col("a"), F.col("b")),
                 e=latency.e2e_latency_us(F.col("a"), F.col("b")))
    assert [r.p for r in got] == [1, 0, 60_000_000, None]
    assert [r.e for r in got] == [1_999_000, 0, 43_200_000_000, None]


def test_one_decimal_rounds_half_even_on_the_exact_value(spark):
    rng = random.Random(7)
    cases = [0.35, 0.25, 0.75, 0.05, 1.45, 2.5, -0.04, -0.25, 0.0, 99999.95, 1e14 + 0.25]
    cases += [rng.randrange(10**6) / 100 for _ in range(500)]
    cases += [rng.uniform(0, 1e6) for _ in range(500)]
    got = values(spark, [(v,) for v in cases], "v double", v=F.col("v"), s=text.one_decimal(F.col("v")))
    for r in got:
        exact = Decimal(r.v).quantize(Decimal("0.1"), rounding=ROUND_HALF_EVEN)
        sign = "-" if r.v < 0 else ""
        assert r.s == f"{sign}{abs(exact)}"


def test_one_decimal_of_special_numbers(spark):
    cases = [(float("inf"),), (float("-inf"),), (float("nan"),), (1e16,)]
    got = values(spark, cases, "v double", s=text.one_decimal(F.col("v")))
    assert [r.s for r in got] == ["∞", "-∞", "NaN", "10000000000000000.0"]


def test_padding_never_cuts(spark):
    got = values(spark, [(1.0,), (123456789.0,)], "v double", s=text.pad_number(F.col("v"), 7))
    assert [r.s for r in got] == ["    1.0", "123456789.0"]


def test_token_lengths_and_alphabet(spark):
    rows = values(spark, [(i,) for i in range(200)], "i bigint",
                  t=naming.random_token("s", F.col("i")),
                  k=naming.random_token("s", F.col("i"), naming.KEY_BYTES))
    assert {len(r.t) for r in rows} == {7}
    assert {len(r.k) for r in rows} == {10}
    assert len({r.t for r in rows}) == 200
    assert all(r.t.replace("-", "a").replace("_", "a").isalnum() for r in rows)


def test_stems_lose_folder_and_last_extension(spark):
    cases = [("workloads/a.b.yaml",), ("plain",), ("x/y/z.yml",)]
    got = values(spark, cases, "p string", s=naming.workload_stem(F.col("p")))
    assert [r.s for r in got] == ["a.b", "plain", "z"]


def test_properties(spark):
    body = "# c\n a = 1 \n! note\nb:2\na=3\nempty=\nk v\n"
    parsed = config.parse_properties(F.col("t"))
    merged = config.merge_properties(parsed, F.create_map(F.lit("b"), F.lit("9")))
    [r] = values(spark, [(body,)], "t string", s=config.properties_text(parsed), m=config.properties_text(merged))
    assert r.s == "a=3;b=2;empty=;k=v"
    assert r.m == "a=3;b=9;empty=;k=v"


def test_properties_of_missing_text_are_empty(spark):
    [r] = values(spark, [(None,)], "t string", s=config.properties_text(config.parse_properties(F.col("t"))))
    assert r.s == ""


def test_transaction_settings_ignore_misspelt_names(spark):
    props = config.parse_properties(F.col("t"))
    rows = [("kafka", "enableTransaction=true"), ("stamped-stream", "eventPerTransaction=5"),
            ("stamped-stream", "eventsPerTransaction=5")]
    got = values(spark, rows, "s string, t string", on=config.transaction_enabled(props),
                 n=config.events_per_transaction(F.col("s"), props))
    assert [(r.on, r.n) for r in got] == [(True, 100), (False, 1), (False, 5)]


def test_json_field_replaces_and_passes_through(spark):
    cases = [('{"a":1.50,"Timestamp":3}',), ("",), ("{bad",), ("[1]",), (None,), ('{"a":null}',)]
    got = values(spark, cases, "p string", j=payload.set_json_field(F.col("p"), "Timestamp", F.lit(9)))
    assert [r.j for r in got][1:5] == ["", "{bad", "[1]", None]
    import json

    assert json.loads(got[0].j) == {"a": 1.5, "Timestamp": 9}
    assert json.loads(got[5].j) == {"a": None, "Timestamp": 9}


def test_short_payload_has_no_stamp(spark):
    got = values(spark, [(bytearray(b"abc"),)], "p binary", t=payload.stamped_time(F.col("p")),
                 r=payload.unstamped_payload(F.col("p")))
    assert got[0].t is None
    assert bytes(got[0].r) == b"abc"


def test_selectors_match_whole_values_and_missing_labels_are_empty(spark):
    m = F.create_map(F.lit("group"), F.lit("client1"))
    [r] = values(spark, [(1,)], "i int",
                 a=labels.label_match(m, "group", "=~", "client"),
                 b=labels.label_match(m, "group", "=~", "client.*"),
                 c=labels.label_match(m, "device", "=", ""),
                 d=labels.label_match(m, "device", "!~", "veth.*|lo"),
                 e=labels.label_match(m, "group", "!=", "x"))
    assert list(r) == [False, True, True, True, True]


def test_round_robin_draws_every_key_once(spark):
    """10,000 draws of one producer give 10,000 distinct keys, each drawn once."""
    from tidewire.operators.aggregates import distinct_keys, key_frequency

    draws = spark.range(10_000).select(
        keys.key_for("KEY_ROUND_ROBIN", F.lit(0), F.col("id")).alias("key")
    )
    [r] = distinct_keys(draws).collect()
    assert (r.draws, r.distinct_keys) == (10_000, 10_000)
    assert key_frequency(draws).where("n <> 1").count() == 0


def test_random_draws_repeat_keys(spark):
    from tidewire.operators.aggregates import distinct_keys

    draws = spark.range(10_000).select(keys.key_for("RANDOM_NANO", F.lit(0), F.col("id")).alias("key"))
    [r] = distinct_keys(draws).collect()
    assert 5_900 < r.distinct_keys < 6_800


def test_first_round_robin_key_is_the_second_of_the_pool(spark):
    rows = spark.createDataFrame([(0,), (9_998,), (9_999,)], "s bigint").select(
        keys.round_robin_index(F.col("s")).alias("i")
    ).collect()
    assert [r.i for r in rows] == [1, 9_999, 0]


def test_registered_key_strategy_is_used(spark):
    keys.register_key_strategy("BY_PRODUCER", lambda producer, seq: producer.cast("string"))
    [r] = spark.range(1).select(keys.key_for("BY_PRODUCER", F.lit(4), F.col("id")).alias("k")).collect()
    assert r.k == "4"


def test_series_ids_tell_label_sets_apart(spark):
    sets = [{"a": 'x",b="y'}, {"a": "x", "b": "y"}, {"a": "x\\"}, {"a": "x\\\\"}, {"b": "y", "a": "x"}]
    rows = spark.createDataFrame([(s,) for s in sets], "labels map<string,string>")
    got = [r.s for r in rows.select(labels.series_id(F.lit("m"), F.col("labels")).alias("s")).collect()]
    assert len(set(got)) == 4 and got[1] == got[4]
