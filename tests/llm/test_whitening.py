"""Whitening against exact fractions and plain covariances."""

from fractions import Fraction

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from tidewire.llm import queries as llm
from tidewire.llm import whitening

OP11 = llm.queries()["op11_whitening"]
SF = "/root/testdata/sf0.01"


def written(folder, rows, kind=pa.float32()):
    ids, vectors = zip(*rows, strict=True)
    pq.write_table(pa.table({"vec_id": pa.array(ids, pa.int64()), "embedding": pa.array(vectors, pa.list_(kind))}), folder / "embeddings.parquet")
    return str(folder)


def whole(vector):
    return [int(np.floor(256 * float(c))) for c in vector]


def check(rows, vectors):
    """Every contract column from the definitions, covariances as fractions rounded once."""
    x = {i: np.array(whole(v), object) for i, v in vectors.items()}
    fit = [np.array(v, object) for v in {tuple(v) for v in x.values()}]
    n, sums = len(fit), sum(fit)
    centred = [n * v - sums for v in fit]
    d = len(sums)
    v = np.array([[float(Fraction(int(sum(c[i] * c[j] for c in centred)), n**3)) for j in range(d)] for i in range(d)])
    values, axes = np.linalg.eigh(v)
    found = {}
    for r in rows:
        found.setdefault((r.vec_id, r.component), r)
    for i, own in x.items():
        y = n * own - sums
        for k in range(1, min(4, d) + 1):
            r, e = found[i, k], values[-k]
            assert (r.n, r.deviation) == (n, int(sum(y * y)))
            assert abs(r.explained - e / np.trace(v)) <= 1e-6 * r.explained
            assert abs(abs(r.whitened) - abs((y / n).astype(float) @ axes[:, -k] / np.sqrt(e))) < 1e-7
            assert 0 <= r.identity_error < 1e-9


def test_supplied_vectors(spark):
    vectors = {r.vec_id: r.embedding for r in spark.read.parquet(f"{SF}/embeddings.parquet").limit(60).collect()}
    rng = np.random.default_rng(0)
    few = {i: v[:6] for i, v in vectors.items()} | {1000 + i: vectors[0][:6] for i in range(20)}
    few |= {2000 + i: list(rng.normal(size=6) * [1, 5, 0.1, 1, 2, 30] + 100) for i in range(200)}
    df = spark.createDataFrame([(i, [float(c) for c in v]) for i, v in few.items()], "vec_id long, embedding array<double>")
    check(whitening.whiten(df).collect(), few)


def test_copies_do_not_weigh(spark, tmp_path):
    rng = np.random.default_rng(1)
    vectors = [(i, rng.normal(size=5).tolist()) for i in range(50)]
    (tmp_path / "a").mkdir()
    (tmp_path / "b").mkdir()
    once = OP11(spark, written(tmp_path / "a", vectors)).collect()
    many = OP11(spark, written(tmp_path / "b", vectors + [(7, vectors[7][1])] * 500)).collect()
    assert {tuple(r) for r in many} == {tuple(r) for r in once} and len(many) == 4 * 550


@pytest.mark.parametrize("scale", [1e9, 1e15])
def test_large_entries_stay_exact(spark, tmp_path, scale):
    """Sums beyond a long are added up exactly; a deviation beyond a long is null."""
    rng = np.random.default_rng(2)
    vectors = [(i, (rng.normal(size=3) * scale).tolist()) for i in range(40)]
    rows = OP11(spark, written(tmp_path, vectors, pa.float64())).collect()
    x = np.array([whole(v) for _, v in vectors], object)
    exact = [int(sum((40 * v - x.sum(axis=0)) ** 2)) for v in x]
    assert {(r.vec_id, r.deviation) for r in rows} == {(i, e if e < 2**63 else None) for i, e in enumerate(exact)}
    assert all(r.identity_error < 1e-9 for r in rows)


def test_sums_of_tasks_add_up(spark):
    rng = np.random.default_rng(3)
    x = rng.integers(-(2**40), 2**40, (200, 3))
    codes = spark.createDataFrame([(whitening.packed(v),) for v in x], "code binary").repartition(7)
    found = whitening.exact_sums(codes, 3, whitening._squares([5, -7, 0]))
    z = x.astype(object) - np.array([5, -7, 0], object)
    assert found == {(i, j): int(sum((z[:, i] + z[:, j] * (i != j)) ** 2)) for i in range(3) for j in range(i, 3)}


def test_codes(spark):
    for v in ([], [0], [127, -128], [128], [-(2**31), 2**31 - 1], [2**62, -(2**63)]):
        x = np.array(v, np.int64)
        assert whitening.matrix([whitening.packed(x)] * 2, len(v)).tolist() == [v, v]


def test_without_variance_and_other_lengths(spark, tmp_path):
    rows = OP11(spark, written(tmp_path, [(1, [0.5, 0.25]), (2, [0.5, 0.25]), (3, [1.0]), (4, [])])).collect()
    assert {(r.vec_id, r.component, r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in rows} == {
        (i, k, 1, 0 if i < 3 else None, None, None, None) for i in (1, 2, 3, 4) for k in (1, 2)
    }
