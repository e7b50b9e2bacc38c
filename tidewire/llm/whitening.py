"""Whitened embeddings: covariances by polarisation, assembled for an eigendecomposition.

Entries are whole numbers x = floor(256 c), so every sum here is exact. The fit list holds each
distinct x vector once. For every dimension i and every pair (i, j), tasks add up the squares of
z_i and of z_i + z_j, where z is x centred on the whole number next to the mean; what the mean is off from
it, below one half, is taken out exactly on the driver. That gives n^2 var(x_i) and n^2 var(x_i + x_j) as whole numbers, and

    cov(x_i, x_j) = (var(x_i + x_j) - var(x_i) - var(x_j)) / 2

is rounded once, to a double. Only sums by dimension and pair leave the tasks; what the driver and the
tasks are handed grows with the dimension alone.

Defined results: rows whose vector is null or has null or non-finite entries are dropped. Entries beyond the
range of a long count as its ends. The dimension is the commonest one of the fit list (the larger of equal
ones); rows of another length keep their rows, with null deviation and whitened values. A component
without variance has null whitened values; without any variance the shares are null too. Equal vectors get
equal results, repeated rows stay, an empty table gives no rows. A deviation that does not fit a long is null.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewire.operators.lineage import stored

SCALE = 256
COMPONENTS = 4
#: A share of the whole variance below which a component has none but rounding errors.
NO_VARIANCE = 1e-13
BATCH_BYTES = 1 << 22

_WIDTHS = (1, 2, 4, 8)
_LIMB_BITS = 40
_LIMBS = 5
_FITS = 1 << 62
_SUMS = T.StructType(
    [T.StructField("i", T.IntegerType()), T.StructField("j", T.IntegerType())]
    + [T.StructField(f"limb{k}", T.LongType()) for k in range(_LIMBS)]
)
FIELDS = [
    T.StructField("component", T.IntegerType()),
    T.StructField("n", T.LongType()),
    T.StructField("deviation", T.LongType()),
    T.StructField("whitened", T.DoubleType()),
    T.StructField("explained", T.DoubleType()),
    T.StructField("identity_error", T.DoubleType()),
]


def whole_entries(column: pa.ListArray) -> list[np.ndarray | None]:
    """x of every row's vector, None where the row is to be dropped."""
    offsets = column.offsets.to_numpy().astype(np.int64)
    scaled = SCALE * column.values.cast(pa.float64()).to_numpy(zero_copy_only=False)
    bad = np.concatenate([[0], np.cumsum(~np.isfinite(scaled))])
    low, high = -(2.0**63), np.nextafter(2.0**63, 0)
    with np.errstate(invalid="ignore"):
        x = np.clip(np.floor(np.where(np.isfinite(scaled), scaled, 0.0)), low, high).astype(np.int64)
    valid = column.is_valid().to_numpy(zero_copy_only=False) & (bad[offsets[1:]] == bad[offsets[:-1]])
    return [x[a:b] if ok else None for a, b, ok in zip(offsets[:-1], offsets[1:], valid, strict=True)]


def packed(x: np.ndarray) -> bytes:
    """The entries in as few bytes each as the vector allows; equal vectors give equal bytes."""
    most = max(int(x.max()), -int(x.min()) - 1) if len(x) else 0
    width = next(w for w in _WIDTHS if most < 1 << (8 * w - 1))
    return bytes([width]) + x.astype(f"<i{width}").tobytes()


def matrix(codes: Sequence[bytes], dimension: int) -> np.ndarray:
    """The vectors of one dimension, one a row, out of their codes."""
    found = [np.empty((0, dimension), np.int64)]
    for width in _WIDTHS:
        own = [c[1:] for c in codes if c[0] == width and len(c) == 1 + width * dimension]
        found.append(np.frombuffer(b"".join(own), f"<i{width}").reshape(len(own), dimension).astype(np.int64))
    return np.concatenate(found)


def _wide(x: np.ndarray, most: int) -> np.ndarray:
    """``x``, as Python's whole numbers if sums up to ``most`` would not fit a long."""
    return x if most < _FITS else x.astype(object)


def _most(x: np.ndarray) -> int:
    return max(abs(int(x.max())), abs(int(x.min()))) if x.size else 0


def _limbs(total: int) -> list[int]:
    """Five parts whose sums over all tasks fit longs; the last one carries the sign."""
    mask = (1 << _LIMB_BITS) - 1
    return [total >> (_LIMB_BITS * k) & mask for k in range(_LIMBS - 1)] + [total >> (_LIMB_BITS * (_LIMBS - 1))]


def exact_sums(
    fit: DataFrame, dimension: int, add: Callable[[np.ndarray], dict[tuple[int, int], int]]
) -> dict[tuple[int, int], int]:
    """Sums over the fit list of what ``add`` returns for some of its vectors, by pair of numbers.

    Each task sends one row for each pair; the driver gets one for each pair in all.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[tuple[int, int], int] = {}
        rows = max(1, BATCH_BYTES // (8 * max(dimension, 1)))
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                x = matrix(batch.column(0).slice(at, rows).to_pylist(), dimension)
                if len(x):
                    for pair, value in add(x).items():
                        totals[pair] = totals.get(pair, 0) + value
        if totals:
            columns = zip(*[[i, j, *_limbs(total)] for (i, j), total in totals.items()], strict=True)
            kinds = [pa.int32()] * 2 + [pa.int64()] * _LIMBS
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=_SUMS.names)

    parts = fit.select("code").mapInArrow(run, _SUMS).groupBy("i", "j").agg(*[F.sum(f"limb{k}").alias(f"limb{k}") for k in range(_LIMBS)])
    return {(r.i, r.j): sum(r[2 + k] << (_LIMB_BITS * k) for k in range(_LIMBS)) for r in parts.collect()}


def _count_and_sums(x: np.ndarray) -> dict[tuple[int, int], int]:
    sums = _wide(x, _most(x) * len(x)).sum(axis=0)
    return {(-1, -1): len(x)} | {(i, -1): int(s) for i, s in enumerate(sums)}


def _squares(centre: list[int]) -> Callable[[np.ndarray], dict[tuple[int, int], int]]:
    """Sums of squares of centred entries, (i, i), and of their sums by pair, (i, j)."""

    def add(x: np.ndarray) -> dict[tuple[int, int], int]:
        wide = _wide(x, max(_most(x), max(map(abs, centre))) * 2)
        z = wide - np.array(centre, wide.dtype)
        z = _wide(z, 4 * _most(z) ** 2 * len(z))
        out = {}
        for i in range(z.shape[1]):
            sums = z[:, i:] + z[:, i : i + 1]
            sums[:, 0] = z[:, i]
            out |= {(i, i + k): int(v) for k, v in enumerate((sums * sums).sum(axis=0))}
        return out

    return add


@dataclass(frozen=True)
class Whitening:
    """What a fit list says: size, sums, the leading components and their shares of all variance."""

    n: int
    sums: list[int]
    vectors: np.ndarray  # (dimension, components)
    values: np.ndarray
    explained: list[float | None]

    def centred(self, x: np.ndarray) -> np.ndarray:
        """n x - S, exact."""
        wide = _wide(x, self.n * (_most(x) + 1) + max(map(abs, self.sums), default=0))
        return wide * self.n - np.array(self.sums, wide.dtype)

    def project(self, y: np.ndarray) -> np.ndarray:
        """Whitened values of centred vectors; NaN for components without variance."""
        with np.errstate(divide="ignore", invalid="ignore"):
            scale = np.where(self.values > 0, 1 / np.sqrt(self.values), np.nan)
        return ((y / self.n).astype(np.float64) @ self.vectors) * scale


def covariance(n: int, sums: list[int], centre: list[int], squares: dict[tuple[int, int], int]) -> np.ndarray:
    """All covariances as differences of variances of dimensions and of their pair sums."""
    d = len(sums)
    off = [s - n * c for s, c in zip(sums, centre, strict=True)]
    own = [n * squares[i, i] - off[i] ** 2 for i in range(d)]
    v = np.empty((d, d))
    for i in range(d):
        v[i, i] = own[i] / n**2
        for j in range(i + 1, d):
            pair = n * squares[i, j] - (off[i] + off[j]) ** 2
            v[i, j] = v[j, i] = (pair - own[i] - own[j]) / (2 * n**2)
    return v


def fit_whitening(fit: DataFrame, dimension: int, components: int = COMPONENTS) -> Whitening:
    """The whitening of a table of distinct codes (column ``code``)."""
    found = exact_sums(fit, dimension, _count_and_sums)
    n, sums = found[-1, -1], [found[i, -1] for i in range(dimension)]
    centre = [(2 * s + n) // (2 * n) for s in sums]
    v = covariance(n, sums, centre, exact_sums(fit, dimension, _squares(centre)))
    values, vectors = np.linalg.eigh(v)
    top = np.argsort(-values, kind="stable")[:components]
    values, vectors, trace = values[top], vectors[:, top], float(np.trace(v))
    values = np.where(values > trace * NO_VARIANCE, values, 0.0)
    lead = np.abs(vectors).argmax(axis=0)
    vectors = vectors * np.where(vectors[lead, np.arange(vectors.shape[1])] < 0, -1.0, 1.0)
    return Whitening(n, sums, vectors, values, [float(e) / trace if trace > 0 else None for e in values])


def identity_error(fit: DataFrame, dimension: int, whitening: Whitening) -> float | None:
    """How far the covariance of the whitened fit list is from the identity, measured on the list itself."""
    some = np.flatnonzero(whitening.values > 0)
    if not len(some):
        return None
    width = len(some)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width + 1, width))
        for batch in batches:
            x = matrix(batch.column(0).to_pylist(), dimension)
            w = whitening.project(whitening.centred(x))[:, some]
            total += np.concatenate([w.T @ w, w.sum(axis=0, keepdims=True)])
        yield pa.RecordBatch.from_arrays([pa.array(range(total.size), pa.int32()), pa.array(total.ravel())], names=["i", "part"])

    sums = fit.select("code").mapInArrow(run, "i int, part double").groupBy("i").agg(F.sum("part").alias("part")).collect()
    total = np.zeros((width + 1) * width)
    total[[r.i for r in sums]] = [r.part for r in sums]
    total = total.reshape(width + 1, width) / whitening.n
    return float(np.abs(total[:-1] - np.outer(total[-1], total[-1]) - np.eye(width)).max())


def fit_list(vectors: DataFrame, column: str = "embedding") -> DataFrame:
    """Every distinct x vector once, as its dimension ``d`` and a ``code``, written to the shared folder."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            some = [x for x in whole_entries(batch.column(0)) if x is not None]
            lengths, codes = pa.array(map(len, some), pa.int32()), pa.array(map(packed, some), pa.binary())
            yield pa.RecordBatch.from_arrays([lengths, codes], names=["d", "code"])

    entries = vectors.select(F.col(column).cast("array<double>").alias("entries"))
    return stored(entries.mapInArrow(run, "d int, code binary").distinct(), "vectors")


def whiten(
    vectors: DataFrame, keep: Sequence[str] = ("vec_id",), column: str = "embedding", components: int = COMPONENTS
) -> DataFrame:
    """A row for each vector and component: the columns ``keep``, deviation, whitened value and shares.

    A kept column that has the name of a new one is left out.
    """
    names = {f.name for f in FIELDS}
    kept = [c for c in keep if c not in names]
    schema = T.StructType([vectors.schema[c] for c in kept] + FIELDS)
    fit = fit_list(vectors, column)
    commonest = fit.groupBy("d").count().orderBy(F.desc("count"), F.desc("d")).head()
    if commonest is None or not commonest.d:
        return vectors.sparkSession.createDataFrame([], schema)
    whitening = fit_whitening(fit, commonest.d, components)
    error = identity_error(fit, commonest.d, whitening)
    dimension, width = commonest.d, len(whitening.values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = whole_entries(batch.column(batch.num_columns - 1))
            there = [r for r, x in enumerate(rows) if x is not None]
            fitting = [r for r in there if len(rows[r]) == dimension]
            x = np.array([rows[r] for r in fitting], np.int64).reshape(len(fitting), dimension)
            y = whitening.centred(x)
            exact = (_wide(y, _most(y) ** 2 * dimension) ** 2).sum(axis=1)
            deviation = {r: int(s) if s < 1 << 63 else None for r, s in zip(fitting, exact, strict=True)}
            values = dict(zip(fitting, whitening.project(y).tolist(), strict=True))
            at = pa.array(np.repeat(np.array(there, np.int64), width))
            count = len(there)
            yield pa.RecordBatch.from_arrays(
                [
                    *[c.take(at) for c in batch.columns[:-1]],
                    pa.array(list(range(1, width + 1)) * count, pa.int32()),
                    pa.array([whitening.n] * (count * width), pa.int64()),
                    pa.array([deviation.get(r) for r in there for _ in range(width)], pa.int64()),
                    pa.array([v for r in there for v in values.get(r, [None] * width)], pa.float64(), from_pandas=True),
                    pa.array(whitening.explained * count, pa.float64()),
                    pa.array([error] * (count * width), pa.float64()),
                ],
                names=schema.names,
            )

    rows = vectors.select(*[F.col(c) for c in kept], F.col(column).cast("array<double>").alias("entries of the vector"))
    return rows.mapInArrow(run, schema)
