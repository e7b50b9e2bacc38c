"""Compare a query with its SQL: columns by name, rows in any order, exact values."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb
from pyspark.sql import SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for name in TABLES:
        path = Path(sf_dir) / f"{name}.parquet"
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return connection


def _plain(value: object) -> object:
    if isinstance(value, float):
        if math.isnan(value):
            return "nan"
        return value + 0.0 if value else 0.0
    return value


def _rows(names: list[str], rows: list[tuple]) -> list[tuple]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    plain = [tuple(_plain(row[i]) for i in order) for row in rows]
    return sorted(plain, key=lambda r: tuple((v is None, str(type(v)), v if v is not None else 0) for v in r))


def difference(spark: SparkSession, query, sql: str, sf_dir: str) -> str | None:
    """None when both agree, else a short account of the first difference."""
    df = query(spark, sf_dir)
    got = _rows(df.columns, [tuple(r) for r in df.collect()])
    connection = connect(sf_dir)
    result = connection.execute(sql)
    names = [d[0] for d in result.description]
    kinds = {d[0]: str(d[1]) for d in result.description}
    want = _rows(names, result.fetchall())
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} != {sorted(names)}"
    spark_kinds = dict(df.dtypes)
    odd = {
        n: (spark_kinds[n], kinds[n])
        for n in names
        if not _same_kind(spark_kinds[n], kinds[n])
    }
    if odd:
        return f"types {odd}"
    if len(got) != len(want):
        return f"{len(got)} rows != {len(want)}; first {got[:2]} / {want[:2]}"
    for a, b in zip(got, want, strict=True):
        if a != b:
            return f"{sorted(names)}: {a} != {b}"
    if not got:
        return "no rows on either side"
    return None


_KINDS = {
    "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR",
    "boolean": "BOOLEAN", "date": "DATE", "timestamp_ntz": "TIMESTAMP",
}


def _same_kind(spark_kind: str, duck_kind: str) -> bool:
    return _KINDS.get(spark_kind, spark_kind) == duck_kind
