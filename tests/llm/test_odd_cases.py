"""Every query on nulls, empties, ties, repeated rows, long texts, empty tables and clashing columns."""

from collections import Counter

import duckdb
import pytest
from fixtures import CONVERSATIONS, EMBEDDINGS, ODD

from tidewire.llm import queries as llm

QUERIES = llm.queries()
#: Queries with one row for each document.
FULL = sorted(set(QUERIES) - {"op2_decontaminate", "op11_whitening", "op12_conversation_repair", "op13_retrieval_packing"})
KEYS = {"op11_whitening": "vec_id", "op12_conversation_repair": "conv_id"}


def rows(df):
    return Counter(tuple(r) for r in df.collect())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_odd_rows(spark, odd_dir, name):
    df = QUERIES[name](spark, odd_dir)
    found = df.select(KEYS.get(name, "doc_id")).collect()
    if name in FULL:
        assert Counter(r.doc_id for r in found) == Counter(d[0] for d in ODD)
    if name == "op11_whitening":
        valid = [i for i, v in EMBEDDINGS if v is not None and None not in v and all(abs(c) < float("inf") for c in v)]
        assert Counter(r.vec_id for r in found) == Counter(valid * 3)
    if name == "op12_conversation_repair":
        assert Counter(r.conv_id for r in found) == Counter({c[0] for c in CONVERSATIONS})
    if name == "op13_retrieval_packing":
        assert {r.doc_id for r in found} == {d[0] for d in ODD}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_clashing_columns_change_nothing(spark, odd_dir, clashing_dir, name):
    assert rows(QUERIES[name](spark, odd_dir)) == rows(QUERIES[name](spark, clashing_dir))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_empty_tables(spark, odd_dir, empty_dir, name):
    df = QUERIES[name](spark, empty_dir)
    assert df.count() == 0
    assert df.dtypes == QUERIES[name](spark, odd_dir).dtypes


@pytest.mark.parametrize("name", sorted(llm.oracle_sql()))
def test_odd_rows_equal_sql(spark, odd_dir, name):
    connection = duckdb.connect()
    connection.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{odd_dir}/documents.parquet')")
    result = connection.execute(llm.oracle_sql()[name])
    names = [d[0] for d in result.description]
    assert rows(QUERIES[name](spark, odd_dir).select(names)) == Counter(result.fetchall())
