"""The corpus queries are registered and, where SQL can state them, give what DuckDB gives."""

import os
from glob import glob

import duckdb
import pytest

import __spark_entry__ as entry
from fibrelens.llm import queries as corpus

SMALL = "/root/testdata/sf0.001"
ORACLES = corpus.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob(f"{SMALL}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def test_corpus_queries_are_registered():
    found = entry.queries()
    assert corpus.queries().keys() <= found.keys() and "pipeline" in found
    assert ORACLES.keys() <= entry.oracle_sql().keys()


@pytest.mark.parametrize("name", list(ORACLES))
def test_matches_sql(spark, duck, name):
    df = corpus.queries()[name](spark, SMALL)
    result = duck.execute(ORACLES[name])
    columns = [d[0] for d in result.description]
    assert set(columns) <= set(df.columns)
    got = sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)
    assert got == sorted(result.fetchall(), key=repr)
