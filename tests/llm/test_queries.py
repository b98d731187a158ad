"""Registered queries with SQL against DuckDB, on the smallest tables."""

import duckdb
import pytest

from spoorline.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def test_each_operator_has_one_query():
    assert sorted(n.partition("_")[0] for n in queries.QUERIES) == sorted([f"op{i}" for i in range(1, 11)] + ["pipeline"])


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_matches_sql(spark, duck, name):
    got = queries.QUERIES[name](spark, SF)
    want = duck.sql(queries.ORACLES[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    at = [want.columns.index(c) for c in columns]
    plain = lambda v: round(float(v), 6) if isinstance(v, float) else bool(v) if type(v).__name__ == "bool_" else v
    rows = sorted(str(tuple(plain(r[c]) for c in columns)) for r in got.collect())
    assert rows and rows == sorted(str(tuple(plain(r[i]) for i in at)) for r in want.fetchall())
