"""Queries that SQL can express, against DuckDB over the whole tables."""
import duckdb
import pytest

from loglens.llm import entries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(entries.ORACLES))
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "benchmark", "pages"):
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{SF}/{table}.parquet')")
    df = entries.QUERIES[name](spark, SF)
    rel = con.sql(entries.ORACLES[name])
    want = [dict(zip(rel.columns, r)) for r in rel.fetchall()]
    got = [r.asDict() for r in df.collect()]
    key = lambda r: sorted((k, repr(v)) for k, v in r.items())
    assert sorted(got, key=key) == sorted(want, key=key) and len(got) > 40


def test_every_operator_has_a_query():
    assert sorted(int(n[2:].split("_")[0]) for n in entries.QUERIES) == list(range(1, 14))
