"""An import parses each line once and keeps what it cannot parse."""
import pytest
from pyspark.sql import functions as F

from loglens.plans.store import LogStore
from loglens.operators.indicators import reject_indicators
from loglens.sources.ingest import parse_lines, rejected_lines, tagged_lines

LINES = ['1700000000.1 5 10.0.0.1 TCP_MISS/200 100 GET http://h.example.com/p - DIRECT/h text/html',
         "1700000000.1 5 10.0.0.1 TCP_MISS/200 100 GET http://h.example.com/p?id=1'or - DIRECT/h text/html",
         "#Fields: x", "", "1 2 3", None,
         "1700000000.1 5 10.0.0.1 TCP_MISS/200 99999999999999999999 GET http://h.example.com/p - DIRECT/h text/html",
         "1700000000.1 5 10.0.0.1 TCP_MISS/200 -99999999999999999999 GET http://h.example.com/p - DIRECT/h text/html"]


@pytest.fixture(scope="module")
def lines(spark):
    return spark.createDataFrame([(2, "squid", x) for x in LINES], "datasource_id int, type string, line string")


def test_rows_and_rejects_are_those_of_the_two_parses(spark, lines, tmp_path):
    store = LogStore(spark, str(tmp_path / "s"))
    store.import_lines(lines, "proxy")
    store.import_lines(lines, "proxy")
    rows, rejects = store.read("proxy_data"), store.read("rejects")
    want = parse_lines(lines, "proxy")
    assert sorted(map(repr, rows.select(*want.columns).collect())) == sorted(map(repr, want.collect() * 2))
    old = rejected_lines(lines, "proxy").select("line", "reason", "datasource_id")
    assert sorted(map(repr, rejects.select(*old.columns).collect())) == sorted(map(repr, old.collect() * 2))
    assert {r.kind for r in rejects.collect()} == {"proxy"}
    ids = [r.id for r in rows.collect()]
    assert len(set(ids)) == len(ids) == 6 and None not in ids
    hits = reject_indicators(rejects).collect()
    assert {(r.detector, r.reason) for r in hits} == {("meta", "unbalanced_quote")} and len(hits) == 2
    assert reject_indicators(rejects.limit(0)).count() == 0


def test_the_plan_scans_and_parses_once(spark, lines, tmp_path):
    lines.write.parquet(str(tmp_path / "lines"))
    plan = tagged_lines(spark.read.parquet(str(tmp_path / "lines")), "proxy")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "Exchange" not in plan


def test_integers_beyond_64_bits_stay_at_the_largest(spark, lines):
    got = sorted(r.bytesIn for r in parse_lines(lines, "proxy").collect())
    assert got == [0, 100, 2**63 - 1]


def test_positions_of_the_iis_types_reach_the_import(spark):
    line = "2023-11-14 22:13:20 W3 S 192.0.2.1 GET /p q=1 80 198.51.0.7 UA - - 200 0 0"
    df = spark.createDataFrame([(5, "iis-short", line)], "datasource_id int, type string, line string")
    moved = {"iis-short": {"page": 6, "query": 7, "clientip": 9, "status": 13}}
    row = parse_lines(df, "web", positions=moved).first()
    assert (row.page, row.query, row.clientip) == ("/p", "q=1", "198.51.0.7")
    assert parse_lines(df.withColumn("line", F.regexp_replace("line", " 200 ", " 404 ")), "web", positions=moved).count() == 0
    with pytest.raises(ValueError, match="no token positions"):
        parse_lines(df, "web", positions={"apache": {"page": 1}})
