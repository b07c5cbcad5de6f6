"""Decisions of SURVEY §1.4 not covered elsewhere: D2, D13, D15, D23, D28, D35."""
from pyspark.sql import functions as F

from loglens.operators.beacon import beacon_listing, beacon_scores
from loglens.operators.explore import page_search
from loglens.operators.proxy_reports import squid_detail
from loglens.schemas import PROXY_DATA
from loglens.sources.ingest import parse_lines


def _proxy(spark, rows):
    full = [(i, c, d, t, b, 0, b, "", h, p, ds) for i, (c, d, t, b, h, p, ds) in enumerate(rows)]
    return spark.createDataFrame(full, PROXY_DATA)


def test_d2_negative_raw_score_is_clamped(spark, registry):
    # three requests 2 s apart to a popular host name: -3 (few) +2 (regular) = -1 -> stored 0
    rows = [("10.0.0.1", "busy.example.com", 1000 + 2 * k, 1, 0, "/", 2) for k in range(3)]
    rows += [("10.0.0.%d" % k, "busy.example.com", 5000 + k, 1, 0, "/", 2) for k in range(2, 8)]
    (b,) = [r for r in beacon_scores(_proxy(spark, rows), registry[1]).collect() if r.clientip == "10.0.0.1"]
    assert (b.raw_score, b.beaconScore) == (-1, 0)


def test_d13_destinations_are_case_sensitive(spark, registry):
    rows = [("10.0.0.1", "A.example.com", 1000 + 60 * k, 1, 0, "/", 2) for k in range(5)]
    rows += [("10.0.0.1", "a.example.com", 1000 + 60 * k, 1, 0, "/", 2) for k in range(5)]
    got = {r.destip: r["count"] for r in beacon_scores(_proxy(spark, rows), registry[1]).collect()}
    assert got == {"A.example.com": 5, "a.example.com": 5}


def test_d15_listing_threshold_is_a_parameter(spark, registry):
    rows = [("10.0.0.1", "h.example.com", 1000 + 37 * k * k, 1, 0, "/", 2) for k in range(6)]
    b = beacon_scores(_proxy(spark, rows), registry[1])
    score = b.first().beaconScore
    assert beacon_listing(b, min_score=score + 1).count() == 0
    (row,) = beacon_listing(b, min_score=score).collect()
    assert row.probability == ("High" if score >= 6 else "Medium" if score >= 3 else "Low")


def test_d23_squid_direction_is_deterministic(spark, registry):
    rows = [("10.0.0.1", "h", 1000 + k, 5, 0, "/", 2) for k in range(4)]
    assert [r.direction for r in squid_detail(_proxy(spark, rows), registry[1]).collect()] == [""]


def test_d28_search_wildcards_are_literal_by_default(spark):
    rows = [("10.0.0.1", "h", 1000, 5, 0, "/100%_off", 2), ("10.0.0.2", "h", 1001, 5, 0, "/100xyoff", 2)]
    df = _proxy(spark, rows)
    assert {r.clientip for r in page_search(df, "100%_off").collect()} == {"10.0.0.1"}
    assert {r.clientip for r in page_search(df, "100%off", wildcards=True).collect()} == {"10.0.0.1", "10.0.0.2"}


def test_d35_apostrophe_in_apache_path_is_kept(spark):
    line = '198.51.100.4 - - [14/Nov/2023:22:13:20 +0000] "GET /o\'brien.html HTTP/1.1" 200 10 "-" "UA"'
    df = spark.createDataFrame([(3, line)], "datasource_id int, line string")
    (row,) = parse_lines(df, "web", "apache").collect()
    assert (row.page, row.query) == ("/o'brien.html", "")
