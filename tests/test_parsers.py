"""Hand-written lines per format, exact expected rows; rejects with reasons."""
from pyspark.sql import functions as F

from loglens.sources.ingest import parse_lines, rejected_lines

SQUID_1 = "1700000000.750 12 10.0.0.5 TCP_MISS/200 512 GET http://Www.Example.com:80/a/b.html?x=1 - DIRECT/203.0.113.9 text/html"
SQUID_2 = "1700000001.000 90 10.0.0.5 TCP_MISS/200 4096 CONNECT mail.example.com:443 - DIRECT/203.0.113.8 -"
BLUE_A = ('2023-11-14 22:13:20 15 10.0.0.7 200 TCP_HIT 1 2 GET http a b c text/html x www.example.com 80 '
          '/index.html - - "UA 1.0" y 900 300')
BLUE_B = "1700000000.000 15 10.0.0.8 TCP_MISS/200 1 700 GET http://www.example.com/p/q.gif - - - - www.example.com image/gif"
APACHE_1 = '198.51.100.4 - - [14/Nov/2023:22:13:20 +0000] "GET /shop/item.php?id=1 HTTP/1.1" 200 2326 "-" "Mozilla/5.0"'
APACHE_2 = '198.51.100.4 - - [14/Nov/2023:22:13:21 +0000] "GET /index.html HTTP/1.1" 304 - "-" "Mozilla/5.0"'
IIS = "2023-11-14 22:13:20 W3SVC1 192.0.2.1 GET /a.aspx id=2 80 - 198.51.100.6 HTTP/1.1 UA - - 200 0 0 1500 400"
IIS_SHORT = "2023-11-14 22:13:20 192.0.2.1 GET /a.aspx id=3 q=4 80 198.51.100.7 UA - 200 0 0"


def _parse(spark, lines, kind, log_type):
    df = spark.createDataFrame([(1, l) for l in lines], "datasource_id int, line string")
    return [r.asDict() for r in parse_lines(df, kind, log_type).collect()]


def test_squid(spark):
    rows = _parse(spark, [SQUID_1, SQUID_2], "proxy", "squid")
    a, b = rows
    assert (a["clientip"], a["destip"], a["time"], a["bytesDiff"], a["bytesIn"], a["bytesOut"], a["direction"],
            a["contentType"], a["page"]) == ("10.0.0.5", "www.example.com", 1700000000, 512, 512, 0, "", 1, "/a/b.html")
    assert (b["destip"], b["time"], b["bytesIn"], b["contentType"]) == ("Unknown", 1700000001, 4096, 0)   # D9


def test_bluecoat_both_layouts(spark):
    a, b = _parse(spark, [BLUE_A, BLUE_B], "proxy", "bluecoat")
    assert (a["clientip"], a["destip"], a["page"], a["time"], a["bytesIn"], a["bytesOut"], a["bytesDiff"],
            a["direction"], a["contentType"]) == ("10.0.0.7", "www.example.com", "/index.html", 1700000000, 900, 300,
                                                 600, "in", 1)
    assert (b["clientip"], b["destip"], b["page"], b["bytesIn"], b["bytesOut"], b["bytesDiff"], b["direction"],
            b["contentType"]) == ("10.0.0.8", "www.example.com", "/p/q.gif", 700, 0, 0, "", 0)   # D7


def test_apache(spark):
    a, b = _parse(spark, [APACHE_1, APACHE_2], "web", "apache")
    assert (a["clientip"], a["time"], a["bytesIn"], a["bytesOut"], a["page"], a["query"]) == (
        "198.51.100.4", 1700000000, 0, 2326, "/shop/item.php", "id=1")                        # D6
    assert (b["bytesOut"], b["page"], b["query"]) == (0, "/index.html", "")                  # D1


def test_iis_and_short(spark):
    (a,) = _parse(spark, [IIS], "web", "iis")
    assert (a["clientip"], a["page"], a["query"], a["bytesOut"], a["bytesIn"], a["time"]) == (
        "198.51.100.6", "/a.aspx", "id=2", 1500, 400, 1700000000)
    (b,) = _parse(spark, [IIS_SHORT], "web", "iis-short")
    assert (b["clientip"], b["page"], b["query"], b["bytesIn"], b["bytesOut"]) == (
        "198.51.100.7", "/a.aspx", "q=4", 0, 0)                                               # D31


def test_rejects(spark):
    bad_proxy = [
        ("squid", SQUID_1.replace("TCP_MISS", "'TCP_MISS"), "unbalanced_quote"),
        ("squid", " ".join(SQUID_1.split()[:9]), "unparsed"),                                 # 9 tokens (D34)
        ("squid", SQUID_1.replace(" 512 ", " 5x2 "), "unparsed"),                            # non-numeric size
        ("bluecoat", BLUE_A.replace("10.0.0.7", "host-a"), "unparsed"),                      # no address
        ("squid", "#Fields: date time", "not_digit_first"),                                   # D4
    ]
    for log_type, line, reason in bad_proxy:
        df = spark.createDataFrame([(1, line)], "datasource_id int, line string")
        assert parse_lines(df, "proxy", log_type).count() == 0, line
        assert [r.reason for r in rejected_lines(df, "proxy", log_type).collect()] == [reason], line
    common = '198.51.100.4 - - [14/Nov/2023:22:13:20 +0000] "GET / HTTP/1.1" 200 10'     # 8 tokens (D32)
    notfound = APACHE_1.replace('" 200 ', '" 404 ')
    df = spark.createDataFrame([(3, common), (3, notfound)], "datasource_id int, line string")
    assert parse_lines(df, "web", "apache").count() == 0
    assert sorted(r.reason for r in rejected_lines(df, "web", "apache").collect()) == ["status_404", "unparsed"]


def test_time_zone_is_explicit(spark):
    """The same seconds whatever the session zone, when the log zone is fixed."""
    df = spark.createDataFrame([(1, BLUE_A)], "datasource_id int, line string")
    before = parse_lines(df, "proxy", "bluecoat").first().time
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        after = parse_lines(df, "proxy", "bluecoat").first().time
        shifted = parse_lines(df, "proxy", "bluecoat", tz="Europe/Berlin").first().time
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert before == after == 1700000000
    assert shifted == 1700000000 - 3600


def test_latin1_text_scan(spark, tmp_path):
    from loglens.sources.text import read_log_lines
    p = tmp_path / "access.log"
    p.write_bytes((SQUID_1.replace("/a/b.html", "/caf\xe9.html") + "\n").encode("latin-1"))
    lines = read_log_lines(spark, str(p)).withColumn("datasource_id", F.lit(2))
    (row,) = parse_lines(lines, "proxy", "squid").collect()
    assert row.page == "/café.html"


def test_gzip_logs_are_spread_and_parsed(spark, tmp_path):
    import gzip

    from loglens.sources.text import read_log_lines
    for k in range(2):
        with gzip.open(tmp_path / f"access-{k}.log.gz", "wt", encoding="latin-1") as fh:
            for i in range(500):
                fh.write(SQUID_1.replace("1700000000.750", f"{1700000000 + 1000 * k + i}.5") + "\n")
    lines = read_log_lines(spark, str(tmp_path / "*.gz"))
    assert lines.rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    rows = parse_lines(lines.withColumn("datasource_id", F.lit(2)), "proxy", "squid")
    assert rows.count() == 1000
    assert rows.agg(F.countDistinct("time")).first()[0] == 1000


def test_huge_numbers_do_not_overflow(spark):
    """Counts are stored as logged; what 64 bits do not hold stays at the largest number, and no line fails the job."""
    big = "9" * 19
    squid = SQUID_1.replace(" 512 ", f" -{big} ")
    blue = BLUE_A.replace(" 900 300", f" 9{'0' * 17} -9{'0' * 16}")
    far = SQUID_1.replace("1700000000.750", "1e14")
    df = spark.createDataFrame([(2, squid), (2, far)], "datasource_id int, line string")
    got = sorted((r.time, r.bytesIn, r.bytesDiff) for r in parse_lines(df, "proxy", "squid").collect())
    assert got == [(1700000000, 0, 2**63 - 1), (10**14, 512, 512)]
    (row,) = parse_lines(spark.createDataFrame([(1, blue)], "datasource_id int, line string"), "proxy", "bluecoat").collect()
    assert (row.bytesIn, row.bytesOut, row.bytesDiff) == (9 * 10**17, 0, 99 * 10**16)


def test_sums_beyond_64_bits_stay_at_the_largest_number(spark):
    from loglens.functions.counts import MAX_LONG, add_bytes, byte_difference, byte_sum
    df = spark.createDataFrame([(1, MAX_LONG, 5), (1, 7, 5), (2, 3, None)], "k int, a long, b long")
    got = sorted(tuple(r) for r in df.groupBy("k").agg(byte_sum("a"), byte_sum("b"), byte_sum(add_bytes("a", "b"))).collect())
    assert got == [(1, MAX_LONG, 10, MAX_LONG), (2, 3, None, None)]
    assert [r[0] for r in df.select(byte_difference("a", F.lit(-5))).collect()] == [MAX_LONG, 12, 8]
