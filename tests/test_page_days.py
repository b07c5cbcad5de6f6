"""Page changes over day folders equal those over the facts, and read two weeks and footers only."""
from pyspark.sql import functions as F

from loglens.operators import web_reports
from loglens.operators.page_days import DAY_SECONDS, PageDays, day_of
from test_page_index import _scanned

T = 1_700_000_000
ROWS = [(1, T, "/new"), (1, T - 1, "/new"), (1, T - 1, "/new"), (1, T - 8 * DAY_SECONDS, "/old"), (1, T - 7 * DAY_SECONDS, "/edge"), (1, T - 13 * DAY_SECONDS, None),
        (1, T - 14 * DAY_SECONDS, "/edge2"), (1, T - 14 * DAY_SECONDS + 1, "/in"), (1, T - 40 * DAY_SECONDS, "/gone"), (1, None, "/timeless"),
        (2, 5, "/both"), (2, 4, "/both"), (2, -8 * DAY_SECONDS, "/both"), (2, -9 * DAY_SECONDS, "/before 1970"), (3, 1 << 61, "/far"), (3, (1 << 61) - 1, "/far"),
        (3, (1 << 61) - 8 * DAY_SECONDS, "/farther"), (None, T, "/no source"), (4, T, "/alone")]


def _facts(spark):
    return spark.createDataFrame(ROWS, "datasource_id int, time bigint, page string")


def _same(left, right):
    return sorted(map(tuple, left.collect()), key=repr) == sorted(map(tuple, right.select(*left.columns).collect()), key=repr)


def test_same_rows_as_the_facts(spark, tmp_path):
    facts, days = _facts(spark), PageDays(spark, str(tmp_path / "d"))
    days.add(facts.filter("page != '/old' or page is null"))
    days.add(facts.filter("page in ('/old', '/new')"))          # overlaps the first
    assert _same(web_reports.latest_time(facts), days.latest_time())
    assert _same(web_reports.page_week_totals(facts), web_reports.totals_of_weeks(days.weeks()))
    changes = web_reports.changes_of_weeks(days.weeks())
    assert _same(web_reports.page_changes(facts), changes) and changes.count() > 5


def test_empty(spark, tmp_path):
    days = PageDays(spark, str(tmp_path / "d"))
    assert days.latest_time().count() == 0 and web_reports.changes_of_weeks(days.weeks()).count() == 0
    days.add(_facts(spark).limit(0))
    assert days.latest_time().count() == 0 and web_reports.totals_of_weeks(days.weeks()).count() == 0


def test_days(spark):
    got = spark.createDataFrame([(0,), (86399,), (86400,), (-1,), (-86400,), (-86401,), (1 << 61,), (-(1 << 61),), (None,)], "t bigint").select(day_of(F.col("t"))).collect()
    assert [r[0] for r in got] == [0, 0, 1, -1, -1, -2, (1 << 31) - 1, -(1 << 31) + 1, None]


def test_reads_two_weeks_and_footers(spark, tmp_path):
    e = spark.range(60 * 1000)
    facts = e.select(F.lit(1).alias("datasource_id"), (F.lit(T) - F.floor(F.col("id") / 1000).cast("bigint") * DAY_SECONDS - F.col("id") % 1000).alias("time"),
                     F.concat(F.lit("/"), F.col("id") % 3000).alias("page"))
    days = PageDays(spark, str(tmp_path / "d"))
    days.add(facts)
    rows, scanned = _scanned(web_reports.changes_of_weeks(days.weeks()))
    assert rows == web_reports.page_changes(facts).count()
    read = sum(n for folder, n in scanned.items() if folder == "days")
    assert 13_000 < read <= 16_000, scanned
    plan = days.latest_time()._jdf.queryExecution().toString()
    assert "PushedAggregation: [MAX(time)]" in plan and "PushedGroupBy: [datasource_id, day]" in plan
