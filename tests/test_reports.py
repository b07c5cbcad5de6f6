"""Indicators (P4/F17-F20), suspicion rounding (D21/D22), page diff bounds (D16/D17), top-k."""
from pyspark.sql import functions as F

from loglens.operators import indicators, suspicion, web_reports
from loglens.operators.topk import top_k
from loglens.schemas import WEB_DATA

CASES = [
    ("id=1 union select a", ["keyword"]),
    ("id=1' or '1'='1", ["meta"]),
    ("a=1;drop table t", ["keyword", "meta"]),
    ("cmd=exec xp_cmdshell", ["exec"]),
    ("q=<b>", ["xss"]),
    ("q=%3Cimg src%3E", ["xss"]),
    ("color=red", []),
    ("", []),
]


def _web(spark, rows):
    return spark.createDataFrame(rows, WEB_DATA)


def test_indicator_cases(spark):
    rows = [(i, "198.51.100.1", 1_700_000_000 + i, 0, 10, "/p", q, 3) for i, (q, _) in enumerate(CASES)]
    got = {}
    for r in indicators.indicator_rows(_web(spark, rows)).collect():
        got.setdefault(r.query, []).append(r.detector)
    for q, expected in CASES:
        assert sorted(got.get(q, [])) == sorted(expected), q


def test_indicator_regex_agrees_with_python(spark):
    import random
    import re
    from loglens.functions.indicators import DETECTORS
    rng = random.Random(3)
    alphabet = list("aeiouxs=';-<>/%3CDEFimgorp ") + ["exec ", "select", "%27", "%3D", "%3E", "<img ", "sp_"]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 12))) for _ in range(3000)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    from loglens.functions.indicators import matches
    cols = [matches(F.col("t"), p).alias(n) for n, p, _ in DETECTORS]
    got = {r.i: tuple(r[n] for n, _, _ in DETECTORS) for r in df.select("i", *cols).collect()}
    for i, t in enumerate(texts):
        exp = tuple(bool(re.compile(p, re.IGNORECASE).search(t)) for _, p, _ in DETECTORS)
        assert got[i] == exp, t


def test_share_rounding_and_zero_totals(spark):
    df = spark.createDataFrame([(1, 3), (0, 0), (2, 0), (1, 199)], "part long, total long")
    got = [r.s for r in df.select(suspicion.share(F.col("part"), F.col("total")).alias("s")).collect()]
    assert got == [33.33, 0.0, 0.0, 0.5]


def test_page_diff_bounds_exclusive(spark):
    last = 1_700_000_000
    week = 604_800
    rows = [(1, "c", last, 0, 0, "/newest", "", 3),
            (2, "c", last - 10, 0, 0, "/cur", "", 3),
            (3, "c", last - week, 0, 0, "/edge", "", 3),              # exactly one week: in neither
            (4, "c", last - week - 10, 0, 0, "/prev", "", 3),
            (5, "c", last - 2 * week + 5, 0, 0, "/cur", "", 3)]
    w = _web(spark, rows)
    new = {r.page for r in web_reports.new_pages(w).collect()}
    gone = {r.page for r in web_reports.gone_pages(w).collect()}
    assert new == set() and gone == {"/prev"}
    (tot,) = web_reports.page_week_totals(w).collect()
    assert (tot.current_total, tot.previous_total) == (1, 2)


def test_top_k_uses_partial_group_limit(spark):
    df = spark.range(10_000).select((F.col("id") % 3).alias("datasource_id"), F.col("id").alias("v"))
    out = top_k(df, 5, [F.col("v").desc()])
    assert out.count() == 15
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_prefilters_keep_unicode_case_folding(spark):
    """Texts that only match through Unicode case folding still match."""
    import re

    from loglens.functions.indicators import DETECTORS, matches
    texts = ["ſelect x", "unıon all", "İNSERT", "EXEC  sp_who", "id=1 UNION SELECT", "nothing here", "éxec sp"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = df.select(*[matches(F.col("t"), p).alias(n) for n, p, _ in DETECTORS]).collect()
    for t, row in zip(texts, got):
        assert tuple(row) == tuple(bool(re.search(p, t, re.IGNORECASE)) for _, p, _ in DETECTORS), t


def test_page_changes_join_path_equals_literal_path(spark):
    from conftest import SF_SMALL
    from loglens.plans.stand_in import web_data
    w = web_data(spark, SF_SMALL)
    newest = {r.datasource_id: r.last_time for r in web_reports.latest_time(w).collect()}
    literal = sorted(tuple(r) for r in web_reports.page_changes(w, newest).collect())
    totals = sorted(tuple(r) for r in web_reports.page_week_totals(w, newest).collect())
    assert sorted(tuple(r) for r in web_reports.page_changes(w).collect()) == literal
    assert sorted(tuple(r) for r in web_reports.page_week_totals(w).collect()) == totals
    assert literal
