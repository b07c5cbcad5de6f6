"""Stored tables in Spark's catalog: partitions, last versions, statistics and what the planner does with them."""
import pytest

from conftest import SF_SMALL
from loglens.plans import stand_in as si
from loglens.plans.registry import seed_registry
from loglens.plans.store import LogStore
from loglens.operators.indicators import indicator_rows


@pytest.fixture(scope="module")
def database(spark, tmp_path_factory):
    store = LogStore(spark, str(tmp_path_factory.mktemp("catalog")))
    store.write_registry(*seed_registry(spark))
    store.append("web_data", si.web_data(spark, SF_SMALL))
    store.replace_sources("xss_data", indicator_rows(store.read("web_data")), [3, 4, 5])
    store.register_tables("catalog_test")
    return store


def _optimized(df):
    return df._jdf.queryExecution().optimizedPlan()


def test_tables_have_rows_partitions_and_statistics(spark, database):
    web = spark.table("catalog_test.web_data")
    assert web.count() == database.read("web_data").count() > 100
    stats = _optimized(web).stats()
    assert stats.rowCount().get() == web.count() and stats.attributeStats().size() > 5
    plan = web.filter("datasource_id = 4")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(datasource_id" in plan
    assert spark.table("catalog_test.proxy_data").count() == 0


def test_registry_views_show_what_is_added_later(spark, database):
    new = database.add_collection("later")
    spark.catalog.refreshTable("catalog_test.collections_log")
    assert new in {r.id for r in spark.table("catalog_test.collections").collect()}


def test_joins_are_ordered_by_the_statistics(spark, database):
    sql = ("SELECT count(*) FROM catalog_test.web_data a JOIN catalog_test.web_data b ON a.clientip = b.clientip "
           "JOIN catalog_test.xss_data x ON x.clientip = a.clientip AND x.detector = 'exec'")
    def first_joined(enabled):
        for key in ("spark.sql.cbo.enabled", "spark.sql.cbo.joinReorder.enabled"):
            spark.conf.set(key, enabled)
        lines = [l for l in _optimized(spark.sql(sql)).toString().splitlines() if "Relation" in l]
        return ["xss_data" in l for l in lines]
    try:
        written, ordered = first_joined("false"), first_joined("true")
    finally:
        for key in ("spark.sql.cbo.enabled", "spark.sql.cbo.joinReorder.enabled"):
            spark.conf.set(key, "true")
    assert written == [False, False, True]          # as the statement has it
    assert ordered.index(True) < 2                  # the few indicators are joined before the rows meet themselves
    assert spark.sql(sql).count() == 1
