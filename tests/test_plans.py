"""Plan shapes that the design relies on at scale (checked with explain, not timing)."""
import pytest

from conftest import SF_SMALL
from loglens.operators import beacon, enrich, explore, proxy_reports, suspicion, web_reports
from loglens.plans import stand_in as si
from loglens.plans.store import LogStore


def _formatted(df):
    return df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    store = LogStore(spark, str(tmp_path_factory.mktemp("plans")))
    store.append("proxy_data", si.proxy_data(spark, SF_SMALL))
    store.append("web_data", si.web_data(spark, SF_SMALL))
    return store.read("proxy_data"), store.read("web_data")


def test_top_k_limits_before_the_shuffle(stored):
    _, web = stored
    plan = _formatted(web_reports.web_top(web, "clientip", "total", 20))
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_beacon_aggregates_map_side_and_reads_few_columns(stored, registry):
    proxy, _ = stored
    plan = _formatted(beacon.beacon_scores(proxy, registry[1]))
    assert "HashAggregate" in plan and "partial_count" in plan and "collect_set" not in plan
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert "ReadSchema: struct<clientip:string,destip:string,time:bigint,bytesDiff:bigint,contentType:int>" in plan


def test_page_changes_push_time_bounds_to_the_scan(stored):
    _, web = stored
    newest = {r.datasource_id: r.last_time for r in web_reports.latest_time(web).collect()}
    assert sorted(web_reports.page_changes(web, newest).collect()) == sorted(web_reports.page_changes(web).collect())
    plan = _formatted(web_reports.page_changes(web, newest))
    assert "PushedFilters: [Or(" in plan and "GreaterThan(time," in plan and "LessThan(time," in plan


def test_ip_report_pushes_address_filter(stored):
    proxy, _ = stored
    plan = _formatted(explore.ip_hourly(proxy, "203.0.113.3", "proxy"))
    assert "EqualTo(clientip,203.0.113.3)" in plan and "EqualTo(destip,203.0.113.3)" in plan


def test_reports_prune_columns_and_partitions(stored, registry):
    proxy, _ = stored
    plan = _formatted(proxy_reports.bluecoat_summary(proxy, registry[1]))
    assert "ReadSchema: struct<clientip:string,destip:string,bytesIn:bigint,bytesOut:bigint>" in plan
    assert "dynamicpruning" in plan.lower()


def test_building_a_report_runs_no_job(spark, stored, registry):
    proxy, web = stored
    blocks, names = si.geo_blocks(spark, SF_SMALL), si.host_names(spark, SF_SMALL)
    beacons = beacon.beacon_scores(proxy, registry[1])
    tracker = spark.sparkContext.statusTracker()
    group = "no-jobs"
    spark.sparkContext.setJobGroup(group, "building only")
    try:
        proxy_reports.top_clients_by_bytes(proxy, registry[1], "in")
        proxy_reports.bluecoat_summary(proxy, registry[1])
        web_reports.new_pages(web)
        web_reports.page_changes(web)
        web_reports.traffic_summary(web)
        beacon.beacon_scores(proxy, registry[1])
        suspicion.proxy_suspicion(proxy, beacons)
        enrich.map_feed(proxy, blocks, "proxy", names=names)
        enrich.resolve_names(web, "clientip", names)
        assert list(tracker.getJobIdsForGroup(group)) == []
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_suspicion_reads_the_rows_once(spark, tmp_path):
    """Clients and sources are rolled up from one scan and one shuffle of the rows."""
    import re

    from loglens.operators import suspicion
    from loglens.schemas import BEACON_DATA, PROXY_DATA, WEB_DATA, XSS_DATA
    web = [(k, f"10.0.0.{k % 7}", k, k, 1, f"/{k % 5}", "", 3 + k % 2) for k in range(200)]
    proxy = [(k, f"10.0.0.{k % 7}", f"h{k % 5}", k, k, 1, 0, "", 0, "/", 1 + k % 2) for k in range(200)]
    for name, rows, schema in (("web", web, WEB_DATA), ("proxy", proxy, PROXY_DATA), ("xss", [("10.0.0.1", "q", "xss", "xss", 3)], XSS_DATA),
                               ("beacons", [("10.0.0.1", "h1", 1.0, 1.0, 3, 4, 4, 1)], BEACON_DATA)):
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}")
    read = lambda name: spark.read.parquet(f"{tmp_path}/{name}")
    for facts, report in (("web", suspicion.web_suspicion(read("web"), read("xss"))), ("proxy", suspicion.proxy_suspicion(read("proxy"), read("beacons")))):
        report.collect()
        plan = report._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
        assert len(re.findall(rf"FileScan parquet .*{tmp_path}/{facts}", plan)) == 1 and "ReusedExchange" in plan
