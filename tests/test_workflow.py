"""The tool's workflow end to end: log files per source -> import -> store -> beacons -> reports."""
from pyspark.sql import functions as F

from conftest import SF_SMALL
from loglens.operators import beacon, indicators, suspicion
from loglens.plans import stand_in as si
from loglens.plans.store import LogStore
from loglens.sources.ingest import read_source_file

COLS = ["clientip", "destip", "time", "bytesIn", "bytesOut", "bytesDiff", "direction", "contentType", "page", "datasource_id"]


def test_import_files_then_generate_and_report(spark, registry, tmp_path):
    lines = si.proxy_lines(spark, SF_SMALL)
    types = {1: "bluecoat", 2: "squid"}
    store = LogStore(spark, str(tmp_path / "store"))
    store.create_tables()
    for ds, log_type in types.items():
        folder = str(tmp_path / f"logs-{ds}")
        lines.filter(F.col("datasource_id") == ds).select("line").write.text(folder)
        store.append("proxy_data", read_source_file(spark, folder, ds, log_type), new_ids=True)
    imported = store.read("proxy_data")
    expected = si.proxy_data(spark, SF_SMALL)
    assert imported.select(COLS).exceptAll(expected.select(COLS)).count() == 0
    assert imported.count() == expected.count()
    assert imported.select("id").distinct().count() == imported.count()      # ids are unique

    store.replace_sources("beacon_data", beacon.beacon_scores(imported, registry[1]), [1, 2])
    stored = {tuple(r) for r in store.read("beacon_data").collect()}
    direct = {tuple(r) for r in beacon.beacon_scores(expected, registry[1]).collect()}
    assert stored == direct and stored

    web = si.web_data(spark, SF_SMALL)
    store.append("web_data", web)
    store.replace_sources("xss_data", indicators.indicator_rows(store.read("web_data")), [3, 4, 5])
    index = suspicion.web_suspicion(store.read("web_data"), store.read("xss_data"), limit=10).collect()
    assert len(index) == 10
    assert [r.suspicionScore for r in index] == sorted((r.suspicionScore for r in index), reverse=True)
