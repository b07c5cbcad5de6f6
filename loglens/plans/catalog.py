"""Registered queries: one callable ``(spark, sf_dir) -> DataFrame`` per operator.

Every query reads the driver's tables through the stand-in views (or data Spark
derives from them) and runs the library's own code over the whole input.
"""
from __future__ import annotations

import re
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import beacon, beacon_state, enrich, explore, indicators, page_days, page_index, proxy_reports, suspicion, web_reports
from ..functions.ip import is_public, is_strict_ip, looks_like_ip
from ..functions.urls import url_host, url_path, url_query
from ..session import scratch_path
from ..sources.ingest import attach_types, parse_lines, reject_counts
from ..sources.text import read_log_lines
from ..sources.tokens import shell_tokens
from . import stand_in as si
from .free_sql import resolve_query
from .registry import add_collection, add_datasource, collections_nested, seed_registry, sources_with_collection
from .store import LogStore, write_names_csv

PROXY_OUT = ["datasource_id", "clientip", "destip", "time", "bytesIn", "bytesOut", "bytesDiff",
             "direction", "contentType", "page"]
WEB_OUT = ["datasource_id", "clientip", "time", "bytesIn", "bytesOut", "page", "query"]

# Fixed query parameters (an address, a search word) chosen to occur in the stand-in data.
REPORT_IP_PROXY = "203.0.113.3"
REPORT_IP_WEB = "198.51.0.7"
SEARCH_WORD = "purchase"
SEARCH_WORD_WEB = "/en/1"
FREE_SQL = """
    SELECT x.clientip, c.name AS collection
    FROM xss_data x JOIN datasources d ON d.id = x.datasource_id JOIN collections c ON c.id = d.collection_id
    WHERE x.clientip IN (SELECT clientip FROM web_data WHERE bytesOut > 100)
    UNION
    SELECT b.clientip, 'beacons' FROM beacon_data b JOIN proxy_data p ON p.clientip = b.clientip AND p.datasource_id = b.datasource_id
    WHERE b.beaconScore >= 6 AND p.direction = 'in'"""


def _registry(spark):
    return seed_registry(spark)


def _proxy(spark, sf):
    return si.proxy_data(spark, sf)


def _web(spark, sf):
    return si.web_data(spark, sf)


def _beacons(spark, sf):
    _, ds = _registry(spark)
    return beacon.beacon_scores(_proxy(spark, sf), ds)


def _xss(spark, sf):
    return indicators.indicator_rows(_web(spark, sf))


def _typed(lines: DataFrame, spark) -> DataFrame:
    _, ds = _registry(spark)
    return attach_types(lines, ds)


# ---------------------------------------------------------------- sources
def s1_text_scan_proxy(spark, sf):
    """S1 + S10: render proxy lines to text files (one folder per source), scan them
    back as Latin-1 text and parse each with its source's format."""
    path = scratch_path(spark, "proxy-lines")
    si.proxy_lines(spark, sf).select("datasource_id", "line").write.partitionBy("datasource_id").text(path)
    lines = read_log_lines(spark, path)
    return parse_lines(_typed(lines, spark), "proxy").select(*PROXY_OUT)


def s3_tokenize_documents(spark, sf):
    """S3 over whole document texts, line by line: lines, lines with balanced quoting, tokens."""
    docs = si.table(spark, sf, "documents").select("doc_id", "text")
    lines = docs.select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    toks = lines.select("doc_id", shell_tokens(F.col("line")).alias("t"))
    return toks.groupBy("doc_id").agg(F.count(F.lit(1)).alias("lines"),
                                      F.count("t").alias("valid_lines"),
                                      F.sum(F.size("t")).alias("tokens_raw")) \
               .select("doc_id", "lines", "valid_lines",
                       F.coalesce(F.col("tokens_raw"), F.lit(0)).cast("bigint").alias("tokens"))


def _parse_one_format(spark, sf, render, kind, log_type, source="proxy"):
    base = _proxy(spark, sf) if source == "proxy" else _web(spark, sf)
    lines = base.select("datasource_id", render(base).alias("line"))
    return parse_lines(lines, kind, log_type).select(*(PROXY_OUT if kind == "proxy" else WEB_OUT))


def s4_parse_squid(spark, sf):
    return _parse_one_format(spark, sf, si.squid_line, "proxy", "squid")


def s5_parse_bluecoat_a(spark, sf):
    return _parse_one_format(spark, sf, si.bluecoat_a_line, "proxy", "bluecoat")


def s6_parse_bluecoat_b(spark, sf):
    return _parse_one_format(spark, sf, si.bluecoat_b_line, "proxy", "bluecoat")


def s7_parse_apache(spark, sf):
    return _parse_one_format(spark, sf, si.apache_line, "web", "apache", "web")


def s8_parse_iis(spark, sf):
    return _parse_one_format(spark, sf, si.iis_line, "web", "iis", "web")


def s9_parse_iis_short(spark, sf):
    return _parse_one_format(spark, sf, si.iis_short_line, "web", "iis-short", "web")


def s10_dispatch_web(spark, sf):
    """Web lines of sources 3/4/5, each parsed by its registry type."""
    return parse_lines(_typed(si.web_lines(spark, sf), spark), "web").select(*WEB_OUT)


def s11_reject_counts(spark, sf):
    """Lines that gave no row, per kind, source and reason."""
    web = reject_counts(_typed(si.damaged_web_lines(spark, sf), spark), "web")
    proxy = reject_counts(_typed(si.damaged_proxy_lines(spark, sf), spark), "proxy")
    return web.withColumn("kind", F.lit("web")).unionByName(proxy.withColumn("kind", F.lit("proxy")))


def s11_reject_indicators(spark, sf):
    """S11 + D36: one job imports attack lines; the detectors run over those that gave no row."""
    store = LogStore(spark, scratch_path(spark, "import"))
    store.import_lines(si.attack_lines(spark, sf), "web")
    stored = store.read("web_data").groupBy("datasource_id").agg(F.count(F.lit(1)).alias("lines")) \
        .select("datasource_id", F.lit("stored").alias("reason"), F.lit("").alias("xsstype"), F.lit("").alias("detector"), "lines")
    return indicators.reject_indicators(store.read("rejects")).groupBy("datasource_id", "reason", "xsstype", "detector") \
        .agg(F.count(F.lit(1)).alias("lines")).unionByName(stored)


def s4_numbers_proxy(spark, sf):
    """M2 + T1: proxy lines over long, negative, blank-like and suffixed numbers and times."""
    lines = si.number_lines(spark, sf).filter(F.col("type").isin("squid", "bluecoat"))
    return parse_lines(lines, "proxy").groupBy("datasource_id", "time", "bytesIn", "bytesOut", "bytesDiff", "direction") \
        .agg(F.count(F.lit(1)).alias("lines"))


def s7_numbers_web(spark, sf):
    """M2: web lines over the same numbers."""
    lines = si.number_lines(spark, sf).filter(F.col("type") == "apache")
    return parse_lines(lines, "web").groupBy("datasource_id", "time", "bytesIn", "bytesOut").agg(F.count(F.lit(1)).alias("lines"))


def s12_partition_scan(spark, sf):
    """S12 + F1: store proxy rows partitioned by source, read back one source (pruned)."""
    store = LogStore(spark, scratch_path(spark, "store"))
    store.append("proxy_data", _proxy(spark, sf))
    return store.read("proxy_data", 2).select("id", *PROXY_OUT)


# ---------------------------------------------------------------- sinks
def k1_create_tables(spark, sf):
    """K1 (+K2, K3): create all tables, append proxy and web rows, report row counts."""
    store = LogStore(spark, scratch_path(spark, "store"))
    store.create_tables()
    store.append("proxy_data", _proxy(spark, sf))
    store.append("web_data", _web(spark, sf))
    counts = [store.read(t).agg(F.count(F.lit(1)).alias("rows")).select(F.lit(t).alias("table_name"), "rows")
              for t in ("proxy_data", "web_data", "beacon_data", "xss_data")]
    out = counts[0]
    for c in counts[1:]:
        out = out.unionByName(c)
    return out


def k2_append_proxy(spark, sf):
    store = LogStore(spark, scratch_path(spark, "store"))
    store.append("proxy_data", _proxy(spark, sf))
    return store.read("proxy_data").select("id", *PROXY_OUT)


def k3_append_web(spark, sf):
    store = LogStore(spark, scratch_path(spark, "store"))
    store.append("web_data", _web(spark, sf))
    return store.read("web_data").select("id", *WEB_OUT)


def k4_replace_beacons(spark, sf):
    """K4: replace the proxy sources' beacon rows (one source first, then both, twice: no doubling)."""
    store = LogStore(spark, scratch_path(spark, "store"))
    b = _beacons(spark, sf)
    store.replace_source("beacon_data", 1, b)
    for _ in range(2):
        store.replace_sources("beacon_data", b, [1, 2])
    return store.read("beacon_data")


def k5_replace_indicators(spark, sf):
    """K5: stale rows are first put into source 3, then all web sources' indicator rows
    are replaced in one job: the stale rows are gone, nothing is appended twice."""
    store = LogStore(spark, scratch_path(spark, "store"))
    x = _xss(spark, sf)
    store.replace_source("xss_data", 3, x.filter(F.col("datasource_id") == 4).withColumn("datasource_id", F.lit(3)))
    store.replace_sources("xss_data", x, [3, 4, 5])
    return store.read("xss_data")


def k6_registry_add(spark, sf):
    """K6 + J1: add a collection and a data source, list sources with collection and rows."""
    coll, ds = _registry(spark)
    coll = add_collection(coll, "later", "Added later")
    ds = add_datasource(ds, "sq2", "squid", 3)
    listing = sources_with_collection(ds, coll)
    rows = _proxy(spark, sf).select("datasource_id").unionByName(_web(spark, sf).select("datasource_id")) \
        .groupBy("datasource_id").agg(F.count(F.lit(1)).alias("rows"))
    return listing.join(rows, "datasource_id", "left").fillna(0, ["rows"])


def k6_registry_store(spark, sf):
    """K6: a stored registry grows, by name and by rows derived from what it holds, and is read back."""
    store = LogStore(spark, scratch_path(spark, "registry"))
    store.write_registry(*_registry(spark))
    later = store.add_collection("later", "Added later")
    store.add_datasource("sq2", "squid", later)
    store.write_registry(add_collection(store.read("collections"), "more"),
                         add_datasource(store.read("datasources"), "ap2", "apache", later + 1))
    rows = _proxy(spark, sf).select("datasource_id").unionByName(_web(spark, sf).select("datasource_id")) \
        .groupBy("datasource_id").agg(F.count(F.lit(1)).alias("rows"))
    return sources_with_collection(store.read("datasources"), store.read("collections")) \
        .join(rows, "datasource_id", "left").fillna(0, ["rows"])


def k7_names_csv(spark, sf):
    """K7 + J10: web clients resolved to names, written as ``key,name`` CSV and read back."""
    clients = _web(spark, sf).select("clientip").distinct()
    resolved = enrich.resolve_names(clients, "clientip", si.host_names(spark, sf))
    path = scratch_path(spark, "names")
    write_names_csv(resolved, path, "clientip")
    return spark.read.schema("key string, name string").csv(path)


def k8_beacon_projection(spark, sf):
    return beacon.beacon_projection(_proxy(spark, sf), 1)


# ---------------------------------------------------------------- predicates
def k8_beacon_index(spark, sf):
    """K8: scores over the bucketed index of the beacon state."""
    state = beacon_state.BeaconState(spark, scratch_path(spark, "beacon-index"))
    state.add(_proxy(spark, sf))
    slices = spark.table(state.index(buckets=8))
    return beacon.scores_of_pairs(beacon_state.pair_stats_of_state(slices), _registry(spark)[1])


def f4_ip_literal_dests(spark, sf):
    """F4 (prefix-anchored) and F5 (strict) address tests over distinct destinations."""
    d = _proxy(spark, sf).select("datasource_id", "destip").distinct()
    return d.select("datasource_id", "destip", looks_like_ip(F.col("destip")).alias("ip_prefix"),
                    is_strict_ip(F.col("destip")).alias("ip_strict"))


def f7_public_addresses(spark, sf):
    """distinct proxy destinations and web clients outside the excluded private ranges."""
    d = _proxy(spark, sf).select("datasource_id", F.col("destip").alias("address"))
    c = _web(spark, sf).select("datasource_id", F.col("clientip").alias("address"))
    return d.unionByName(c).filter(is_public(F.col("address"))).distinct()


def f22_kilobytes_top_clients(spark, sf):
    """F22 over A11: top web clients by total bytes, in kB."""
    t = web_reports.web_top(_web(spark, sf), "clientip", "total", 20)
    return t.select("datasource_id", "clientip", explore.kilobytes("totalBytes").alias("kB"))


# ---------------------------------------------------------------- joins
def j2_collections_nested(spark, sf):
    """Collections with their data sources (empty ones kept) and stored rows."""
    coll, ds = _registry(spark)
    rows = _proxy(spark, sf).select("datasource_id").unionByName(_web(spark, sf).select("datasource_id")) \
        .groupBy("datasource_id").agg(F.count(F.lit(1)).alias("rows"))
    nested = collections_nested(coll, ds)
    per_coll = ds.join(rows, ds.id == rows.datasource_id, "inner").groupBy("collection_id").agg(F.sum("rows").alias("rows"))
    out = nested.join(per_coll, nested.id == per_coll.collection_id, "left")
    return out.select(F.col("id").alias("collection_id"), F.col("name").alias("collection_name"),
                      F.size("datasources").cast("bigint").alias("sources"),
                      F.array_join(F.transform("datasources", lambda d: d["name"]), ",").alias("source_names"),
                      F.coalesce(F.col("rows"), F.lit(0)).cast("bigint").alias("rows"))


def j7_destination_counts(spark, sf):
    """Requests per destination and source."""
    return beacon.destination_counts(_proxy(spark, sf))


def j9_geo_locate(spark, sf):
    """Distinct web clients and proxy destinations located by range lookup."""
    a = _web(spark, sf).select(F.col("clientip").alias("address")).unionByName(
        _proxy(spark, sf).select(F.col("destip").alias("address"))).distinct()
    return enrich.locate(a, "address", si.geo_blocks(spark, sf))


def j9_nested_blocks(spark, sf):
    """The same addresses among blocks that nest, overlap and repeat: one row an address."""
    a = _web(spark, sf).select(F.col("clientip").alias("address")).unionByName(
        _proxy(spark, sf).select(F.col("destip").alias("address"))).distinct()
    return enrich.locate(a, "address", si.nested_blocks(spark, sf))


# ---------------------------------------------------------------- aggregates
def a1_bluecoat_detail(spark, sf):
    return proxy_reports.bluecoat_detail(_proxy(spark, sf), _registry(spark)[1])


def a2_bluecoat_summary(spark, sf):
    return proxy_reports.bluecoat_summary(_proxy(spark, sf), _registry(spark)[1])


def a3_squid_detail(spark, sf):
    return proxy_reports.squid_detail(_proxy(spark, sf), _registry(spark)[1])


def a4_squid_summary(spark, sf):
    return proxy_reports.squid_summary(_proxy(spark, sf), _registry(spark)[1])


def a5_pair_statistics(spark, sf):
    """A5 + W1: gap count, mean and deviation per pair (numpy rounding), all pairs."""
    p = beacon.pair_stats(_proxy(spark, sf))
    return p.select("datasource_id", "clientip", "destip", "n", "content_sum", "bytes_sum",
                    beacon.numpy_round(F.col("mean_raw"), 2).alias("mean"),
                    beacon.numpy_round(F.col("std_raw"), 3).alias("stdDev"))


def a7_beacon_scores(spark, sf):
    return _beacons(spark, sf)


def a7_scores_any_case(spark, sf):
    """Destinations logged in either case, scored as one."""
    proxy = _proxy(spark, sf)
    mixed = proxy.withColumn("destip", F.when(F.col("id") % 2 == 1, F.upper("destip")).otherwise(F.col("destip")))
    return beacon.beacon_scores(mixed, _registry(spark)[1], fold_case=True)


def a7_scores_after_imports(spark, sf):
    """A5 + A7 kept up to date: three imports, a compaction after the second, scored from the state."""
    state = beacon_state.BeaconState(spark, scratch_path(spark, "beacon-state"))
    proxy = _proxy(spark, sf)
    for k in range(3):
        state.add(proxy.filter(F.col("id") % 3 == k))
        if k == 1:
            state.compact()
    return state.scores(_registry(spark)[1])


def a8_a10_traffic_summary(spark, sf):
    return web_reports.traffic_summary(_web(spark, sf))


def a11_top_clients_total(spark, sf):
    return web_reports.web_top(_web(spark, sf), "clientip", "total", 20)


def a12_top_clients_pages(spark, sf):
    return web_reports.web_top(_web(spark, sf), "clientip", "pages", 40)


def a12_top_pages_of_client(spark, sf):
    return web_reports.web_top(_web(spark, sf), "page", "pages", 40, client=REPORT_IP_WEB)


def a13_top_pages_total(spark, sf):
    return web_reports.web_top(_web(spark, sf), "page", "total", 20)


def a14_top_clients_bytes_in(spark, sf):
    return proxy_reports.top_clients_by_bytes(_proxy(spark, sf), _registry(spark)[1], "in")


def a15_top_clients_bytes_out(spark, sf):
    return proxy_reports.top_clients_by_bytes(_proxy(spark, sf), _registry(spark)[1], "out")


def a16_top_clients_bytes_total(spark, sf):
    return proxy_reports.top_clients_by_bytes(_proxy(spark, sf), _registry(spark)[1], "total")


def a17_top_clients_hosts(spark, sf):
    return proxy_reports.top_clients_by_hosts(_proxy(spark, sf), _registry(spark)[1])


def a18_web_byte_leaders(spark, sf):
    """Four parametrisations of one top-k (pages/clients by bytes in/out)."""
    return web_reports.byte_leaders(_web(spark, sf))


def a19_beacon_listing(spark, sf):
    return beacon.beacon_listing(_beacons(spark, sf), min_score=3)


def a19_beacon_listing_for_ip(spark, sf):
    return beacon.beacon_listing(_beacons(spark, sf), ip=REPORT_IP_PROXY)


def a19_listing_after_import(spark, sf):
    """The whole workflow: proxy lines parsed by their source's format, appended to the
    store with new ids, beacons scored from the stored columns, listed (score >= 3)."""
    _, ds = _registry(spark)
    store = LogStore(spark, scratch_path(spark, "import"))
    store.append("proxy_data", parse_lines(_typed(si.proxy_lines(spark, sf), spark), "proxy"), new_ids=True)
    return beacon.beacon_listing(beacon.beacon_scores(store.read("proxy_data"), ds), min_score=3)


def a19_beacon_listing_all_labels(spark, sf):
    """A19 at the dashboard's threshold 2 (D15): Low rows are listed too."""
    return beacon.beacon_listing(_beacons(spark, sf), min_score=2)


def a20_ip_hourly_proxy(spark, sf):
    return explore.ip_hourly(_proxy(spark, sf), REPORT_IP_PROXY, "proxy")


def a20_ip_hourly_web(spark, sf):
    return explore.ip_hourly(_web(spark, sf), REPORT_IP_WEB, "web")


def a21_ip_top_destinations(spark, sf):
    return explore.ip_top_targets(_proxy(spark, sf), REPORT_IP_PROXY, "proxy")


def a21_ip_top_pages(spark, sf):
    return explore.ip_top_targets(_web(spark, sf), REPORT_IP_WEB, "web")


def a22_indicator_listing(spark, sf):
    return indicators.indicator_listing(_xss(spark, sf))


def a22_indicators_of_client(spark, sf):
    """A22 for one client of one source."""
    return indicators.indicator_listing(_xss(spark, sf), datasource_id=4, client=REPORT_IP_WEB)


def a23_page_search_proxy(spark, sf):
    return explore.page_search(_proxy(spark, sf), SEARCH_WORD, "proxy")


def a23_page_search_web(spark, sf):
    return explore.page_search(_web(spark, sf), SEARCH_WORD_WEB, "web")


def _searched(spark, facts, kind, word):
    """A23 from the index of two imports."""
    index = page_index.PageIndex(spark, scratch_path(spark, f"page-index-{kind}"), kind, parts=8)
    for k in range(2):
        index.add(facts.filter(F.col("id") % 2 == k))
    return index.search(word)


def a23_indexed_search_proxy(spark, sf):
    return _searched(spark, _proxy(spark, sf), "proxy", SEARCH_WORD)


def a23_indexed_search_web(spark, sf):
    return _searched(spark, _web(spark, sf), "web", SEARCH_WORD_WEB)


def a24_web_baseline(spark, sf):
    return suspicion.web_baseline(_web(spark, sf), _xss(spark, sf))


def a25_proxy_baseline(spark, sf):
    return suspicion.proxy_baseline(_proxy(spark, sf), _beacons(spark, sf))


def a26_web_suspicion(spark, sf):
    return suspicion.web_suspicion(_web(spark, sf), _xss(spark, sf))


def a27_proxy_suspicion(spark, sf):
    return suspicion.proxy_suspicion(_proxy(spark, sf), _beacons(spark, sf))


def a28_map_feed_proxy(spark, sf):
    return enrich.map_feed(_proxy(spark, sf), si.geo_blocks(spark, sf), "proxy")


def a28_map_feed_web(spark, sf):
    return enrich.map_feed(_web(spark, sf), si.geo_blocks(spark, sf), "web")


def a28_map_feed_names(spark, sf):
    """A28 with host-name destinations located through their names' addresses."""
    return enrich.map_feed(_proxy(spark, sf), si.geo_blocks(spark, sf), "proxy", names=si.destination_names(spark, sf))


def a28_map_one_address(spark, sf):
    """A28 for one chosen address, among the destinations that occur."""
    chosen = _proxy(spark, sf).filter(F.col("destip") == REPORT_IP_PROXY).select(F.col("destip").alias("address"))
    return enrich.address_location(chosen, si.geo_blocks(spark, sf))


def a29_latest_time(spark, sf):
    return web_reports.latest_time(_web(spark, sf))


# ---------------------------------------------------------------- windows, sets
def p1_week_totals(spark, sf):
    return web_reports.page_week_totals(_web(spark, sf))


def p2_new_pages(spark, sf):
    return web_reports.new_pages(_web(spark, sf))


def p3_gone_pages(spark, sf):
    return web_reports.gone_pages(_web(spark, sf))


def p2_p3_page_changes(spark, sf):
    return web_reports.page_changes(_web(spark, sf))


def _page_days(spark, sf):
    """Pages by day after two imports."""
    days, web = page_days.PageDays(spark, scratch_path(spark, "page-days")), _web(spark, sf)
    for k in range(2):
        days.add(web.filter(F.col("id") % 2 == k))
    return days


def a29_latest_from_footers(spark, sf):
    return _page_days(spark, sf).latest_time()


def p1_week_totals_by_day(spark, sf):
    return web_reports.totals_of_weeks(_page_days(spark, sf).weeks())


def p2_p3_page_changes_by_day(spark, sf):
    return web_reports.changes_of_weeks(_page_days(spark, sf).weeks())


def p4_indicator_rows(spark, sf):
    return _xss(spark, sf)


def r1_document_indicators(spark, sf):
    """F17-F20 over whole document texts: texts scanned and texts hit per detector."""
    docs = si.table(spark, sf, "documents").select("doc_id", "text")
    return indicators.detector_counts(docs, "text")


def r1_page_indicators(spark, sf):
    """F17-F20 over whole raw web pages (``pages.html``): pages scanned and pages hit per detector."""
    pages = si.table(spark, sf, "pages").select("page_id", "html")
    return indicators.detector_counts(pages, "html")


# ---------------------------------------------------------------- scalars, free SQL
def u1_url_parts(spark, sf):
    """Host, path and query of every page URL."""
    p = si.table(spark, sf, "pages").select("page_id", "url")
    return p.select("page_id", url_host("url").alias("host"), url_path("url").alias("path"),
                    url_query("url").alias("query"))


def t2_hourly_requests(spark, sf):
    """Requests and bytes per UTC hour bucket and proxy source."""
    from ..functions.times import hour_bucket
    p = _proxy(spark, sf)
    return p.groupBy("datasource_id", hour_bucket(F.col("time")).alias("hour")).agg(
        F.count(F.lit(1)).alias("requests"), F.sum("bytesIn").alias("bytesIn"))


def _stored_for_sql(spark, sf):
    store = LogStore(spark, scratch_path(spark, "free-sql"))
    coll, ds = _registry(spark)
    store.write_registry(coll, ds)
    store.append("proxy_data", _proxy(spark, sf))
    store.append("web_data", _web(spark, sf))
    store.replace_sources("beacon_data", beacon.beacon_scores(store.read("proxy_data"), ds), [1, 2])
    store.replace_sources("xss_data", indicators.indicator_rows(store.read("web_data")), [3, 4, 5])
    return store


def q1_free_sql(spark, sf):
    """Q1: free SQL over all six stored tables; first column resolved to names."""
    _stored_for_sql(spark, sf).register_views()
    return resolve_query(spark, FREE_SQL, si.host_names(spark, sf))


def q1_catalog_sql(spark, sf):
    """Q1 + K1: the same over catalog tables with statistics."""
    database = f"logs_{uuid.uuid4().hex[:12]}"
    _stored_for_sql(spark, sf).register_tables(database)
    return resolve_query(spark, re.sub(r"\b(FROM|JOIN) (\w+)", rf"\1 {database}.\2", FREE_SQL), si.host_names(spark, sf))


_ALL = [
    s1_text_scan_proxy, s3_tokenize_documents, s4_parse_squid, s5_parse_bluecoat_a, s6_parse_bluecoat_b,
    s4_numbers_proxy, s7_numbers_web, s7_parse_apache, s8_parse_iis, s9_parse_iis_short, s10_dispatch_web, s11_reject_counts, s11_reject_indicators, s12_partition_scan,
    k1_create_tables, k2_append_proxy, k3_append_web, k4_replace_beacons, k5_replace_indicators,
    k6_registry_add, k6_registry_store, k7_names_csv, k8_beacon_projection, k8_beacon_index,
    f4_ip_literal_dests, f7_public_addresses, f22_kilobytes_top_clients,
    j2_collections_nested, j7_destination_counts, j9_geo_locate, j9_nested_blocks,
    a1_bluecoat_detail, a2_bluecoat_summary, a3_squid_detail, a4_squid_summary, a5_pair_statistics,
    a7_beacon_scores, a7_scores_any_case, a7_scores_after_imports, a8_a10_traffic_summary, a11_top_clients_total, a12_top_clients_pages,
    a12_top_pages_of_client, a13_top_pages_total, a14_top_clients_bytes_in, a15_top_clients_bytes_out,
    a16_top_clients_bytes_total, a17_top_clients_hosts, a18_web_byte_leaders, a19_beacon_listing,
    a19_beacon_listing_for_ip, a19_beacon_listing_all_labels, a19_listing_after_import, a20_ip_hourly_proxy, a20_ip_hourly_web, a21_ip_top_destinations,
    a21_ip_top_pages, a22_indicator_listing, a22_indicators_of_client, a23_page_search_proxy, a23_page_search_web, a23_indexed_search_proxy, a23_indexed_search_web,
    a24_web_baseline, a25_proxy_baseline, a26_web_suspicion, a27_proxy_suspicion,
    a28_map_feed_proxy, a28_map_feed_web, a28_map_feed_names, a28_map_one_address, a29_latest_time,
    p1_week_totals, p2_new_pages, p3_gone_pages, p2_p3_page_changes, a29_latest_from_footers, p1_week_totals_by_day, p2_p3_page_changes_by_day, p4_indicator_rows,
    r1_document_indicators, r1_page_indicators, u1_url_parts, t2_hourly_requests, q1_free_sql, q1_catalog_sql,
]
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {fn.__name__: fn for fn in _ALL}
