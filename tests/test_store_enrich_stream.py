"""Sinks (K1-K5, K7, D18), geo range join (J9) vs nested loop, names (J10), streaming import."""
import os
import time

import pytest

from pyspark.sql import functions as F

from loglens.operators.enrich import locate, resolve_names
from loglens.plans.store import LogStore
from loglens.schemas import BEACON_DATA, GEO_BLOCKS, HOST_NAMES


def test_replace_source_with_empty_result_clears_it(spark, tmp_path):
    store = LogStore(spark, str(tmp_path / "store"))
    store.create_tables()
    rows = [("10.0.0.1", "a", 10.0, 0.1, 5, 4, 4, 1), ("10.0.0.2", "b", 20.0, 0.2, 6, 3, 3, 2)]
    store.replace_source("beacon_data", 1, spark.createDataFrame(rows, BEACON_DATA))
    store.replace_source("beacon_data", 2, spark.createDataFrame(rows, BEACON_DATA))
    assert store.read("beacon_data").count() == 2
    store.replace_source("beacon_data", 1, spark.createDataFrame([], BEACON_DATA))
    assert [r.datasource_id for r in store.read("beacon_data").collect()] == [2]
    assert store.read("beacon_data", 2).count() == 1
    store.create_tables()                                          # IF NOT EXISTS: keeps data
    assert store.read("beacon_data").count() == 1
    only_1 = spark.createDataFrame(rows[:1], BEACON_DATA)
    store.replace_sources("beacon_data", only_1, [1, 2])           # source 2 has no new rows -> emptied
    assert [(r.clientip, r.datasource_id) for r in store.read("beacon_data").collect()] == [("10.0.0.1", 1)]


def test_geo_lookup_equals_nested_loop(spark):
    import random
    rng = random.Random(5)
    blocks, start = [], 0x0A000000
    for k in range(300):
        size = rng.choice([1, 16, 300, 70_000, 200_000])
        blocks.append((start, start + size - 1, float(k), -float(k), f"C{k}", "R", "X"))
        start += size + rng.choice([0, 0, 5])
    addrs = [".".join(str((n >> s) & 255) for s in (24, 16, 8, 0))
             for n in (rng.randint(0x0A000000, start + 10) for _ in range(3000))] + ["not-an-ip", "999.1.1.1"]
    b = spark.createDataFrame(blocks, GEO_BLOCKS)
    a = spark.createDataFrame([(x,) for x in addrs], "address string")
    got = sorted((r.address, r.country) for r in locate(a, "address", b).collect())
    def num(x):
        p = x.split(".")
        return int(p[0]) << 24 | int(p[1]) << 16 | int(p[2]) << 8 | int(p[3])
    exp = sorted((x, blk[4]) for x in addrs if x.count(".") == 3 and all(p.isdigit() and int(p) < 256 for p in x.split("."))
                 for blk in blocks if blk[0] <= num(x) <= blk[1])
    assert got == exp
    assert "NestedLoop" not in locate(a, "address", b)._jdf.queryExecution().executedPlan().toString()


def test_names_default_unresolvable(spark):
    names = spark.createDataFrame([("1.2.3.4", "host.example.org")], HOST_NAMES)
    df = spark.createDataFrame([("1.2.3.4",), ("5.6.7.8",)], "ip string")
    got = {r.ip: r.name for r in resolve_names(df, "ip", names).collect()}
    assert got == {"1.2.3.4": "host.example.org", "5.6.7.8": "unresolvable"}


def test_streaming_import(spark, tmp_path):
    from loglens.streaming.ingest import start_import
    src = tmp_path / "incoming"
    src.mkdir()
    (src / "a.log").write_text(
        "1700000000.750 12 10.0.0.5 TCP_MISS/200 512 GET http://x.example.com/a - DIRECT/1.2.3.4 text/html\n"
        "#Fields: junk\n"
        "1700000060.000 12 10.0.0.5 TCP_MISS/200 100 GET http://x.example.com/b - DIRECT/1.2.3.4 image/gif\n")
    out = str(tmp_path / "proxy_stream")
    q = start_import(spark, str(src), "squid", 2, out, checkpoint=str(tmp_path / "ckpt"))
    q.awaitTermination(120)
    rows = spark.read.parquet(out).orderBy("time").collect()
    assert [(r.destip, r.time, r.bytesIn, r.datasource_id) for r in rows] == [
        ("x.example.com", 1700000000, 512, 2), ("x.example.com", 1700000060, 100, 2)]


def test_registry_add_and_persist(spark, tmp_path, registry):
    from loglens.plans.registry import add_collection, add_datasource, collections_nested, sources_with_collection
    coll, ds = registry
    coll = add_collection(coll, "case-7", "New case")
    ds = add_datasource(ds, "fw", "squid", 3)
    store = LogStore(spark, str(tmp_path / "reg"))
    store.write_registry(coll, ds)
    c2 = spark.read.parquet(store.path("collections"))
    d2 = spark.read.parquet(store.path("datasources"))
    assert sorted(r.id for r in c2.collect()) == [1, 2, 3]
    assert {(r.datasource_name, r.collection_name) for r in sources_with_collection(d2, c2).collect()} >= {("fw", "case-7")}
    nested = {r.name: [x.name for x in r.datasources] for r in collections_nested(c2, d2).collect()}
    assert nested["empty"] == [] and nested["case-7"] == ["fw"]


def test_map_feed_locates_host_names_through_names(spark):
    from loglens.operators.enrich import map_feed
    from loglens.schemas import PROXY_DATA
    rows = [(1, "10.0.0.1", "files.example.org", 100, 5000, 0, 5000, "in", 0, "/", 1),
            (2, "10.0.0.1", "203.0.113.9", 100, 10, 0, 10, "in", 0, "/", 1),
            (3, "10.0.0.1", "10.1.1.1", 100, 99999, 0, 99999, "in", 0, "/", 1)]
    proxy = spark.createDataFrame(rows, PROXY_DATA)
    blocks = spark.createDataFrame([((203 << 24) + (0 << 16) + (113 << 8), (203 << 24) + (0 << 16) + (113 << 8) + 255,
                                     1.0, 2.0, "X", "R", "C")], GEO_BLOCKS)
    names = spark.createDataFrame([("203.0.113.50", "files.example.org")], HOST_NAMES)
    plain = {r.address for r in map_feed(proxy, blocks, "proxy").collect()}
    named = {r.address: r.totalBytes for r in map_feed(proxy, blocks, "proxy", names=names).collect()}
    assert plain == {"203.0.113.9"}                              # private 10.x excluded, host name not located
    assert named == {"203.0.113.9": 10, "files.example.org": 5000}


PROXY_ROW = ("10.0.0.1", "h", 1000, 1, 0, 1, "", 0, "/", 2)


def _rows(spark, n=10):
    return spark.createDataFrame([PROXY_ROW] * n, "clientip string, destip string, time long, bytesIn long, bytesOut long, bytesDiff long, "
                                 "direction string, contentType int, page string, datasource_id int").repartition(3)


def test_ids_stay_unique_after_failed_and_interrupted_imports(spark, tmp_path):
    store = LogStore(spark, str(tmp_path / "ids"))
    store.append("proxy_data", _rows(spark), new_ids=True)
    store.reserve_ids("proxy_data")                                # an import that ended before its write
    store.append("proxy_data", _rows(spark), new_ids=True)
    bad = _rows(spark).withColumn("page", F.raise_error(F.lit("boom")).cast("string"))
    with pytest.raises(Exception, match="boom"):
        store.append("proxy_data", bad, new_ids=True)
    LogStore(spark, str(tmp_path / "ids")).append("proxy_data", _rows(spark), new_ids=True)
    ids = [r.id for r in store.read("proxy_data").collect()]
    assert len(ids) == 30 and len(set(ids)) == 30
    blocks = {store.reserve_ids("proxy_data") for _ in range(3)}
    assert len(blocks) == 3 and min(blocks) > max(ids)


def test_new_ids_follow_given_ids(spark, tmp_path):
    store = LogStore(spark, str(tmp_path / "given"))
    store.append("proxy_data", _rows(spark).withColumn("id", F.lit(1 << 50) + F.monotonically_increasing_id()))
    store.append("proxy_data", _rows(spark), new_ids=True)
    ids = [r.id for r in store.read("proxy_data").collect()]
    assert len(set(ids)) == 20


def test_replace_keeps_old_rows_when_the_new_result_fails(spark, tmp_path):
    store = LogStore(spark, str(tmp_path / "replace"))
    rows = [("10.0.0.1", "a", 10.0, 0.1, 5, 4, 4, 1), ("10.0.0.2", "b", 20.0, 0.2, 6, 3, 3, 2)]
    store.replace_sources("beacon_data", spark.createDataFrame(rows, BEACON_DATA), [1, 2])
    bad = spark.createDataFrame(rows, BEACON_DATA).withColumn("destip", F.raise_error(F.lit("boom")).cast("string"))
    for replace in (lambda: store.replace_sources("beacon_data", bad, [1, 2]), lambda: store.replace_source("beacon_data", 1, bad)):
        with pytest.raises(Exception, match="boom"):
            replace()
        assert store.read("beacon_data").count() == 2
    # a result that reads the table it replaces
    store.replace_sources("beacon_data", store.read("beacon_data").withColumn("count", F.col("count") + 1), [1, 2])
    assert sorted((r.datasource_id, r["count"]) for r in store.read("beacon_data").collect()) == [(1, 6), (2, 7)]


def test_session_needs_a_shared_folder_outside_one_machine(monkeypatch):
    from loglens import session
    assert session._local_folder("a", "local[4]") == session._local_folder("a", "local[4]")
    for master in ("yarn", "spark://h:7077", "local-cluster[2,1,1024]", "k8s://x", ""):
        with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
            session._local_folder("b", master)


def test_build_session_sets_partitions_only_when_given(monkeypatch):
    from loglens import session
    seen = {}

    class Builder:
        def appName(self, name): return self
        def master(self, name): return self
        def config(self, key, value): seen[key] = value; return self
        def getOrCreate(self): raise KeyboardInterrupt
    monkeypatch.setattr(session.SparkSession, "builder", Builder())
    for given, kept in ((None, None), (96, "96")):
        seen.clear()
        with pytest.raises(KeyboardInterrupt):
            session.build_session(master=None, shuffle_partitions=given)
        assert seen.get("spark.sql.shuffle.partitions") == kept
