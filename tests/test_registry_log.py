"""The stored registry and the blocks of ids: nothing is lost, nothing is given twice."""
from concurrent.futures import ThreadPoolExecutor

import pytest

from loglens.plans import claims
from loglens.plans.registry import add_collection, add_datasource, seed_registry
from loglens.plans.store import SLAB_BITS, LogStore


def test_a_file_is_created_once_by_one_of_many(spark, tmp_path):
    path = f"file:{tmp_path}/folder/name"
    with ThreadPoolExecutor(16) as pool:
        won = list(pool.map(lambda k: claims.create_once(spark, path, f"writer {k}".encode()), range(16)))
    assert won.count(True) == 1
    assert (tmp_path / "folder" / "name").read_text() == f"writer {won.index(True)}"
    assert claims.names(spark, f"{tmp_path}/folder") == ["name"]      # no drafts are left
    assert claims.names(spark, f"{tmp_path}/nowhere") == []


def test_eight_imports_at_once_get_eight_blocks(spark, tmp_path):
    def reserve(_):
        return LogStore(spark, str(tmp_path / "ids")).reserve_ids("proxy_data")
    with ThreadPoolExecutor(8) as pool:
        first = list(pool.map(reserve, range(8)))
        second = list(pool.map(reserve, range(8)))
    assert len(set(first + second)) == 16
    assert sorted(first + second) == [k << SLAB_BITS for k in range(16)]


def test_eight_writers_add_eight_collections(spark, tmp_path):
    store = LogStore(spark, str(tmp_path / "reg"))
    store.write_registry(*seed_registry(spark))

    def add(k):
        mine = LogStore(spark, str(tmp_path / "reg"))
        return mine.add_collection(f"case {k}"), mine.add_datasource(f"log {k}", "squid", 1)
    with ThreadPoolExecutor(8) as pool:
        ids = list(pool.map(add, range(8)))
    assert sorted(c for c, _ in ids) == list(range(3, 11)) and sorted(d for _, d in ids) == list(range(6, 14))
    stored = {r.id: r.name for r in store.read("collections").collect()}
    assert len(stored) == 10 and all(stored[c] == f"case {k}" for k, (c, _) in enumerate(ids))


def test_a_stored_registry_grows_by_rows_derived_from_itself(spark, tmp_path):
    store = LogStore(spark, str(tmp_path / "grow"))
    store.create_tables()
    assert store.read("collections").count() == 0
    store.write_registry(*seed_registry(spark))
    for k in range(3):
        store.write_registry(add_collection(store.read("collections"), f"n{k}"), add_datasource(store.read("datasources"), f"d{k}", "iis", 1))
    assert sorted(r.id for r in store.read("collections").collect()) == [1, 2, 3, 4, 5]
    assert sorted(r.id for r in store.read("datasources").collect()) == list(range(1, 9))
    # a changed row is a next version; rows that are not written again stay
    from pyspark.sql import functions as F
    changed = store.read("collections").filter("id = 2").withColumn("description", F.lit(None).cast("string"))
    store.write_registry(changed, store.read("datasources").limit(0))
    rows = {r.id: (r.name, r.description) for r in store.read("collections").collect()}
    assert rows[2] == ("empty", None) and len(rows) == 5 and store.read("datasources").count() == 8
    with pytest.raises(ValueError, match="unknown log type"):
        store.add_datasource("x", "syslog", 1)
