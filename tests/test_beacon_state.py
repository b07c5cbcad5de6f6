"""Beacon statistics that are merged import by import equal one run over all rows."""
import random

import pytest

from loglens.operators import beacon
from loglens.operators.beacon_state import BeaconState, merge_slices, slices_of_rows
from loglens.schemas import PROXY_DATA


@pytest.fixture(scope="module")
def proxy(spark):
    """Pairs whose seconds repeat and interleave over imports; one pair with a third of the rows; odd values."""
    rng = random.Random(4)
    rows = []
    for i in range(900):
        client, dest = ("10.0.0.1", "hot") if i % 3 == 0 else (f"10.0.0.{rng.randint(2, 6)}", rng.choice(["a", "b", None]))
        time = rng.choice([None, -7, 10**15]) if i % 50 == 7 else 1_700_000_000 + rng.randint(0, 20_000)
        rows.append((i, client, dest, time, 1, 1, rng.choice([0, 9, None, 2**62]), "", rng.choice([0, 1, None]), "/", rng.choice([1, 2])))
    return spark.createDataFrame(rows, PROXY_DATA)


def _sorted(df):
    return sorted(map(repr, df.collect()))


def test_imports_in_any_order_equal_one_run(spark, proxy, registry, tmp_path):
    want = _sorted(beacon.beacon_scores(proxy, registry[1]))
    for order in ([0, 1, 2, 3], [3, 1, 0, 2]):
        state = BeaconState(spark, str(tmp_path / f"s{order[0]}"))
        for k in order:
            state.add(proxy.filter(proxy.id % 4 == k))
            if k == 1:
                assert state.compact() in (True, False)
        state.add(proxy.limit(0))
        assert _sorted(state.scores(registry[1])) == want
        assert state.compact() and _sorted(state.scores(registry[1])) == want
    assert len(want) > 10


def test_an_import_reads_only_its_own_rows(spark, proxy, tmp_path):
    old, new = str(tmp_path / "old"), str(tmp_path / "new")
    proxy.filter("id % 2 = 0").write.parquet(old)
    proxy.filter("id % 2 = 1").write.parquet(new)
    state = BeaconState(spark, str(tmp_path / "state"))
    state.add(spark.read.schema(PROXY_DATA).parquet(old))
    (tmp_path / "old").rename(tmp_path / "away")            # the second import and scoring do without the old rows
    state.add(spark.read.schema(PROXY_DATA).parquet(new))
    assert state.slices().agg({"n": "sum"}).first()[0] == proxy.filter("time is not null").count()


def test_failed_imports_and_second_compactions_do_not_count(spark, proxy, tmp_path):
    from pyspark.sql import functions as F
    state = BeaconState(spark, str(tmp_path / "state"))
    assert state.slices().count() == 0 and not state.compact()
    state.add(proxy)
    with pytest.raises(Exception, match="boom"):
        state.add(proxy.withColumn("bytesDiff", F.raise_error(F.lit("boom")).cast("bigint")))
    total = state.slices().agg({"n": "sum"}).first()[0]
    assert total == proxy.filter("time is not null").count()
    state.add(proxy)
    old, swaps = state._holding()
    name = state._write(merge_slices(state._read(old)))     # another compaction, not logged yet
    assert state.compact()
    assert not state._log(f"swap-{swaps:06d}", "\n".join([name, *old]))
    assert state.slices().agg({"n": "sum"}).first()[0] == 2 * total


def test_slices_merge_to_the_same_figures(spark, proxy):
    from loglens.operators.beacon_state import slice_figures
    halves = slices_of_rows(proxy.filter("id < 400")).unionByName(slices_of_rows(proxy.filter("id >= 400")))
    got = slice_figures(merge_slices(halves))
    want = beacon.slice_stats(proxy)
    assert _sorted(got.select(*sorted(got.columns))) == _sorted(want.select(*sorted(want.columns)))


def test_scoring_over_the_index_shuffles_no_pair(spark, proxy, registry, tmp_path):
    from loglens.operators.beacon import scores_of_pairs
    from loglens.operators.beacon_state import pair_stats_of_state
    state = BeaconState(spark, str(tmp_path / "state"))
    state.add(proxy)
    stats = pair_stats_of_state(spark.table(state.index(4)))
    plan = stats._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Bucketed: true" in plan
    assert _sorted(scores_of_pairs(stats, registry[1])) == _sorted(beacon.beacon_scores(proxy, registry[1]))
