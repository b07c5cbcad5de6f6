"""Every registered query against its DuckDB oracle (row count, columns, values) at sf0.001."""
import os
import sys

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

from conftest import SF_SMALL  # noqa: E402


def test_all_queries_match_oracles(spark):
    from check_oracle import compare_all
    from loglens.plans.catalog import QUERIES
    results = compare_all(spark, SF_SMALL, echo=lambda m: None, names=QUERIES)
    bad = [m for _, ok, m in results if not ok]
    assert len(results) >= 60
    assert not bad, "\n".join(bad)


def test_entry_smoke(spark):
    from __spark_entry__ import entry
    df = entry(spark)
    rows = df.collect()
    assert df.columns == ["datasource_id", "clientip", "destip", "count", "mean", "stdDev", "beaconScore", "probability"]
    assert all(r.beaconScore >= 3 for r in rows)
