import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

SF_SMALL = "/root/testdata/sf0.001"
SF_MID = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from loglens.session import build_session
    # tests look for their folders in plans, which cut long paths
    s = build_session("local[4]", app_name="loglens-tests", shuffle_partitions=8, conf={"spark.sql.maxMetadataStringLength": "1000"})
    yield s
    s.stop()


@pytest.fixture(scope="session")
def registry(spark):
    from loglens.plans.registry import seed_registry
    return seed_registry(spark)
