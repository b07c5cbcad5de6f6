"""One location an address, whatever the blocks: against a scan of all blocks in plain Python."""
import random

import pytest

from loglens.operators.enrich import disjoint_blocks, locate
from loglens.schemas import GEO_BLOCKS


def _ip(n):
    return ".".join(str(n >> s & 255) for s in (24, 16, 8, 0))


def _key(b):
    return (b[1] - b[0], b[0], *[(x is not None, x) for x in b[2:]])


@pytest.fixture(scope="module")
def blocks():
    rng = random.Random(6)
    base = (198 << 24) + (51 << 16)
    found = [(198 << 24, (199 << 24) - 1, 0.0, 0.0, "whole", "", ""), (base, base, 1.0, 1.0, "one", None, "x"), (base + 9, base + 3, 1.0, 1.0, "empty", "", "")]
    for k in range(250):        # nested, overlapping, touching, over the edge of a /16
        start = base + rng.choice([rng.randint(0, 400), rng.randint(65_000, 66_000), rng.randint(0, 200_000)])
        found.append((start, start + rng.choice([0, 1, 7, 63, 255, 1000, 70_000]), float(k), None, f"c{k % 7}", rng.choice([None, "r"]), "t"))
    return found + found[:20]   # equal blocks


def test_every_address_has_the_smallest_block_s_location(spark, blocks):
    rng = random.Random(7)
    base = (198 << 24) + (51 << 16)
    edges = {x + d for b in blocks for x in b[:2] for d in (-1, 0, 1)}
    numbers = sorted(edges | {base + rng.randint(0, 300_000) for _ in range(500)} | {5, (199 << 24)})
    df = spark.createDataFrame([(_ip(n),) for n in numbers], "address string")
    got = {r.address: tuple(r)[1:] for r in locate(df, "address", spark.createDataFrame(blocks, GEO_BLOCKS)).collect()}
    want = {}
    for n in numbers:
        around = [b for b in blocks if b[0] <= n <= b[1]]
        if around and n >> 24:
            want[_ip(n)] = min(around, key=_key)[2:]
    assert got == want and len(want) > 800


def test_segments_do_not_overlap_and_plans_have_no_nested_loop(spark, blocks):
    out = disjoint_blocks(spark.createDataFrame(blocks, GEO_BLOCKS))
    rows = sorted((r.start_ip, r.end_ip) for r in out.collect())
    assert all(a[1] < b[0] for a, b in zip(rows, rows[1:])) and all(a <= b for a, b in rows)
    df = spark.createDataFrame([("198.51.0.1",)], "address string")
    plan = locate(df, "address", spark.createDataFrame(blocks, GEO_BLOCKS))._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert disjoint_blocks(spark.createDataFrame([], GEO_BLOCKS)).count() == 0


def test_full_private_ranges_reach_the_map_feed(spark):
    from loglens.operators.enrich import map_feed
    from loglens.schemas import PROXY_DATA
    rows = [(k, "c", d, 1, 5, 5, 0, "", 0, "/", 1) for k, d in enumerate(["172.20.0.1", "203.0.113.9"])]
    world = spark.createDataFrame([(0, (1 << 32) - 1, 1.0, 2.0, "X", "R", "C")], GEO_BLOCKS)
    found = {full: {r.address for r in map_feed(spark.createDataFrame(rows, PROXY_DATA), world, "proxy", full_rfc1918=full).collect()} for full in (False, True)}
    assert found[True] == {"203.0.113.9"} and "203.0.113.9" in found[False]
