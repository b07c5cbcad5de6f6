"""Distributed gap statistics and scores equal a per-pair numpy loop."""
import random

import numpy as np
from pyspark.sql import functions as F

from test_functions import starts_with_address
from loglens.operators.beacon import beacon_listing, beacon_scores, pair_stats
from loglens.schemas import PROXY_DATA


def brute_force(rows, types):
    """The scoring rules written as a plain loop over each pair's sorted times."""
    pairs, dest_count = {}, {}
    for r in rows:
        pairs.setdefault((r["datasource_id"], r["clientip"], r["destip"]), []).append(r)
        k = (r["datasource_id"], r["destip"])
        dest_count[k] = dest_count.get(k, 0) + 1
    out = {}
    for (ds, c, d), evs in pairs.items():
        evs.sort(key=lambda e: e["time"])
        times = np.array([e["time"] for e in evs])
        if len(times) < 2:
            continue
        gaps = np.diff(times)
        std, mean = round(gaps.std(), 3), round(gaps.mean(), 2)
        if not mean > 0:
            continue
        n = len(evs)
        content = sum(e["contentType"] for e in evs)
        b = sum(e["bytesDiff"] for e in evs)
        # regularity, then what is asked for, then how much of it
        score = (2 if std < 0.5 else 1 if std < 1 else 0) + (1 if mean > 900 else 0)
        score += (2 if starts_with_address(d) else 0) + (0 if dest_count[(ds, d)] >= 5 else 1)
        score += (1 if content / n * 100 > 50 else 0) + (1 if b / n * 100 > (500 if types[ds] == "bluecoat" else 5000) else 0)
        score += -3 if n <= 3 else 0
        out[(ds, c, d)] = (float(mean), float(std), n, max(score, 0), score)
    return out


def _fixture(spark):
    rng = random.Random(11)
    rows, i = [], 0
    def add(ds, c, d, t, b=10, html=0):
        nonlocal i
        i += 1
        rows.append(dict(id=i, clientip=c, destip=d, time=t, bytesIn=b, bytesOut=0, bytesDiff=b, direction="",
                         contentType=html, page="/", datasource_id=ds))
    # a hot pair: regular 300 s cadence with jitter over ~40 days (many slices), duplicates included
    t = 1_700_000_000
    for k in range(12_000):
        t += 300 + rng.choice([0, 0, 1, -1])
        add(1, "10.0.0.1", "198.51.100.9", t, b=rng.randint(0, 20), html=1)
        if k % 50 == 0:
            add(1, "10.0.0.1", "198.51.100.9", t)                  # duplicate time -> zero gap
    for c in range(40):                                            # many small pairs, random gaps
        for k in range(rng.randint(1, 30)):
            add(rng.choice([1, 2]), f"10.0.1.{c}", rng.choice(["a.example.com", "203.0.113.5", "b.example.com"]),
                1_700_000_000 + rng.randint(0, 500_000), b=rng.randint(0, 9000), html=rng.randint(0, 1))
    for k in range(3):                                             # all at one instant: mean 0 -> dropped (D10)
        add(2, "10.0.2.1", "c.example.com", 1_700_000_000)
    return rows, spark.createDataFrame([tuple(r[f] for f in PROXY_DATA.fieldNames()) for r in rows], PROXY_DATA)


def test_scores_equal_brute_force(spark, registry):
    rows, df = _fixture(spark)
    expected = brute_force(rows, {1: "bluecoat", 2: "squid"})
    got = {(r.datasource_id, r.clientip, r.destip): (r.mean, r.stdDev, r["count"], r.beaconScore, r.raw_score)
           for r in beacon_scores(df, registry[1], slice_seconds=3600).collect()}
    assert got == expected
    assert expected[(1, "10.0.0.1", "198.51.100.9")][3] >= 2


def test_slice_width_does_not_change_results(spark, registry):
    _, df = _fixture(spark)
    a = {tuple(r) for r in pair_stats(df, 60).select("clientip", "destip", "n", F.round("mean_raw", 9), F.round("std_raw", 9)).collect()}
    b = {tuple(r) for r in pair_stats(df, 86_400 * 7).select("clientip", "destip", "n", F.round("mean_raw", 9), F.round("std_raw", 9)).collect()}
    assert a == b


def test_listing_threshold_and_labels(spark, registry):
    _, df = _fixture(spark)
    listing = beacon_listing(beacon_scores(df, registry[1]), min_score=3).collect()
    assert all(r.beaconScore >= 3 for r in listing)
    assert all(r.probability == ("High" if r.beaconScore >= 6 else "Medium") for r in listing)
    scores = [(-r.beaconScore, r.stdDev) for r in listing]
    assert scores == sorted(scores)


def test_hot_pair_is_not_one_window_partition(spark, registry):
    """The per-pair window sees one row per non-empty slice, not one per request."""
    _, df = _fixture(spark)
    from loglens.operators.beacon import slice_stats
    hot = slice_stats(df, 3600).filter(F.col("clientip") == "10.0.0.1")
    assert hot.count() > 500
    assert hot.agg(F.max("n")).first()[0] <= 13


def test_stray_timestamp_does_not_overflow(spark, registry):
    """A single far-away time (decades off) squares beyond 64 bits; results stay exact."""
    rows = [dict(id=k, clientip="10.0.0.1", destip="h.example.com", time=1_700_000_000 + 60 * k, bytesIn=1, bytesOut=0,
                 bytesDiff=1, direction="", contentType=0, page="/", datasource_id=2) for k in range(10)]
    rows.append(dict(rows[0], id=99, time=5_000_000_000))        # year 2128
    df = spark.createDataFrame([tuple(r[f] for f in PROXY_DATA.fieldNames()) for r in rows], PROXY_DATA)
    expected = brute_force(rows, {1: "bluecoat", 2: "squid"})
    got = {(r.datasource_id, r.clientip, r.destip): (r.mean, r.stdDev, r["count"], r.beaconScore, r.raw_score)
           for r in beacon_scores(df, registry[1]).collect()}
    assert got == expected


def test_random_pairs_any_slice_width(spark, registry):
    """300 random pairs (spans from minutes to months, many duplicate times) under three
    slice widths: every width gives the brute-force scores."""
    rng = random.Random(23)
    rows = []
    for p in range(300):
        n = rng.randint(1, 40)
        span = rng.choice([120, 7200, 86_400 * 3, 86_400 * 60])
        base = 1_700_000_000 + rng.randint(0, 10_000)
        times = [base + rng.randint(0, span) for _ in range(n)]
        if rng.random() < 0.3:
            times += times[: rng.randint(1, len(times))]           # duplicate timestamps
        for k, t in enumerate(times):
            rows.append(dict(id=len(rows), clientip=f"10.2.{p % 7}.{p}", destip=rng.choice(["x.example.com", "198.51.100.3"]),
                             time=t, bytesIn=0, bytesOut=0, bytesDiff=rng.randint(0, 200), direction="",
                             contentType=rng.randint(0, 1), page="/", datasource_id=rng.choice([1, 2])))
    df = spark.createDataFrame([tuple(r[f] for f in PROXY_DATA.fieldNames()) for r in rows], PROXY_DATA).cache()
    expected = brute_force(rows, {1: "bluecoat", 2: "squid"})
    for width in (60, 3600, 86_400 * 30):
        got = {(r.datasource_id, r.clientip, r.destip): (r.mean, r.stdDev, r["count"], r.beaconScore, r.raw_score)
               for r in beacon_scores(df, registry[1], slice_seconds=width).collect()}
        assert got == expected, width


def test_destinations_of_any_case(spark, registry):
    rows = [(1, 1, "c", name, t, 1, 0, 1, "out", 0, "/") for t, name in enumerate(["Host.Example", "host.example", "HOST.EXAMPLE", None, "other"] * 4)]
    df = spark.createDataFrame(rows, "id bigint, datasource_id int, clientip string, destip string, time bigint, bytesIn bigint, bytesOut bigint, bytesDiff bigint, direction string, contentType int, page string")
    apart = {(r.destip, r["count"]) for r in beacon_scores(df, registry[1]).collect()}
    assert {("Host.Example", 4), ("host.example", 4), ("HOST.EXAMPLE", 4)} <= apart
    together = {r.destip: (r["count"], r.mean) for r in beacon_scores(df, registry[1], fold_case=True).collect()}
    assert together["host.example"] == (12, round(17 / 11, 2)) and together["other"] == (4, 5.0)
    assert not {"Host.Example", "HOST.EXAMPLE"} & set(together)
