import random
import re
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from loglens.llm import mixing


def brute_targets(sizes, total):
    """Raise a common level until the capped shares come to the total."""
    w = [(3, 1, 2)[i % 3] for i in range(len(sizes))]
    lo, hi = 0.0, total + 1
    for _ in range(200):
        mid = (lo + hi) / 2
        if sum(min(2 * s, mid * x) for s, x in zip(sizes, w)) < total:
            lo = mid
        else:
            hi = mid
    return [min(2 * s, hi * x) for s, x in zip(sizes, w)]


def check(out, rows):
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    by = defaultdict(int)
    for r in rows:
        by[r[3]] += size(r[1])
    names = sorted(by, key=lambda s: (s is None, s or ""))
    want = dict(zip(names, brute_targets([by[s] for s in names], 1.5 * sum(by.values()))))
    assert sorted((repr(r.doc_id), r.size) for r in out) == sorted((repr(r[0]), size(r[1])) for r in rows)
    got, parts = defaultdict(int), defaultdict(int)
    for r in out:
        assert r.copies * r.size <= r.taken <= min(2 * r.size, (r.copies + 1) * r.size)
        assert r.source_size == by[r.source] and r.target == pytest.approx(want[r.source], rel=1e-6, abs=1e-6)
        got[r.source] += r.taken
        parts[r.source] += r.taken != r.copies * r.size
    for s in names:
        assert abs(got[s] - want[s]) <= 2 and parts[s] <= 1, (s, got[s], want[s])


def test_edge_documents(spark, edge_docs, schema):
    rows = edge_docs + edge_docs[:3] + [(None, "a b c d", None, None, 1), (888, "", "en", "zero", 0)]
    docs = spark.createDataFrame(rows, schema).withColumn("size", F.lit("x")).withColumn("h", F.lit(1)).repartition(3)
    out = mixing.mix(docs).collect()
    check(out, rows)
    again = mixing.mix(docs.repartition(5)).collect()
    assert sorted(map(repr, out)) == sorted(map(repr, again))
    whole = mixing.with_copies(docs)
    assert whole.columns[:len(docs.columns)] == docs.columns and whole.count() == len(rows)


def test_hot_source_and_equal_sizes(spark, schema):
    rng = random.Random(3)
    rows = [(i, "w " * (7 if i % 3 == 0 else rng.randint(1, 300)), "en", f"s{0 if i % 2 else rng.randint(0, 9)}", 1) for i in range(1200)]
    check(mixing.mix(spark.createDataFrame(rows, schema)).collect(), rows)


def test_rates_solve_the_dual(spark):
    rng = np.random.default_rng(0)
    sizes = rng.integers(1, 2000, 400)
    cells = spark.createDataFrame([(0, int(s), 1) for s in sizes], "src int, size long, n long").groupBy("src", "size").agg(F.sum("n").alias("n"))
    for part in (0.01, 0.3, 0.999, 1.0, 1.5, 1.9, 1.9999):
        target = part * sizes.sum()
        l = mixing.solve_rates(spark, cells, [int(sizes.sum())], [target])[0]
        assert np.minimum(2, np.exp(np.minimum(l * sizes, 1))) @ sizes == pytest.approx(target, rel=1e-5)


def test_empty(spark, schema):
    assert mixing.mix(spark.createDataFrame([], schema)).count() == 0
    out = mixing.mix(spark.createDataFrame([(1, None, None, None, None), (2, " ", "en", "a", 1)], schema)).collect()
    assert [(r.target, r.taken) for r in out] == [(0, 0), (0, 0)]


def test_rows_of_the_driver_start_no_workers(spark, schema, tmp_path):
    """Rows given as Python objects are unpacked by Python workers on the executors: an RDD in the plan."""
    rows = [(i % 50, "a b c " * (i % 5 + 1), "en", f"s{i % 3}" if i % 4 else None, 1) for i in range(60)]
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/docs")
    out = mixing.with_copies(spark.read.parquet(f"{tmp_path}/docs"))
    plan = out._jdf.queryExecution().toString()
    assert "LogicalRDD" not in plan and "ExistingRDD" not in plan
    check(out.collect(), rows)
