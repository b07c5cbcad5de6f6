import numpy as np
from pyspark.sql import functions as F

from loglens.llm import ann


def brute(rows, every=50, k=5):
    ok = [(i, np.array(v, float)) for i, v in rows if v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    out = {}
    for at, (i, q) in enumerate(ok):
        if i is None or i % every:
            continue
        scored = sorted(((-float((q * v).sum() / (np.sqrt((v * v).sum()) * np.sqrt((q * q).sum()))), j if j is not None else 10**18) for b, (j, v) in enumerate(ok) if b != at))
        out.setdefault(i, []).append([(j, -s) for s, j in scored[:k]])
    return out


def test_recall_and_scores_on_given_vectors(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    want = brute([(r.vec_id, r.embedding) for r in df.collect()])
    for options in ({}, {"code_block": 90, "query_block": 3}):
        got = ann.nearest_neighbours(df.withColumn("rid", F.lit(0)), **options).collect()
        assert len(got) == 5 * len(want)
        hits = 0
        for q, (near,) in want.items():
            mine = sorted((r.rank, r.vec_id, r.score) for r in got if r.query_id == q)
            assert [m[0] for m in mine] == [1, 2, 3, 4, 5]
            assert all(a[2] >= b[2] for a, b in zip(mine, mine[1:]))
            exact = dict(near)
            hits += sum(m[1] in exact for m in mine)
            assert all(abs(exact[m[1]] - m[2]) < 1e-12 for m in mine if m[1] in exact)
        assert hits >= 0.95 * 5 * len(want)


def test_edges(spark):
    inf, nan = float("inf"), float("nan")
    rows = [(0, [1.0, 0.0, 0.0]), (50, [1.0, 0.0, 0.0]), (1, [2.0, 0.0, 0.0]), (2, [1e-300, 1e-300, 0.0]), (3, None), (4, []), (5, [0.0, 0.0, 0.0]), (6, [nan, 1.0, 1.0]),
            (7, [inf, 1.0, 1.0]), (8, [None, 1.0, 1.0]), (9, [1.0, 2.0]), (None, [0.0, 1.0, 0.0]), (100, None)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted(map(tuple, ann.nearest_neighbours(df).select("query_id", "rank", "vec_id").collect()), key=repr)
    assert got == [(0, 1, 1), (0, 2, 50), (0, 3, 2), (0, 4, None), (50, 1, 0), (50, 2, 1), (50, 3, 2), (50, 4, None)]
    assert ann.nearest_neighbours(df.limit(0)).count() == 0
    twice = ann.nearest_neighbours(df.filter("vec_id in (0, 1)").unionAll(df.filter("vec_id = 0"))).collect()
    assert sorted((r.query_id, r.vec_id) for r in twice) == [(0, 0), (0, 0), (0, 1), (0, 1)]


def test_bounds_hold_for_most(spark):
    rng = np.random.default_rng(2)
    x = rng.standard_normal((2000, 60))
    turn = ann.rotation(60)
    assert np.allclose(turn @ turn.T, np.eye(60))
    code, c = ann.encode(x, turn)
    signs = np.unpackbits(code, axis=1) * 2.0 - 1
    q = ann.unit(x[:50])
    estimate = (q @ turn) @ signs.T / np.sqrt(turn.shape[1]) / c
    error = np.abs(estimate - q @ ann.unit(x).T)
    assert np.mean(error <= ann.EPSILON * np.sqrt((1 - c ** 2) / c ** 2 / (turn.shape[1] - 1))) > 0.98


def clustered(n, dims=24, clusters=40, seed=3):
    rng = np.random.default_rng(seed)
    centers = rng.standard_normal((clusters, dims))
    return centers[rng.integers(0, clusters, n)] + 0.25 * rng.standard_normal((n, dims))


def frame(spark, x):
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")


def recall(got, want):
    mine = {}
    for r in got:
        mine.setdefault(r.query_id, set()).add(r.vec_id)
    return np.mean([len(mine.get(q, set()) & {i for i, _ in near}) / len(near) for q, (near,) in want.items()])


def test_recall_in_lists(spark):
    for x in (clustered(3000), np.random.default_rng(5).standard_normal((3000, 24))):      # with clusters, and without any
        df = frame(spark, x)
        index = ann.build_index(df, list_size=40)
        assert len(index.lists) >= 64 and index.lists.probes <= len(index.lists)
        got = ann.search(index, index.rows.filter("id % 50 = 0"), code_block=30, query_block=2).collect()
        want = brute([(i, v.tolist()) for i, v in enumerate(x)])
        assert len(got) == 5 * len(want) and recall(got, want) >= 0.9


def test_clustered_vectors_meet_few_lists_and_work_grows_with_rows(spark):
    sent = []
    for n in (3000, 6000):
        index = ann.build_index(frame(spark, clustered(n)), list_size=40)
        assert index.lists.probes < len(index.lists) / 4
        sent.append(ann.blocks(index, index.rows.filter("id % 50 = 0"), index.lists.probes).count())
    assert sent[1] <= 2.6 * sent[0]


def test_copies_are_not_paired(spark):
    x = clustered(900)
    x[300:600] = x[0]
    df = frame(spark, x)
    index = ann.build_index(df, list_size=40)
    held = ann.blocks(index, index.rows.filter("id % 50 = 0"), index.lists.probes).filter("not is_query")
    assert held.select("rid").distinct().count() <= 600 + 6
    got = {}
    for r in ann.search(index, index.rows.filter("id % 50 = 0")).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id))
    assert [i for _, i in sorted(got[0])] == [300, 301, 302, 303, 304]
    assert [i for _, i in sorted(got[350])] == [0, 300, 301, 302, 303] and [i for _, i in sorted(got[300])] == [0, 301, 302, 303, 304]


def test_queries_whose_lists_hold_too_few_meet_all(spark):
    x = np.concatenate([clustered(600, clusters=2), -3 * np.eye(24)[:1]])
    x[600], x[0] = x[0].copy(), x[600].copy()        # row 0 is alone
    index = ann.build_index(frame(spark, x), list_size=10)
    index.lists.probes = 1
    got = ann.search(index, index.rows.filter("id % 50 = 0")).groupBy("query_id").count().collect()
    assert len(got) == 13 and all(r["count"] == 5 for r in got)
