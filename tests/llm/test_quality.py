import numpy as np
import pytest
from pyspark.sql import functions as F

from loglens.llm import quality as q

SF = "/root/testdata/sf0.1"


def test_held_out_accuracy(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    known = labels.filter("doc_id % 2 = 0")
    out = q.classify(docs, known).join(labels.filter("doc_id % 2 = 1").select("doc_id", F.col("quality").alias("good"), F.col("toxic").alias("bad")), "doc_id").collect()
    assert len(out) > 1000
    assert np.mean([(r.quality >= 0.5) == (r.good == 1) for r in out]) > 0.95
    assert np.mean([r.toxic >= 0.5 for r in out if r.bad == 1]) > 0.8
    assert np.mean([r.keep for r in out if r.good == 1 and r.bad == 0]) > 0.97


def test_posteriors_against_plain_python(spark):
    docs = spark.createDataFrame([(i, f"w{i}", f"h{i % 7 % 3}", ["a", "b", None][i % 5 % 3]) for i in range(60)], "doc_id long, text string, source string, lang string")
    seen = {i: (float((i * 7) % 10 < 3 + i % 3), float(i % 4 == 0)) for i in range(0, 60, 2)}
    labels = spark.createDataFrame([(i, *v) for i, v in seen.items()], "doc_id long, quality double, toxic double")
    model = np.zeros((2, q.N_FEATURES + 1))
    model[:, -1] = (0.4, -1.0)
    out = {r.doc_id: r for r in q.score(docs.withColumn("host", F.lit(1)).withColumn("n", F.lit(1)), labels, model).collect()}
    rows = [(r.doc_id, r.source, r.lang) for r in docs.collect()]
    for k, name in enumerate(q.LABELS):
        own = 1 / (1 + np.exp(-model[k, -1]))
        y = {i: seen[i][k] if i in seen else own for i, _, _ in rows}
        mean = sum(y.values()) / 60

        def strength(groups):   # (n, k, parent)
            n = sum(g[0] for g in groups)
            within = sum(g[0] * g[2] * (1 - g[2]) for g in groups) / n
            spread = sum(g[0] * (g[1] / g[0] - g[2]) ** 2 for g in groups) - sum(g[2] * (1 - g[2]) for g in groups)
            share = max(0, spread / (n - sum(g[0] ** 2 for g in groups) / n)) / within
            return min(1e6, max(1, 1 / share - 1)) if share > 0 else 1e6
        host = {h: (sum(1 for r in rows if r[1] == h), sum(y[r[0]] for r in rows if r[1] == h)) for h in {r[1] for r in rows}}
        a = strength([(n, s, mean) for n, s in host.values()])
        theta = {h: (s + a * mean) / (n + a) for h, (n, s) in host.items()}
        path = {p: (sum(1 for r in rows if r[1:] == p), sum(y[r[0]] for r in rows if r[1:] == p)) for p in {r[1:] for r in rows}}
        b = strength([(n, s, theta[p[0]]) for p, (n, s) in path.items()])
        logit = lambda p: np.log(p / (1 - p))
        for i, h, p in rows:
            n, s = path[h, p]
            assert out[i][f"{name}_host"] == pytest.approx(theta[h]) and out[i][f"{name}_path"] == pytest.approx((s + b * theta[h]) / (n + b))
            rest = (s - y[i] + b * theta[h]) / (n - 1 + b)
            assert out[i][name] == pytest.approx(1 / (1 + np.exp(-(model[k, -1] - logit(mean) + logit(rest)))), rel=1e-5)


def test_edges(spark, edge_docs, schema):
    docs = spark.createDataFrame(edge_docs + edge_docs[:2] + [(None, None, None, None, None)], schema).withColumn("id", F.lit("x")).withColumn("quality", F.lit(1))
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert q.classify(docs, none).count() == len(edge_docs) + 3
    labels = spark.createDataFrame([(0, 1, 0), (0, 0, None), (1, None, 1), (2, 0, 0), (3, 1, 0), (None, 1, 1), (99999, 1, 1)], "doc_id long, quality int, toxic int")
    out = q.classify(docs, labels).collect()
    assert len(out) == len(edge_docs) + 3 and all(0 <= r.quality <= 1 and 0 <= r.toxic <= 1 for r in out)
    assert q.classify(docs.limit(0), labels).count() == 0
