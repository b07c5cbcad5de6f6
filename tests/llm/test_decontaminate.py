import hashlib
import re

import numpy as np
from pyspark.sql import functions as F

from loglens.llm import decontaminate as dc
from loglens.llm.common import suffix_array

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return WORD.findall(low)


def windows(text, k=13):
    w = words(text)
    return {tuple(w[i:i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} - {()}


def brute(docs, items):
    out = []
    for doc_id, text in docs:
        w = words(text)
        hit, found = [False] * len(w), set()
        for item_id, t in items:
            for win in windows(t):
                for i in range(len(w) - len(win) + 1):
                    if tuple(w[i:i + len(win)]) == win:
                        hit[i:i + len(win)] = [True] * len(win)
                        if item_id is not None:
                            found.add(str(item_id))
        out.append((doc_id, len(w), sum(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), sum(hit) > 0 and 20 * sum(hit) >= len(w)))
    return sorted(out, key=repr)


def columns(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", dc.is_contaminated()).collect()), key=repr)


def items_of(docs):
    t = {d[0]: d[1] for d in docs}
    return [(10, t[5][:200]), (9, t[6]), (2, "one two"), (2, "one two"), (3, None), (4, ""), (None, t[7]), (5, t[8].upper().replace(" ", "--")), (11, t[5][:200])]


def test_against_brute_force(spark, edge_docs, schema):
    rows = edge_docs + edge_docs[5:8] + [(None, edge_docs[5][1], None, None, 1)]
    docs = spark.createDataFrame(rows, schema).withColumn("_rid", F.lit(1)).withColumn("n_words", F.lit("x")).repartition(3)
    items = items_of(edge_docs)
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit(0))
    want = brute([(r[0], r[1]) for r in rows], items)
    assert sum(r[5] for r in want) > 5
    assert columns(dc.contamination(docs, bench)) == want
    assert columns(dc.contamination(docs, bench, shard_bytes=2000)) == want
    clean = dc.remove_contaminated(docs, bench)
    assert clean.columns == docs.columns
    assert clean.count() == sum(not r[5] for r in want)


def test_benchmark_in_several_passes(spark, edge_docs, schema):
    docs = spark.createDataFrame(edge_docs + edge_docs[5:8], schema)
    items = items_of(edge_docs)
    bench = spark.createDataFrame(items, "item_id long, text string")
    out = dc.contamination(docs, bench, block_bytes=40)
    assert columns(out) == brute([(r[0], r[1]) for r in edge_docs + edge_docs[5:8]], items)
    assert dc.remove_contaminated(docs, bench, block_bytes=40).columns == docs.columns


def test_empty_tables(spark, edge_docs, schema):
    docs, none = spark.createDataFrame(edge_docs, schema), spark.createDataFrame([], "item_id long, text string")
    assert dc.contamination(docs, none).filter("n_hit > 0 or n_items > 0").count() == 0
    assert dc.contamination(docs.limit(0), none).count() == 0


def test_longest_matches(spark, edge_docs, schema):
    docs = spark.createDataFrame(edge_docs, schema)
    items = [(1, edge_docs[5][1][:100] + " zzz " + edge_docs[6][1]), (2, "qqq")]
    got = {(r.item_id, r.word): r.n_words for r in dc.longest_matches(docs, spark.createDataFrame(items, "item_id long, text string"), shard_bytes=3000).collect()}
    texts = [words(d[1]) for d in edge_docs]
    for item_id, t in items:
        w = words(t)
        for i in range(len(w)):
            best = 0
            for x in texts:
                for p in range(len(x)):
                    n = 0
                    while i + n < len(w) and p + n < len(x) and w[i + n] == x[p + n]:
                        n += 1
                    best = max(best, n)
            assert got.get((str(item_id), i), 0) == best


def test_suffix_array():
    rng = np.random.default_rng(3)
    for n in (0, 1, 2, 50, 400):
        t = rng.integers(0, 3, n).astype(np.uint64) << np.uint64(60)
        assert suffix_array(t).tolist() == sorted(range(n), key=lambda i: t[i:].tolist())
