import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from loglens.llm import repeats


def brute(rows, k):
    """rows in order: (id, text). Later occurrences of any k bytes are removed."""
    seen, out = set(), []
    for doc_id, text in rows:
        b = (text or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - k + 1):
            w = b[i:i + k]
            if w in seen:
                gone[i:i + k] = b"\1" * k
            seen.add(w)
        kept = bytes(x for x, g in zip(b, gone) if not g)
        runs = sum(1 for i in range(len(b)) if gone[i] and (i == 0 or not gone[i - 1]))
        out.append((doc_id, len(b), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return out


def rows_of(edge_docs):
    rng = random.Random(2)
    long = "".join(rng.choice("abcdefgh é") for _ in range(3000))
    texts = [long, long[500:900] + "x" + long[400:700], "ab" * 300, "ab" * 120, "z" * 400, "q" + long[:99], "é" * 150, long[1000:1100], "zz" + long[1000:1101] + long[1000:1100]]
    passage = long[2000:2300]
    for i in range(60):
        texts.append("".join(rng.choice("pqrstu ") for _ in range(rng.randint(0, 80))) + passage[i % 7:len(passage) - i % 11] + "".join(rng.choice("pqrstu ") for _ in range(rng.randint(0, 80))))
    return [(500 + i, t, "en", "s", 1) for i, t in enumerate(texts)] + edge_docs


def got_of(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()), key=repr)


@pytest.mark.parametrize("options", [{}, {"task_stretches": 3, "index_bytes": 2000, "shard_bytes": 300}, {"all_stretches": 2}])
def test_against_brute_force(spark, edge_docs, schema, options):
    rows = rows_of(edge_docs)
    docs = spark.createDataFrame(rows, schema).withColumn("rid", F.lit("r")).withColumn("spans", F.lit(0)).repartition(4)
    want = brute([(r[0], r[1]) for r in sorted(rows)], 100)
    assert sum(w[2] for w in want) > 10_000
    assert got_of(repeats.repeated_bytes(docs, **options)) == sorted(want, key=repr)


def test_repeated_and_null_ids(spark, edge_docs, schema):
    rows = edge_docs[:4] + edge_docs[:4] + [(None, edge_docs[3][1], "a", "b", 1), (None, None, None, None, None)]
    order = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0))
    want = brute([(r[0], r[1]) for r in order], 100)
    docs = spark.createDataFrame(rows, schema)
    assert got_of(repeats.repeated_bytes(docs)) == sorted(want, key=repr)
    cut = repeats.remove_repeats(docs.withColumn("row_id", F.lit(1)))
    assert cut.columns == [*docs.columns, "row_id"] and cut.count() == len(rows)
    assert sum(len((r.text or "").encode()) for r in cut.collect()) == sum(w[1] - w[2] for w in want)


def test_empty(spark, schema):
    assert repeats.repeated_bytes(spark.createDataFrame([], schema)).count() == 0
    assert [r.n_removed for r in repeats.repeated_bytes(spark.createDataFrame([(1, None, "", "", 0), (2, "", "", "", 0)], schema)).collect()] == [0, 0]


def test_merged_transforms_are_sorted():
    rng = random.Random(4)
    strings = ["".join(rng.choice("ab") for _ in range(rng.randint(1, 40))).encode() for _ in range(40)]
    for depth in (1, 3, 8, 50):
        parts = [strings[:13], strings[13:14], strings[14:]]
        shards = [repeats.shard_bwt(p) for p in parts]
        perm, lcp = repeats.merge_bwts(shards, [len(p) for p in parts], depth)
        text, base = [], 0
        for p, s in zip(parts, shards):
            joined = b"\0".join(p) + b"\0"
            text += [joined[i:].split(b"\0")[0][:depth] for i in s[0]]
        ordered = [text[i] for i in perm]
        assert ordered == sorted(text)
        for i in range(1, len(ordered)):
            a, b = ordered[i - 1], ordered[i]
            n = next((j for j in range(min(len(a), len(b))) if a[j] != b[j]), min(len(a), len(b)))
            assert lcp[i] == n
    assert np.all(lcp <= 50)


def test_open_intervals_are_those_of_the_whole_order():
    rng = random.Random(9)
    strings = ["".join(rng.choice("ab") for _ in range(rng.randint(1, 60))).encode() for _ in range(60)] + [b"\xff" * 30] * 3
    for depth in (1, 4, 9, 25, 70):
        parts = [strings[:20], strings[20:21], strings[21:]]
        shards = [repeats.shard_bwt(p) for p in parts]
        perm, lcp = repeats.merge_bwts(shards, [len(p) for p in parts], depth)
        want = []
        for i, row in enumerate(perm.tolist()):
            if i and lcp[i] >= depth:
                want[-1].add(row)
            else:
                want.append({row})
        interval, rows = repeats.open_intervals(shards, depth)
        got = {}
        for k, row in zip(interval.tolist(), rows.tolist()):
            got.setdefault(k, set()).add(row)
        assert sorted(map(sorted, got.values())) == sorted(sorted(w) for w in want if len(w) > 1)
    assert repeats.open_intervals([repeats.shard_bwt([b"abc"])], 5)[0].size == 0
