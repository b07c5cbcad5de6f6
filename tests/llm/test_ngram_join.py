import random
import re

import numpy as np
from pyspark.sql import functions as F

from loglens.llm import ngram_join as nj


def words(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", low)


def shingles(text):
    w = words(text)
    if not w:
        return frozenset()
    return frozenset(tuple(w[i:i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)])


def brute(texts):
    sets = [shingles(t) for t in texts]
    parent = list(range(len(texts)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for i in range(len(texts)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    return [(len(s), root(i)) for i, s in enumerate(sets)]


def family(rng, n, change):
    base = [rng.choice("abcdefghijklmnop") + str(rng.randint(0, 40)) for _ in range(60)]
    for _ in range(n):
        w = list(base)
        for _ in range(rng.randint(0, change)):
            w[rng.randrange(len(w))] = f"x{rng.randint(0, 99999)}"
        yield " ".join(w)


def check(spark, rows, schema, docs=None):
    docs = docs or spark.createDataFrame(rows, schema).repartition(3)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in nj.similar_documents(docs).collect()}
    assert len(got) == len(rows)
    want = brute([r[1] for r in rows])
    assert got == {r[0]: (n, rows[c][0]) for r, (n, c) in zip(rows, want)}
    return want


def test_against_brute_force(spark, edge_docs, schema):
    rng = random.Random(8)
    texts = [t for c in (2, 3, 6) for t in family(rng, 25, c)]
    boiler = " ".join(f"line{i}" for i in range(40))
    texts += [boiler + " " + " ".join(f"w{rng.randint(0, 9999)}" for _ in range(n)) for n in (5, 8, 10, 12, 14, 30) for _ in range(6)]
    rows = edge_docs + [(1000 + i, t, "en", "s", 1) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, schema).withColumn("rid", F.lit(3)).withColumn("n", F.lit("n")).repartition(3)
    want = check(spark, rows, schema, docs)
    sizes = np.bincount([c for _, c in want])
    assert sizes.max() > 10 and np.count_nonzero(sizes == 1) > 10
    kept = nj.drop_near_copies(docs)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {rows[c][0] for _, c in want}


def test_repeated_and_null_ids(spark, edge_docs, schema):
    rows = edge_docs[:3] + edge_docs[:3] + [(None, edge_docs[1][1], "x", "y", 1), (None, None, None, None, None), (1, "other text of five words", "en", "s", 1)]
    got = sorted((r.doc_id is None, r.doc_id, r.n_shingles, r.component_id) for r in nj.similar_documents(spark.createDataFrame(rows, schema)).collect())
    assert len(got) == 9 and sum(r[3] is None for r in got) == 1
    assert nj.drop_near_copies(spark.createDataFrame(rows, schema)).count() == 5


def test_empty(spark, edge_docs, schema):
    assert nj.similar_documents(spark.createDataFrame([], schema)).count() == 0
    assert nj.similar_documents(spark.createDataFrame([(1, None, "", "", 0), (2, "", "", "", 0)], schema)).count() == 2


def test_divide_skip():
    rng = np.random.default_rng(1)
    for _ in range(50):
        m = int(rng.integers(1, 40))
        sets = [np.unique(rng.integers(0, 60, rng.integers(1, 50))) for _ in range(m)]
        query = np.unique(rng.integers(0, 70, 40))
        keys, inv = np.unique(np.concatenate(sets), return_inverse=True)
        postings = np.sort(inv * m + np.repeat(np.arange(m), [len(s) for s in sets]))
        starts = np.searchsorted(postings, np.arange(len(keys) + 1) * m)
        true = np.array([len(np.intersect1d(s, query)) for s in sets])
        for t in (1, 5, 15, 30):
            got = nj.divide_skip(query, keys, starts, postings, m, t)
            assert np.array_equal(got[true >= t], true[true >= t]) and np.all(got <= true)


def test_every_link_is_counted(spark, monkeypatch):
    """Links inside a component count too, over several blocks of it."""
    monkeypatch.setattr(nj, "BLOCK", 8)
    rng = random.Random(21)
    rows = [(i, t) for i, t in enumerate(t for c in (1, 2, 3, 4) for t in family(rng, 30, c))]
    rows += [(900 + i, "a b c d e f") for i in range(3)] + [(990, "one"), (991, "One"), (992, None)]
    sets = {i: shingles(t) for i, t in rows}
    want = {i: len({t for t in sets.values() if t and t != s and 100 * len(s & t) >= 75 * len(s | t)}) if s else 0 for i, s in sets.items()}
    got = {r.doc_id: r.n_links for r in nj.similar_documents(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    assert got == want and max(want.values()) > 12


def test_the_bit_map_holds_every_shared_shingle(spark, monkeypatch):
    monkeypatch.setattr(nj, "MAP_WORDS", 64)
    rng = np.random.default_rng(4)
    s = np.unique(rng.integers(0, 1 << 53, 500))
    bits = nj._bit_map(spark.createDataFrame([(int(x),) for x in s], "s long"))
    value = type("Bits", (), {"value": bits})
    batch = nj.pa.record_batch({"rid": [7, 8], "n": [250, 250], "prefix": [s[:250].tolist(), s[250:].tolist()]})
    out = next(nj._mapped(value)(iter([batch])))
    assert out.column("s").to_pylist() == s.tolist() and out.column("pos").to_pylist()[248:252] == [248, 249, 0, 1]


def test_prefixes_hold_the_rarest_shingles(spark):
    """Frequent shingles come by their counts: what fewer documents hold meets first."""
    part = lambda name: " ".join(f"{name}{i}" for i in range(40))
    rows = [(i, f"{part('often')} {part(f'mid{i // 4}x')}") for i in range(64)]
    docs = spark.createDataFrame(rows, "rid long, text string").coalesce(1)
    known = docs.mapInArrow(nj._frequent, "s long, n long").groupBy("s").agg(F.sum("n").alias("n")).orderBy("s").toPandas()
    assert sorted(set(known.n)) == [4, 64]
    last = type("Last", (), {"value": (known.s.to_numpy().astype(np.uint64), np.floor(2 * np.log2(known.n.to_numpy())).astype(np.int64))})
    batch = nj.pa.record_batch({"rid": [0, 1], "text": [rows[0][1], rows[9][1]]})
    out = next(nj._prefixes(last, 75, 100)(iter([batch])))
    held = dict(zip(known.s.tolist(), known.n.tolist()))
    for prefix in out.column("prefix").to_pylist():
        assert len(prefix) == nj.prefix_length(76, 75, 100) and prefix == sorted(prefix)
        assert {held[s & ((1 << 52) - 1)] for s in prefix} == {4}


def test_only_leaves_out_what_no_bit_stands_for(spark, monkeypatch):
    monkeypatch.setattr(nj, "MAP_WORDS", 64)
    rows = spark.createDataFrame([(i, f"t{i}") for i in range(-5, 3000)], "rid long, text string")
    ids = spark.createDataFrame([(-5,), (0,), (63,), (64,), (2999,)], "s long")
    assert {r.rid for r in nj._only(rows, ids).collect()} == {-5, 0, 63, 64, 2999}


def test_executors_hold_little_beside_the_rows(spark, monkeypatch):
    """One Python function a stage, batches of a few MB, and no bit map longer than it is needed."""
    import os

    from loglens.llm import common
    batch, before = common._BATCH, spark.conf.get(common._BATCH)
    stages, sent, write = [], [], common.written

    def seen(df, name):
        plan = df._jdf.queryExecution().executedPlan().toString()
        stages.append((name, "".join(x[0] for x in re.findall(r"MapInArrow|Exchange", plan)), int(spark.conf.get(batch).rstrip("b"))))
        return write(df, name)
    send = nj._sent
    monkeypatch.setattr(nj, "written", seen)
    monkeypatch.setattr(nj, "_sent", lambda *a: sent.append(send(*a)) or sent[-1])
    rng = random.Random(2)
    rows = [(i, t, "en", "s", 1) for i, t in enumerate(t for c in (2, 6) for t in family(rng, 12, c))]
    check(spark, rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert len(stages) > 5 and [x for x in stages if "MM" in x[1]] == []
    assert {x[2] for x in stages} == {8 * common.CHUNK_BYTES} and spark.conf.get(batch) == before
    assert len(sent) > 4 and not any(os.path.exists(b._path) for b in sent)
