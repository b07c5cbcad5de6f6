"""The audit against plain Python, term by term."""
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from loglens.llm import divergence as dv


def brute(rows, min_docs):
    """(lang, source, part, item, value, rank) of (text, lang, source) rows."""
    rows = [tuple(x or "" for x in r) for r in rows]
    terms = [re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m.group().lower(), t)) for t, _, _ in rows]
    out = []
    for lang in {r[1] for r in rows}:
        docs = Counter(t for r, w in zip(rows, terms) if r[1] == lang for t in set(w))
        kept = [t for t, n in docs.items() if n >= min_docs]
        counts = {s: Counter() for _, l, s in rows if l == lang}
        for (_, l, s), w in zip(rows, terms):
            if l == lang:
                counts[s].update(t for t in w if docs[t] >= min_docs)
        p = lambda c: {t: 1 + 10**9 * (c[t] + 2) // (sum(c.values()) + 2 * len(kept)) for t in kept}
        share = {s: p(c) for s, c in counts.items()}
        whole = p(sum(counts.values(), Counter()))
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in counts:
            parts = {"pair": {o: sum(f(share[s][t], share[o][t]) for t in kept) for o in counts if o != s},
                     "term": {t: f(share[s][t], whole[t]) for t in kept if counts[s][t] and share[s][t] > whole[t]}}
            for part, values in parts.items():
                ranked = sorted(values.items(), key=lambda kv: (-kv[1], kv[0].encode()))
                out += [(lang, s, part, i, v, r) for r, (i, v) in enumerate(ranked, 1) if part == "pair" or r <= 10]
    return sorted(out)


def audited(df, **settings):
    return sorted((r.lang, r.source, r.part, r.item, r.value, r["rank"]) for r in dv.audit(df, **settings).collect())


@pytest.fixture(scope="module")
def skewed():
    """Many sources, one of them with a third of the rows; copies; rare and frequent terms."""
    rng = random.Random(8)
    words = ["".join(rng.choice("abcdéßñ漢") for _ in range(rng.randint(1, 6))) for _ in range(300)]
    rows = []
    for i in range(400):
        source = "hot" if i % 3 == 0 else f"s{rng.randint(0, 14)}"
        rows.append((" ".join(words[int(rng.paretovariate(0.5)) % 300].title() for _ in range(rng.randint(0, 40))), rng.choice(["x", "y", "y", None]), source))
    return rows + rows[:30] + [(rows[0][0], "y", "hot")] * 60 + [("lone words", "z", "only"), (None, "w", None), (None, "w", "v"), ("", None, "s1")]


@pytest.mark.parametrize("settings", [{}, {"block": 16}, {"tile": 4, "block": 64}])
def test_against_plain_python(spark, skewed, settings):
    docs = spark.createDataFrame(skewed, "text string, lang string, source string")
    assert audited(docs, **settings) == brute(skewed, 10)


def test_edges_and_clashing_columns(spark, edge_docs, schema):
    rows = edge_docs + [(None, "of the", None, "s1", None)] * 2
    docs = spark.createDataFrame(rows, schema)
    for name in ("term", "n", "docs", "first", "tile", "block", "place", "size"):
        docs = docs.withColumn(name, F.lit("x"))
    plain = [(r[1], r[2], r[3]) for r in rows]
    assert audited(docs, min_docs=3) == brute(plain, 3)
    assert audited(docs, min_docs=10**6) == brute(plain, 10**6)
    assert audited(docs.limit(0)) == []


def test_partial_counts_and_pieces_change_nothing(skewed, monkeypatch):
    import pyarrow as pa
    rows = [tuple(x or "" for x in r) for r in skewed] + [("Äb" * 50 + " " + "c" * 30, "x", "hot")]
    batch = pa.record_batch({c: pa.array([r[i] for r in rows], pa.string()) for i, c in enumerate(("text", "lang", "source"))})

    def counted():
        total = Counter()
        for b in dv._count(iter([batch])):
            for r in b.to_pylist():
                total[r["lang"], r["source"], r["term"], "n"] += r["n"]
                total[r["lang"], r["source"], r["term"], "docs"] += r["docs"]
        return total

    whole = counted()
    monkeypatch.setattr(dv, "PARTIAL", 40)
    monkeypatch.setattr(dv, "_PIECE", 7)
    assert counted() == whole


def test_counts_beyond_64_bit_products():
    counts = np.array([0, 5, 10**14], dtype=np.int64)
    total = np.int64(3 * 10**14)
    assert dv.shares(counts, total).tolist() == [1 + 10**9 * (c + 2) // (3 * 10**14) for c in counts.tolist()]


def test_equal_subtrees_are_one_node():
    rng = np.random.default_rng(1)
    counts = np.zeros((30, 1000), dtype=np.int64)
    counts[:, :40] = rng.integers(0, 50, (30, 40))
    trees = dv.Trees(counts)
    assert sum(len(left) for left, _ in trees.levels) < 30 * 80      # 30 whole trees have 30 690
    totals = counts.sum(axis=1) + 2000
    for one in (0, 7):
        others = np.array([k for k in range(30) if k != one])
        p = [[1 + 10**9 * (c + 2) // t for c in row] for row, t in zip(counts.tolist(), totals.tolist())]
        want = [sum((a - b) ** 2 // (a + b) for a, b in zip(p[one], p[o])) for o in others]
        assert trees.differences(one, others, totals).tolist() == want
