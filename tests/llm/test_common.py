import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from loglens.llm import common as c


def test_words_and_hashes():
    texts = ["Hello, wOrld 42", None, "", "éa É", "x" * 5000, "a\x0bb\x1c c"]
    chunks = list(c.text_chunks(iter([pa.record_batch({"text": pa.array(texts)})]), chunk_bytes=20))
    assert sum(len(x) for x in chunks) == len(texts)
    found = []
    for chunk in chunks:
        w = c.find_words(chunk, c.SPACED_WORDS)
        low = c._LOWER[chunk.data]
        found += [low[s:e].tobytes().decode() for s, e in zip(w.start, w.end)]
    assert found == ["hello,", "world", "42", "éa", "É", "x" * 5000, "a", "b\x1c", "c"]
    data = np.frombuffer(b"abcXabcXabd", np.uint8)
    h = c.RollingHash(data)
    assert h.ranges(np.array([0]), np.array([3])) == h.ranges(np.array([4]), np.array([7])) != h.ranges(np.array([8]), np.array([11]))
    assert list(h.windows(4)[:1]) == list(h.windows(4)[4:5])


@pytest.mark.parametrize("seed", range(3))
def test_components_against_union_find(spark, seed):
    rng = random.Random(seed)
    edges = [(rng.randint(0, 60), rng.randint(0, 60)) for _ in range(40)] + [(i, i + 1) for i in range(100, 160)] + [(200, i) for i in range(201, 260)]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x
    for a, b in edges:
        if a != b:
            a, b = sorted((root(a), root(b)))
            parent[b] = a
    got = {r.node: r.component for r in c.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {x: root(x) for x in parent}
    assert c.components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_row_ids_keep_the_order(spark):
    df = spark.createDataFrame([(5, "a"), (3, "b"), (None, "z"), (5, "c"), (None, None), (5, "a")], "k long, t string").repartition(3)
    rows = sorted((r._rid, r.k) for r in c.with_row_ids(df, "k").collect())
    assert [k for _, k in rows] == [3, 5, 5, 5, None, None] and len({i for i, _ in rows}) == 6
    plain = c.with_row_ids(df.filter("k = 3"), "k").collect()
    assert [r._rid for r in plain] == [3]
    assert c.fresh_name(df.withColumn("K_", F.lit(1)), "k") == "k__"


CLASHING = ["_p", "_o", "_s", "row_part", "row_place", "row_shift", "n", "id", "rid", "row_id", "center", "component", "spans", "new_text", "source_", "h", "slot"]
TEXTS = ["one two three four five six seven", "one two three four five six seven", None, "", "nine ten eleven twelve thirteen fourteen", "a b c d e f g h"]


@pytest.mark.parametrize("ids", [["d1", "01", "1", "z", None, "d1"], [1, 1, None, 4, 5, 6]])
def test_any_ids_and_any_column_names(spark, ids):
    """Text ids, repeated and null ids, and columns of every name the operators use, for all table forms."""
    from loglens.llm import decontaminate, mixing, ngram_join, repeats
    kind = "string" if "d1" in ids else "long"
    df = spark.createDataFrame([(i, t, "en", None if k == 2 else "s", 1) for k, (i, t) in enumerate(zip(ids, TEXTS))],
                               f"doc_id {kind}, text string, lang string, source string, n_chars long")
    odd = df
    for name in CLASHING:
        odd = odd.withColumn(name, F.lit("x"))
    rows = c.with_row_ids(odd, "doc_id")
    assert rows.columns == [*odd.columns, "_rid"] and sorted(r[-1] for r in rows.collect()) == list(range(6))
    bench = spark.createDataFrame([("i", "nine ten eleven twelve thirteen fourteen")], "item_id string, text string")
    kept = ngram_join.drop_near_copies(odd)
    assert kept.columns == odd.columns and kept.count() == 5
    clean = decontaminate.remove_contaminated(odd, bench)
    assert clean.columns == odd.columns and clean.count() == 5
    cut = repeats.remove_repeats(odd)
    assert cut.columns == odd.columns and cut.count() == 6
    mixed = mixing.with_copies(odd)
    assert mixed.columns[:len(odd.columns)] == odd.columns and mixed.count() == 6
    # the queries' forms: one row a document, ids as they are
    key = lambda values: sorted(map(str, values))
    assert key(r.doc_id for r in decontaminate.contamination(odd, bench).collect()) == key(ids)
    assert key(r.doc_id for r in repeats.repeated_bytes(odd).collect()) == key(ids)
    assert key(r.doc_id for r in mixing.mix(odd).collect()) == key(ids)
    similar = ngram_join.similar_documents(odd).collect()
    assert key(r.doc_id for r in similar) == key(ids) and all(r.component_id in ids for r in similar)
