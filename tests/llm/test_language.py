import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from loglens.llm import language as lg
from loglens.llm.common import text_chunks


def brute_bits(train, text, order):
    """Code length of ``text`` (bytes) in plain Python."""
    pad = bytes([lg.START]) * order
    seen = Counter()
    for t in train:
        t = pad + t
        for i in range(order, len(t)):
            for k in range(order + 1):
                seen[t[i - k:i], t[i]] += 1
    total, kinds = Counter(), Counter()
    for (c, _), n in seen.items():
        total[c] += n
        kinds[c] += 1
    bits, t = 0.0, pad + text
    for i in range(order, len(t)):
        for k in range(order, -1, -1):
            c = t[i - k:i]
            if (c, t[i]) in seen:
                bits -= math.log2(seen[c, t[i]] / (total[c] + kinds[c]))
                break
            if c in total:
                bits -= math.log2(kinds[c] / (total[c] + kinds[c]))
        else:
            bits += 8
    return bits


def test_code_lengths_against_plain_python(spark):
    train = {"a": ["the rain in the river", "a stone"], "b": ["le rêve du niño", "über stone", ""]}
    rows = [(i, t, lang) for i, (lang, t) in enumerate((lang, t) for lang in train for t in train[lang])]
    docs = spark.createDataFrame([(i * 1000, t, lang) for i, t, lang in rows], "doc_id long, text string, lang string")
    docs = docs.filter(~lg.held_out("doc_id"))
    used = {lang: [r.text.encode() for r in docs.collect() if r.lang == lang] for lang in train}
    model = lg.learn(docs, order=3)
    tests = ["the über stone", "q", "rêve\nthe", "ééé"]
    chunk = next(text_chunks(iter([pa.record_batch({"text": pa.array(tests)})])))
    each = lg.code_lengths(model, lg.grams(chunk, 3))
    for i, t in enumerate(tests):
        got = each[chunk.offsets[i]:chunk.offsets[i + 1]].sum(axis=0)
        assert np.allclose(got, [brute_bits(used[lang], t.encode(), 3) for lang in model.languages], rtol=1e-4)


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = lg.identify(docs, lg.learn(docs)).join(docs.select("doc_id", "lang", "text"), "doc_id").withColumn("held", lg.held_out("doc_id")).collect()
    assert len(out) == 1000
    assert all(r.held == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in out)
    tests = [r for r in out if r.held and any(c.isalpha() for c in r.text)]
    assert sum(r.lang == r.lang_pred for r in tests) >= 0.95 * len(tests)
    assert all(r.lang_pred == "und" for r in out if not any(c.isalpha() for c in r.text))
    assert all(0 <= r.score <= 1 for r in out)


def test_edges(spark, edge_docs, schema):
    docs = spark.createDataFrame(edge_docs + edge_docs[:2] + [(None, "the of", "en", "s", 1), (77777, "Привет", None, "s", 1)], schema)
    clash = docs.withColumn("id", F.lit("x")).withColumn("score", F.lit("y")).withColumn("h", F.lit(1))
    model = lg.learn(clash)
    assert model.languages == ["de", "en"]
    out = {(r.doc_id, r.lang_pred) for r in lg.identify(clash, model).collect()}
    assert (None, "en") in out or (None, "de") in out
    bad = {d[0] for d in edge_docs if not any(c.isalpha() for c in d[1] or "")}
    assert {i for i, lang in out if lang == "und"} == bad
    kept = lg.keep_identified(clash, model, 0.0)
    assert kept.columns == clash.columns and kept.count() == docs.count() - len(bad)
    nothing = lg.learn(docs.limit(0))
    assert {r.lang_pred for r in lg.identify(docs, nothing).collect()} == {"und"}
    assert lg.identify(docs.limit(0), model).count() == 0
