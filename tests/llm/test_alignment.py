"""Alignment against plain Python, token pair by token pair."""
import hashlib
from collections import Counter

import public_tokenizers as P
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from loglens.llm import alignment, entries

SF = "/root/testdata/sf0.001"
A, B = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def libraries():
    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=B)


def token_bytes(libraries, text):
    """(id, bytes) of both sides' tokens, without the operator's tables."""
    a, b = libraries
    letters = {}
    for first, last, at in ((0x21, 0x7E, 0x21), (0xA1, 0xAC, 0xA1), (0xAE, 0xFF, 0xAE), (0x100, 0x120, 0), (0x121, 0x142, 0x7F), (0x143, 0x143, 0xAD)):
        letters.update({chr(c): at + c - first for c in range(first, last + 1)})
    e = a.encode(" " + text, add_special_tokens=False)
    left = [(i, bytes(letters[c] for c in t)) for i, t in zip(e.ids, e.tokens)]
    right = []
    for i in b.encode(text):
        piece = b.id_to_piece(i)
        right.append((i, bytes([int(piece[3:-1], 16)]) if b.is_byte(i) else piece.replace("▁", " ").encode()))
    return left, right


def brute(libraries, texts):
    docs = []
    for text in texts:
        left, right = token_bytes(libraries, text) if text else ([], [])
        whole = b" " + (text or "").encode()
        if b"".join(x for _, x in left) != whole or b"".join(x for _, x in right) != whole:
            left, right = [], []
        spans = []
        for side in (left, right):
            at, out = 0, []
            for i, x in side:
                out.append((i, at, at + len(x)))
                at += len(x)
            spans.append(out)
        found = [(a, b) for a, s, e in spans[0] for b, t, f in spans[1] if s < f and t < e]
        ends = sorted({e for _, _, e in spans[0]} & {e for _, _, e in spans[1]})
        groups, at = [], 0
        for end in ends:
            groups.append("|".join(",".join(str(i) for i, s, e in side if at <= s and e <= end) for side in spans))
            at = end
        docs.append((len(left), len(right), groups, found))
    counts = Counter(p for d in docs for p in set(d[3]))
    best = {}
    for (a, _), n in counts.items():
        best[a] = max(best.get(a, 0), n)
    return [(na, nb, len(g), len(f), hashlib.sha256(";".join(g).encode()).hexdigest() if na else "",
             sum(counts[p] == best[p[0]] for p in f), sum(counts[p] for p in f)) for na, nb, g, f in docs]


COLUMNS = ("n_a", "n_b", "n_groups", "n_links", "groups_sha256", "n_best", "count_sum")
ODD = [" lead", "a\x00b", "<|endoftext|> </s> <s> <0x41>", "▁x", "   ", "漢字 🤖 é́\n\n\ttab", "x" * 3000, "café " * 900, "\r\n"]


def aligned(df, **settings):
    return alignment.align(df, A, B, **settings).withColumnRenamed("groups", "groups_sha256").collect()


def test_query_against_plain_python(spark, libraries):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    docs = [d for d in docs if len(d.text or "") < 4000]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r.doc_id: tuple(r[c] for c in COLUMNS) for r in aligned(df)}
    want = dict(zip([d.doc_id for d in docs], brute(libraries, [d.text for d in docs])))
    assert got == want and len(want) > 100
    whole = entries.op13_alignment(spark, SF)
    assert set(whole.columns) == {"doc_id", *COLUMNS} and whole.count() == 200


def test_edges_and_clashing_columns(spark, libraries, edge_docs, schema, monkeypatch):
    rows = edge_docs + [(900 + i, t, "en", "s", None) for i, t in enumerate(ODD)] + [(None, "a b", None, None, None)] * 2
    texts = [r[1] for r in rows]
    keep = [i for i, t in enumerate(texts) if len(t or "") < 20000]
    rows, texts = [rows[i] for i in keep], [texts[i] for i in keep]
    docs = spark.createDataFrame(rows, schema)
    for name in ("row", "id", "pairs", "n_a", "docs"):
        docs = docs.withColumn(name, F.lit("x"))
    want = sorted((str(r[0]), *w) for r, w in zip(rows, brute(libraries, texts)))
    assert sorted((str(r.doc_id), *(r[c] for c in COLUMNS)) for r in aligned(docs)) == want
    # the bounds on a batch's text and on broadcast pairs change nothing
    monkeypatch.setattr(alignment, "HOT_PAIRS", 20)
    assert sorted((str(r.doc_id), *(r[c] for c in COLUMNS)) for r in aligned(docs, piece_bytes=300)) == want
    assert aligned(docs.limit(0)) == []


def test_groups_as_text(spark):
    out = aligned(spark.createDataFrame([(1, "Hello 漢")], "doc_id long, text string"), digest=False)[0]
    sides = [[x.split(",") for x in g.split("|")] for g in out.groups_sha256.split(";")]
    assert len(sides) == out.n_groups and sum(len(s[0]) for s in sides) == out.n_a and sum(len(s[1]) for s in sides) == out.n_b


def test_merging_by_id_is_the_file_s_own_encoding(libraries):
    import random
    rng = random.Random(2)
    a_json = open(A, encoding="utf-8").read()
    pair = alignment.Pair.load(a_json, open(B, "rb").read())
    assert not isinstance(pair.a, Tokenizer)
    letters = [" ", " ", "  ", "\n", "\t", "\u3000", "\x1c", "a", "the", "N", "'s", "7", "42", ".", "é", "漢", "_", "\u00a0", "🤖", "<|endoftext|>", *"etaoinshr"]
    for _ in range(4000):
        text = "".join(rng.choice(letters) for _ in range(rng.randint(0, 60)))
        assert pair.a.encode_ordinary(text) == libraries[0].encode(text, add_special_tokens=False).ids, text
    other = a_json.replace('"add_prefix_space":false', '"add_prefix_space":true').replace('"add_prefix_space": false', '"add_prefix_space": true')
    assert other != a_json and alignment.by_merges(other, pair.bytes_a) is None
