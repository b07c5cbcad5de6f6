"""Encoding against the tiktoken library, decoding against the texts themselves."""
import hashlib
import random

import public_tokenizers as P
import pytest
import tiktoken
from pyspark.sql import functions as F

from loglens.llm import byte_bpe, entries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def vocabulary(spark):
    return byte_bpe.read_vocabulary(spark, P.path("byte_bpe_50k.tiktoken"), P.PATTERN)


@pytest.fixture(scope="module")
def library(vocabulary):
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=vocabulary.ranks, special_tokens={})


def check(df, vocabulary, library):
    out = byte_bpe.encode(df, vocabulary).withColumn("back", byte_bpe.decode(F.col("ids"), vocabulary)).collect()
    assert len(out) == df.count()
    for r in out:
        assert list(r.ids) == library.encode_ordinary(r.text or ""), r.text
        assert bytes(r.back) == (r.text or "").encode()


def test_query_against_library(spark, library):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    out = entries.op11_byte_bpe(spark, SF).collect()
    assert sorted(r.doc_id for r in out) == sorted(texts)
    for r in out:
        ids = library.encode_ordinary(texts[r.doc_id])
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def test_edges_and_clashing_columns(spark, edge_docs, schema, vocabulary, library):
    odd = ["it's WE'LL 'S 42\u00bd", "<|endoftext|>", "\u3000\u3000x\x85y  \n\n z ", "\U0001f916" * 90, "\t" * 500]
    rows = edge_docs + [(900 + i, t, "en", "s", None) for i, t in enumerate(odd)] + [(None, "a b", None, None, None)] * 2
    docs = spark.createDataFrame(rows, schema)
    check(docs.withColumn("ids", F.lit("x")).withColumn("word", F.lit(1)).withColumn("n", F.lit(2)), vocabulary, library)
    check(docs.limit(0), vocabulary, library)


def test_long_words(spark, vocabulary, library):
    """Words beyond LONG_WORD merge many pairs a step."""
    rng = random.Random(3)
    texts = ["a" * 5000, "ab" * 400, "\u00e9" * 300, "x" + "the" * 500]
    texts += ["".join(rng.choice("etaoinshrdlu") for _ in range(n)) for n in (255, 256, 257, 400, 900, 2500)]
    texts += ["".join(rng.choice("ab") for _ in range(700)) for _ in range(5)]
    check(spark.createDataFrame([(t,) for t in texts], "text string"), vocabulary, library)


def test_characters_of_all_planes(spark, vocabulary, library):
    """Letters, digits and white space of newer Unicode versions than Java's split as the library splits."""
    spans = [range(1, 0x3100), range(0x9F00, 0xD800), range(0xE000, 0x20000, 3), range(0x2A6D0, 0x2FA20, 5)]
    texts = [" ".join(f"{chr(c)}x{chr(c)}" for c in s[a:a + 1500]) for s in spans for a in range(0, len(s), 1500)]
    check(spark.createDataFrame([(t,) for t in texts], "text string"), vocabulary, library)


def test_the_bound_on_looked_up_words_changes_nothing(spark, vocabulary, library, monkeypatch):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("text").limit(60)
    every = {r.word: r.ids for r in byte_bpe.hot_words(docs, vocabulary).collect()}
    monkeypatch.setattr(byte_bpe, "HOT_WORDS", 200)
    few = {r.word: r.ids for r in byte_bpe.hot_words(docs, vocabulary).collect()}
    assert 0 < len(few) <= 200 < len(every) and few.items() <= every.items()
    check(docs, vocabulary, library)


def test_merging_without_spark(vocabulary, library):
    """Words that no dictionary holds are merged by a heap; long ones without a step for all their bytes."""
    rng = random.Random(9)
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(1, 60))) for letters in ("ab", "etaoinshrdlu", "\u00e9\u4e2d ax", "0123456789abcdef") for _ in range(300)]
    for t in texts + ["a" * 20000]:
        assert byte_bpe.merge_bytes(t.encode(), vocabulary.ranks) == library._core_bpe.encode_single_piece(t.encode())


def test_rows_in_several_runs(spark, vocabulary, library, monkeypatch):
    monkeypatch.setattr(byte_bpe, "RUN_WORDS", 7)
    monkeypatch.setattr(byte_bpe, "HOT_WORDS", 0)
    texts = ["", None, "one two three four five six seven eight nine ten", "ten", "", "abcdefgh ijklmnop qrstuv wxyz", None]
    check(spark.createDataFrame([(t,) for t in texts * 3], "text string").coalesce(1), vocabulary, library)
