"""S3: the native tokeniser equals POSIX shell splitting (shlex) on random strings."""
import random
import shlex

from pyspark.sql import functions as F

from loglens.sources.tokens import shell_tokens

ALPHABET = ["a", "b", "1", " ", " ", "\t", '"', "'", "\\", "=", "é", "/", "-", "%"]


def _shlex(s):
    try:
        return shlex.split(s)
    except ValueError:
        return None


def test_random_strings_match_shlex(spark):
    rng = random.Random(7)
    samples = ["".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 24))) for _ in range(3000)]
    samples += ['a "b c" d', "a 'b c' d", 'x\\ y', 'say "it\\"s"', "ab'cd'ef", "'", '"', "\\", "a\\", '"a\\\\"']
    df = spark.createDataFrame([(i, s) for i, s in enumerate(samples)], "i int, s string")
    got = {r.i: (list(r.t) if r.t is not None else None)
           for r in df.select("i", shell_tokens(F.col("s")).alias("t")).collect()}
    bad = [(s, got[i], _shlex(s)) for i, s in enumerate(samples) if got[i] != _shlex(s)]
    assert not bad, bad[:5]


def test_long_hostile_line_does_not_overflow(spark):
    long = "x" * 200_000 + ' "' + "ab\\\"c" * 20_000 + '" ' + "'" + "q" * 50_000 + "'"
    df = spark.createDataFrame([(long,), ("'" + "a" * 100_000,)], "s string")
    rows = df.select(F.size(shell_tokens(F.col("s"))).alias("n")).collect()
    assert rows[0].n == 3
    assert rows[1].n is None or rows[1].n == -1


def test_document_tokenizing_query_equals_shlex(spark):
    """s3_tokenize_documents (no SQL twin) against a brute-force shlex loop on whole texts."""
    import pyarrow.parquet as pq

    from conftest import SF_SMALL
    from loglens.plans.catalog import s3_tokenize_documents
    docs = pq.read_table(f"{SF_SMALL}/documents.parquet", columns=["doc_id", "text"]).to_pylist()
    expected = {}
    for d in docs:
        lines = d["text"].split("\n")
        toks = [_shlex(l) for l in lines]
        expected[d["doc_id"]] = (len(lines), sum(t is not None for t in toks), sum(len(t) for t in toks if t is not None))
    got = {r.doc_id: (r.lines, r.valid_lines, r.tokens) for r in s3_tokenize_documents(spark, SF_SMALL).collect()}
    assert got == expected
