"""A corpus cleaning pipeline over ``documents``, one training-data operator a stage.

``run`` applies the stages in order; each writes its rows to the shared folder and
the next one reads them.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loglens.llm import decontaminate, language, mixing, ngram_join, secrets
from loglens.llm.common import written
from loglens.llm.entries import read


def keep_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the languages learned from the labelled ones; texts without
    letters and texts that no language explains better than all others together go."""
    return language.keep_identified(docs, language.learn(docs))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by five-word shingles at 0.75 and more: the smallest id."""
    return ngram_join.drop_near_copies(docs)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without contaminated ones (13-word windows, a twentieth of the words)."""
    return decontaminate.remove_contaminated(docs, read(spark, sf_dir, "benchmark"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, found secrets masked and n_chars the new length."""
    return secrets.mask_secrets(docs, secrets.learn_cuts(docs), "n_chars")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with the copies that the mix takes of each (0: it takes none), and the
    words these come to; sources weigh 3, 1, 2, repeating."""
    return mixing.with_copies(docs)


STAGES = [
    ("language ID", keep_languages),
    ("n-gram Jaccard join", drop_near_copies),
    ("benchmark decontamination", drop_benchmark),
    ("secret scans", mask_secrets),
    ("mixing sources to target weights", mix_sources),
]

#: Language models, shingle joins and rounding have no SQL form; tests hold run() against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, f"stage-{k}")
    return docs
