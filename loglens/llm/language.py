"""Language identification by prediction by partial matching over bytes.

Each language has a tree of byte contexts, up to ORDER bytes, learned from labelled
documents and then frozen. A byte is coded in the longest context that has seen it: each
longer known context costs its escape (method C: q distinct bytes in n occurrences give
probability c / (n + q) to a byte seen c times and q / (n + q) to the escape, without
exclusion), an unknown context costs nothing, and a byte seen in no context 1 / 256
after the last escape. The language with the shortest code of the whole text wins.

Learning takes about TRAIN_DOCS documents of each language, chosen by a hash of their id
among those that may be learned from; whole texts. That, and MAX_LANGUAGES, bounds the model,
which is broadcast. Every document is scored whole, in its scan task: no shuffle.

Edge cases: a null text, or one without a letter, is ``und`` with score 0, and so is
everything where nothing can be learned; ties go to the smaller name; rows are scored one by
one, so repeated rows repeat; rows with a null id are scored but not learned from.
"""
from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import _LOWER, Chunk, numbers, text_chunks

ORDER = 4
TRAIN_DOCS = 1000
#: Languages that are learned, those with the most documents; bounds the model.
MAX_LANGUAGES = 500
UNKNOWN = "und"
#: Byte that stands before the start of every text.
START = 10

_U = np.uint64
_CHUNK = 1 << 18


def grams(chunk: Chunk, order: int) -> np.ndarray:
    """The ``order`` bytes before each byte and the byte itself, packed; A-Z lower-cased."""
    data = _LOWER[chunk.data]
    place = np.arange(len(data)) - np.repeat(chunk.offsets[:-1], np.diff(chunk.offsets))
    out = data.astype(_U)
    for j in range(1, order + 1):
        back = np.full(len(data), START, dtype=_U)
        back[j:] = data[:-j]
        back[place < j] = START
        out |= back << _U(8 * j)
    return out


@dataclass
class Model:
    """Code lengths in bits. ``costs[k][i]``: of the packed context of k bytes and byte
    ``keys[k][i]``, for each language; ``escapes[k][i]``: of leaving context ``contexts[k][i]``."""
    languages: list[str]
    keys: list[np.ndarray]
    costs: list[np.ndarray]
    contexts: list[np.ndarray]
    escapes: list[np.ndarray]


def _find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(keys):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return at, keys[at] == wanted


def freeze(languages: list[str], lang: np.ndarray, gram: np.ndarray, count: np.ndarray, order: int = ORDER) -> Model:
    """Model from the counts of whole grams (language number, packed gram, count)."""
    model = Model(languages, [], [], [], [])
    n_lang = len(languages)
    for k in range(order + 1):
        part = gram & _U((1 << (8 * (k + 1))) - 1)
        keys, where = np.unique(part, return_inverse=True)
        counts = np.zeros((len(keys), n_lang))
        np.add.at(counts, (where.reshape(-1), lang), count)
        contexts, of = np.unique(keys >> _U(8), return_inverse=True)
        of = of.reshape(-1)
        total, kinds = np.zeros((len(contexts), n_lang)), np.zeros((len(contexts), n_lang))
        np.add.at(total, of, counts)
        np.add.at(kinds, of, counts > 0)
        with np.errstate(divide="ignore", invalid="ignore"):
            escape = np.where(total > 0, -np.log2(kinds / (total + kinds)), 0.0)
            seen = -np.log2(counts / (total + kinds)[of])
        lower = 8.0 if k == 0 else model.costs[k - 1][_find(model.keys[k - 1], keys & _U((1 << (8 * k)) - 1))[0]]
        model.keys.append(keys)
        model.costs.append(np.where(counts > 0, seen, escape[of] + lower))
        model.contexts.append(contexts)
        model.escapes.append(escape)
    model.costs = [c.astype(np.float32) for c in model.costs]
    model.escapes = [e.astype(np.float32) for e in model.escapes]
    return model


def code_lengths(model: Model, packed: np.ndarray) -> np.ndarray:
    """Bits of each byte for each language."""
    out = np.zeros((len(packed), len(model.languages)), dtype=np.float32)
    todo = np.arange(len(packed))
    for k in range(len(model.keys) - 1, -1, -1):
        part = packed[todo] & _U((1 << (8 * (k + 1))) - 1)
        at, found = _find(model.keys[k], part)
        out[todo[found]] += model.costs[k][at[found]]
        todo, part = todo[~found], part[~found]
        if not len(todo):
            return out
        at, known = _find(model.contexts[k], part >> _U(8))
        out[todo[known]] += model.escapes[k][at[known]]
    out[todo] += 8.0
    return out


def _has_letter(chunk: Chunk) -> np.ndarray:
    ascii_letter = np.zeros(256, dtype=np.int64)
    ascii_letter[97:123] = 1
    sums = np.concatenate(([0], np.cumsum(ascii_letter[_LOWER[chunk.data]])))
    out = sums[chunk.offsets[1:]] > sums[chunk.offsets[:-1]]
    for i in np.flatnonzero(~out & (np.diff(chunk.offsets) > 0)):
        out[i] = any(c.isalpha() for c in chunk.text(i).decode("utf-8", "replace"))
    return out


def predict(model: Model, chunk: Chunk) -> tuple[list[str], np.ndarray]:
    """Language and score (its share of the languages' probabilities) of each row."""
    n = len(chunk)
    letters = _has_letter(chunk)
    if not model.languages or not len(chunk.data):
        return [UNKNOWN] * n, np.zeros(n)
    order = len(model.keys) - 1
    bits = np.zeros((n, len(model.languages)))
    row = np.repeat(np.arange(n), np.diff(chunk.offsets))
    packed = grams(chunk, order)
    for i in range(0, len(packed), _CHUNK):
        each = code_lengths(model, packed[i:i + _CHUNK])
        rows = row[i:i + _CHUNK]
        heads = np.flatnonzero(np.concatenate(([True], rows[1:] != rows[:-1])))
        bits[rows[heads]] += np.add.reduceat(each, heads, axis=0, dtype=np.float64)
    best = np.argmin(bits, axis=1)
    share = 1 / np.exp2(np.maximum(bits.min(axis=1)[:, None] - bits, -1000)).sum(axis=1)
    return [model.languages[b] if ok else UNKNOWN for b, ok in zip(best, letters)], np.where(letters, share, 0.0)


# ------------------------------------------------------------------ learning
def held_out(id_col: str) -> F.Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def _count(order: int):
    schema = pa.schema([("lang", pa.string()), ("gram", pa.int64()), ("n", pa.int64())])

    def run(key, table):
        found, counts = np.empty(0, _U), np.empty(0, np.int64)
        for chunk in text_chunks(iter(table.to_batches()), "text", 4 * _CHUNK):
            g, n = np.unique(grams(chunk, order), return_counts=True)
            both, where = np.unique(np.concatenate((found, g)), return_inverse=True)
            counts = np.bincount(where.reshape(-1), weights=np.concatenate((counts, n)), minlength=len(both)).astype(np.int64)
            found = both
        return pa.table({"lang": pa.array([key[0].as_py()] * len(found), pa.string()), "gram": pa.array(found.astype(np.int64)), "n": pa.array(counts)}, schema=schema)

    return run


def learn(docs: DataFrame, id_col: str = "doc_id", lang_col: str = "lang", train_docs: int = TRAIN_DOCS, order: int = ORDER) -> Model:
    """Model of the languages of ``docs``, from about ``train_docs`` rows of each that are not held out."""
    able = docs.filter(F.col(lang_col).isNotNull() & F.col("text").isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col))
    able = able.select(F.col(lang_col).alias("lang"), "text", F.xxhash64(F.col(id_col)).alias("h"))
    share = able.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(MAX_LANGUAGES) \
        .select("lang", (F.lit(float(train_docs)) / F.col("n")).alias("share"))
    some = able.join(F.broadcast(share), "lang").filter(F.pmod("h", F.lit(1 << 30)) < F.col("share") * (1 << 30)).select("lang", "text")
    table = some.groupBy("lang").applyInArrow(_count(order), "lang string, gram long, n long").toArrow()
    languages = sorted(set(table.column("lang").to_pylist()))
    number = np.searchsorted(languages, table.column("lang").to_pylist()) if languages else np.empty(0, np.int64)
    return freeze(languages, number, numbers(table.column("gram")).astype(_U), numbers(table.column("n")), order)


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id") -> DataFrame:
    """Row of ``docs`` by row: ``id_col``, lang_pred, score."""
    shared = docs.sparkSession.sparkContext.broadcast(tuple(model.__dict__.values()))
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        for chunk in text_chunks(batches):
            lang, score = predict(Model(*shared.value), chunk)
            yield pa.RecordBatch.from_arrays([chunk.column("id"), pa.array(lang, pa.string()), pa.array(score, pa.float64())], names=["id", "lang_pred", "score"])

    return docs.select(F.col(id_col).alias("id"), "text").mapInArrow(run, f"id {kind}, lang_pred string, score double").withColumnRenamed("id", id_col)


def keep_identified(docs: DataFrame, model: Model, least_score: float = 0.5) -> DataFrame:
    """``docs`` without rows that have no language, or none that is likelier than ``least_score``."""
    shared = docs.sparkSession.sparkContext.broadcast(tuple(model.__dict__.values()))

    def run(batches):
        for chunk in text_chunks(batches):
            lang, score = predict(Model(*shared.value), chunk)
            keep = (np.array(lang, dtype=object) != UNKNOWN) & (score >= least_score)
            yield chunk.batch.slice(chunk.first, len(chunk)).filter(pa.array(keep.astype(bool)))

    return docs.mapInArrow(run, docs.schema)
