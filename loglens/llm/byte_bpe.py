"""Byte-level BPE encoding and decoding, words cut and counted by Spark, merged in its tasks.

A vocabulary is a rank file (base64 token, rank) that is read, never trained. A token's id is its rank.

* ``pieces``: a text's pieces, the matches of the vocabulary's pattern, as a Rust regular expression
  finds them (Unicode white space, letters and digits of the pattern library's Unicode version).
* ``merge_bytes``: a word's bytes joined, each step the leftmost pair of the lowest rank, from a heap,
  so that long words cost little more than linear time; a word that is a token is that token.
* ``encode``: distinct words are counted, the most frequent ones (``HOT_WORDS`` at most, of at most
  ``HOT_BYTES`` bytes, so at most 20 MB) merged once each and handed to all tasks; of the other words
  a task merges each distinct one of a run of rows once, so the bound changes no result. Words are
  shuffled only for that count, which is partial in each task, so hot words, sources and groups of
  copies cost nothing more.
* ``decode``: the tokens' bytes, joined.

Results: null and empty texts have no tokens and decode to no bytes. Rows are kept one for one, in
any number of equal rows; result columns replace columns of the same name; no other column is read.
"""
from __future__ import annotations

import base64
import heapq
import itertools
import json
import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import list_array, list_parts, most_frequent, numbers, written

#: Most words that are folded once and looked up.
HOT_WORDS = 1 << 17
#: Longest word looked up so.
HOT_BYTES = 32
#: Words of a task that are looked at together, and most merged words that it keeps.
RUN_WORDS = 1 << 18
#: White space of Unicode (fixed values): Java's own class is ASCII only.
_SPACE = r"\t-\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"


@dataclass
class Vocabulary:
    ranks: dict[bytes, int]
    pattern: str               # as Java has it, for texts of characters that Java knows
    newer_pattern: str         # for texts with characters that Java's Unicode version does not know

    def by_rank(self) -> list[bytes]:
        size = max(self.ranks.values(), default=-1) + 1
        found = [b""] * size
        for token, rank in self.ranks.items():
            found[rank] = token
        return found


def read_vocabulary(spark: SparkSession, path: str, pattern: str) -> Vocabulary:
    """The rank file at ``path`` and ``pattern`` in Java's notation."""
    with open(path, "rb") as file:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}
    return Vocabulary(ranks, java_pattern(pattern), java_pattern(pattern, newer(spark, "L"), newer(spark, "N")))


def java_pattern(pattern: str, letters: str = "", digits: str = "") -> str:
    r"""``pattern`` with ``\s`` as Unicode white space and more characters as ``\p{L}`` and ``\p{N}``."""
    l, n = rf"\p{{L}}{letters}", rf"\p{{N}}{digits}"
    outside = r"[^\s\p{L}\p{N}]"
    return f"[^{_SPACE}{l}{n}]".join(
        part.replace(r"\p{L}", f"[{l}]").replace(r"\p{N}", f"[{n}]").replace(r"\s", f"[{_SPACE}]").replace(r"\S", f"[^{_SPACE}]")
        for part in pattern.split(outside))


def newer(spark: SparkSession, kind: str) -> str:
    """A class of the characters that are of ``kind`` to the pattern library and unassigned to this Java."""
    every = "".join(map(chr, [c for c in range(1, sys.maxunicode + 1) if not 0xD800 <= c < 0xE000]))
    known = "".join(regex.findall(rf"\p{{{kind}}}", every))
    missing = spark.range(1).select(F.regexp_replace(F.lit(known), rf"\p{{{kind}}}+", "")).first()[0]
    ranges = "".join(rf"\x{{{a:X}}}-\x{{{b:X}}}" for a, b in _runs([ord(c) for c in missing]))
    return rf"[\p{{Cn}}&&[{ranges}]]" if ranges else ""


def _runs(codes: list[int]) -> list[tuple[int, int]]:
    found: list[list[int]] = []
    for c in codes:
        if found and c == found[-1][1] + 1:
            found[-1][1] = c
        else:
            found.append([c, c])
    return [(a, b) for a, b in found]


# ------------------------------------------------------------------ words to tokens
def pieces(text: Column, vocabulary: Vocabulary) -> Column:
    return F.when(text.rlike(r"\p{Cn}"), F.regexp_extract_all(text, F.lit(vocabulary.newer_pattern), 0)) \
        .otherwise(F.regexp_extract_all(text, F.lit(vocabulary.pattern), 0))


def merge_bytes(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Token ids of ``word``."""
    if word in ranks:
        return [ranks[word]]
    n = len(word)
    end, before = list(range(1, n + 1)), list(range(-1, n))     # of the token that begins at a place; end 0: none does
    heap = [(ranks[word[i:i + 2]], i, i + 2) for i in range(n - 1) if word[i:i + 2] in ranks]
    heapq.heapify(heap)
    while heap:
        _, i, stop = heapq.heappop(heap)
        middle = end[i]
        if not middle or middle == n or end[middle] != stop:
            continue        # one of the two was merged otherwise
        end[i], end[middle], before[stop] = stop, 0, i
        for a, z in ((before[i], stop), (i, end[stop] if stop < n else 0)):
            if a >= 0 and word[a:z] in ranks:
                heapq.heappush(heap, (ranks[word[a:z]], a, z))
    ids, i = [], 0
    while i < n:
        ids.append(ranks[word[i:end[i]]])
        i = end[i]
    return ids


def _merged(vocabulary: Vocabulary, known: dict[bytes, list[int]]):
    """Arrow function from arrays of words to arrays of their token ids, all words' in a row."""
    ranks = vocabulary.ranks

    def run(off: np.ndarray, flat: pa.Array, kept: dict[bytes, list[int]]) -> pa.Array:
        words = flat.dictionary_encode()
        found = []
        for word in words.dictionary.cast(pa.binary()).to_pylist():
            ids = known.get(word) or kept.get(word)
            if ids is None:
                ids = merge_bytes(word, ranks)
                if len(kept) < RUN_WORDS and len(word) <= HOT_BYTES:
                    kept[word] = ids
            found.append(ids)
        size = np.fromiter(map(len, found), np.int64, len(found))
        ids = np.fromiter(itertools.chain.from_iterable(found), np.int32, int(size.sum()))
        at = numbers(words.indices)
        n = size[at]
        until = np.cumsum(n)
        place = np.arange(int(n.sum())) + np.repeat((np.cumsum(size) - size)[at] - until + n, n)
        return list_array(np.concatenate(([0], until))[off], pa.array(ids[place]))

    @F.arrow_udf("array<int>")
    def tokens(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        kept: dict[bytes, list[int]] = {}
        for column in columns:
            off, flat = list_parts(column)
            parts, i = [], 0
            while i < len(column):      # whole rows, one at least
                j = max(i + 1, int(np.searchsorted(off, off[i] + RUN_WORDS, side="right")) - 1)
                parts.append(run(off[i:j + 1] - off[i], flat.slice(off[i], off[j] - off[i]), kept))
                i = j
            yield pa.concat_arrays(parts) if parts else pa.array([], pa.list_(pa.int32()))

    return tokens


# ------------------------------------------------------------------ documents
def hot_words(docs: DataFrame, vocabulary: Vocabulary, text_col: str = "text") -> DataFrame:
    """The most frequent words of ``docs``, at most ``HOT_WORDS``, and their tokens. Distinct words
    are counted before they are shuffled."""
    counts = written(docs.select(F.explode(pieces(F.col(text_col), vocabulary)).alias("word")).groupBy("word")
                     .agg(F.count(F.lit(1)).alias("n")), "words")
    hot = most_frequent(counts.filter(F.octet_length("word") <= HOT_BYTES), "n", HOT_WORDS)
    return hot.select("word", _merged(vocabulary, {})(F.array("word")).alias("ids"))


def encode(docs: DataFrame, vocabulary: Vocabulary, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """``docs`` with the token ids of ``text_col`` (array<int>, empty for null)."""
    known = {r["word"].encode(): r["ids"] for r in hot_words(docs, vocabulary, text_col).collect()}
    return docs.withColumn(ids_col, _merged(vocabulary, known)(pieces(F.coalesce(F.col(text_col), F.lit("")), vocabulary)))


def decode(ids: Column, vocabulary: Vocabulary) -> Column:
    """The bytes of an array of token ids."""
    table = F.from_json(F.lit(json.dumps([t.hex() for t in vocabulary.by_rank()])), "array<string>")
    joined = F.transform(F.array(table), lambda pieces_of: F.unhex(F.array_join(F.transform(ids, lambda i: F.get(pieces_of, i)), "")))
    return F.get(joined, F.lit(0))      # the table is held by the plan once
