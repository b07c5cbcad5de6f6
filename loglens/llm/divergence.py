r"""Source divergence audit: how the word use of a language's sources differs, by exact integers.

* Terms are the matches of ``[^\x00-\x40\x5B-\x60\x7B-\x7F]+`` after lower-casing A-Z. Tasks count
  them by (language, source) and hand over partial counts of at most ``PARTIAL`` entries at a time,
  so what is shuffled are counts, spread by (language, term); a hot source is many small counts.
* A language keeps the terms of at least ``min_docs`` of its documents. A kept term's id is a block
  (hash of the term, about ``BLOCK`` terms each) and a place in the block, the most frequent first.
* A group's counts over a block are a segment tree over the places. Trees are hash-consed level by
  level over all groups of a task: subtrees of identical counts are one node. Two groups are compared
  by traversing both trees at once, every pair of nodes of a level once however often it occurs (rare
  terms' empty subtrees above all); leaf pairs are priced, prices added upward, blocks added by Spark.
* Sources of a language are dealt into tiles of about ``TILE``; a task compares two tiles over one
  block, so its memory is bounded whatever the number of terms, sources and documents. The result
  itself has a row for every two sources of a language.

With N a group's sum of counts over its language's V kept terms, a term's share is
``p = 1 + floor(10^9 (count + 2) / (N + 2V))`` and two shares p, q differ by ``floor((p-q)^2/(p+q))``.

Results: null text, language and source are ''. Every row counts as a document of its own, equal
ones too. A language without kept terms has pairs of value 0; a lone source has none; an empty table
gives none. Equal values rank by item in UTF-8 order. Other columns of the table are not read.
"""
from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import give_back, written

#: Documents of its language that a kept term is in.
MIN_DOCS = 10
#: Ranks of the term part.
TOP_TERMS = 10
#: Terms of a block, sources of a tile, about.
BLOCK = 4096
TILE = 48
#: Counts that a task holds before it hands them over.
PARTIAL = 400_000
_SCALE = 1_000_000_000

_TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
_LOWER = {c: c + 32 for c in range(65, 91)}
#: Text that is split into terms at a time.
_PIECE = 1 << 20

_COUNTS = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("docs", pa.int64())])


def _terms(text: str) -> Iterator[list[str]]:
    """The terms of a text, a bounded part of it at a time."""
    at = 0
    while at < len(text):
        end = at + _PIECE
        if end < len(text):     # not within a term
            inside = _TERM.match(text, end)
            end = inside.end() if inside else end
        yield _TERM.findall(text[at:end].translate(_LOWER))
        at = end


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Occurrences of terms by group, and the documents they are in."""
    groups: dict[tuple[str, str], tuple[Counter, Counter]] = {}
    held = 0

    def hand_over():
        for (lang, source), (n, docs) in groups.items():
            terms = list(n)
            yield pa.RecordBatch.from_arrays([
                pa.array([lang] * len(terms), pa.string()), pa.array([source] * len(terms), pa.string()), pa.array(terms, pa.string()),
                pa.array(n.values(), pa.int64()), pa.array([docs[t] for t in terms], pa.int64())], schema=_COUNTS)
        groups.clear()

    for batch in batches:
        text, lang, source = (batch.column(batch.schema.names.index(c)) for c in ("text", "lang", "source"))
        for i in range(batch.num_rows):
            n, docs = groups.setdefault((lang[i].as_py(), source[i].as_py()), (Counter(), Counter()))
            held -= len(n)
            found: set[str] = set()
            for terms in _terms(text[i].as_py()):
                n.update(terms)
                found.update(terms)
            docs.update(found)
            held += len(n)
            if held >= PARTIAL:
                yield from hand_over()
                held = 0
        give_back()
    yield from hand_over()


def term_counts(docs: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """Kept terms with a count: (lang, source, term, n, n_lang, first), n_lang being the term's
    count in the language and first true on one row of each (lang, term)."""
    slim = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("text", "lang", "source")))
    term = Window.partitionBy("lang", "term")
    return slim.mapInArrow(_count, "lang string, source string, term string, n long, docs long") \
        .repartition("lang", "term").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")) \
        .withColumn("in_docs", F.sum("docs").over(term)).filter(F.col("in_docs") >= min_docs) \
        .select("lang", "source", "term", "n", F.sum("n").over(term).alias("n_lang"),
                (F.row_number().over(term.orderBy("source")) == 1).alias("first"))


# ------------------------------------------------------------------ trees of a block
def shares(counts: np.ndarray, total: np.ndarray) -> np.ndarray:
    """``1 + floor(10^9 (count + 2) / total)``, exact for counts of any size."""
    if len(counts) and int(counts.max()) > 9_000_000_000:
        return np.array([1 + _SCALE * (int(c) + 2) // int(t) for c, t in zip(counts, np.broadcast_to(total, counts.shape))], dtype=np.int64)
    return 1 + _SCALE * (counts + 2) // total


class Trees:
    """Segment trees of the rows of ``counts`` (groups x places), equal subtrees held once."""

    def __init__(self, counts: np.ndarray):
        width = counts.shape[1]
        padded = np.full((len(counts), 1 << max(0, width - 1).bit_length()), -1, dtype=np.int64)     # -1: no term
        padded[:, :width] = counts
        self.leaves, nodes = np.unique(padded, return_inverse=True)
        nodes = nodes.reshape(padded.shape)
        #: Children of the nodes of each level above the leaves.
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []
        while nodes.shape[1] > 1:
            size = int(nodes.max()) + 1
            pairs, inverse = np.unique(nodes[:, 0::2] * size + nodes[:, 1::2], return_inverse=True)
            self.levels.append((pairs // size, pairs % size))
            nodes = inverse.reshape(len(counts), -1)
        self.roots = nodes[:, 0]

    def differences(self, one: int, others: np.ndarray, totals: np.ndarray) -> np.ndarray:
        """Sum of the differences of group ``one`` and each of ``others``. ``totals`` is N + 2V by group."""
        group, a, b = np.arange(len(others)), np.full(len(others), self.roots[one]), self.roots[others]
        steps: list[np.ndarray] = []
        for left, right in reversed(self.levels):
            group = np.concatenate((group, group))
            a, b = np.concatenate((left[a], right[a])), np.concatenate((left[b], right[b]))
            size = max(int(a.max()), int(b.max())) + 1
            keys, inverse = np.unique((group * size + a) * size + b, return_inverse=True)     # each pair once
            steps.append(inverse.reshape(-1))
            group, a, b = keys // (size * size), keys // size % size, keys % size
        ca, cb = self.leaves[a], self.leaves[b]
        p, q = shares(np.maximum(ca, 0), totals[one]), shares(np.maximum(cb, 0), totals[others[group]])
        value = np.where(ca < 0, 0, (p - q) ** 2 // (p + q))
        for inverse in reversed(steps):
            value = value[inverse].reshape(2, -1).sum(axis=0)
        return value


_PAIRS = pa.schema([("lang", pa.string()), ("a", pa.string()), ("b", pa.string()), ("value", pa.int64())])


def _compare(table: pa.Table) -> pa.Table:
    """All pairs of sources of two tiles over a block. Rows without a place are the sources
    (``n`` their N, ``size`` their language's V, ``width`` the block's terms)."""
    lang, ta, tb = (table.column(c)[0].as_py() for c in ("lang", "ta", "tb"))
    place = table.column("place").to_numpy()
    heads = table.filter(pa.array(place < 0))
    names = heads.column("source").to_pylist()
    tile = heads.column("tile").to_numpy()
    width = int(heads.column("width")[0].as_py())
    totals = heads.column("n").to_numpy() + 2 * heads.column("size").to_numpy()
    at = {s: i for i, s in enumerate(names)}
    rows = table.filter(pa.array(place >= 0))
    counts = np.zeros((len(names), width), dtype=np.int64)
    counts[np.array([at[s] for s in rows.column("source").to_pylist()], dtype=np.int64), rows.column("place").to_numpy()] = rows.column("n").to_numpy()
    trees = Trees(counts) if width else None
    found: list[tuple[str, str, int]] = []
    second = np.flatnonzero(tile == tb)
    for one in np.flatnonzero(tile == ta):
        others = second[second > one] if ta == tb else second
        if len(others):
            value = trees.differences(one, others, totals) if width else np.zeros(len(others), np.int64)
            found += [(names[one], names[o], v) for o, v in zip(others.tolist(), value.tolist())]
    return pa.table([pa.array([lang] * len(found), pa.string()), pa.array([f[0] for f in found], pa.string()),
                     pa.array([f[1] for f in found], pa.string()), pa.array([f[2] for f in found], pa.int64())], schema=_PAIRS)


# ------------------------------------------------------------------ the audit
def _share(n: Column, total: Column, size: Column) -> Column:
    return F.call_function("div", F.lit(_SCALE).cast("decimal(38,0)") * (n + 2), total + 2 * size) + 1


def audit(docs: DataFrame, min_docs: int = MIN_DOCS, top_terms: int = TOP_TERMS, block: int = BLOCK, tile: int = TILE) -> DataFrame:
    """(lang, source, part, item, value, rank): part ``pair`` sums the differences to every other
    source of the language; part ``term`` has the terms that a source uses most above its language."""
    kept = written(term_counts(docs, min_docs), "term-counts")
    langs = kept.groupBy("lang").agg(F.sum("n").alias("total"), F.count_if("first").alias("size"))
    present = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source"))).distinct()
    groups = present.join(kept.groupBy("lang", "source").agg(F.sum("n").alias("n")), ["lang", "source"], "left") \
        .join(langs, "lang", "left").fillna(0, ["n", "total", "size"])
    tiles = groups.groupBy("lang").agg(F.ceil(F.count(F.lit(1)) / tile).cast("int").alias("tiles"))
    groups = written(groups.join(tiles, "lang").withColumn("tile", F.pmod(F.xxhash64("source"), "tiles").cast("int")), "groups")
    pair = _pair_values(kept, groups, block)
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item"))
    term = kept.join(groups.select("lang", "source", F.col("n").alias("own"), "total", "size"), ["lang", "source"]) \
        .withColumn("p", _share(F.col("n"), F.col("own"), F.col("size"))) \
        .withColumn("q", _share(F.col("n_lang"), F.col("total"), F.col("size"))).filter("p > q") \
        .select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), F.expr("((p - q) * (p - q)) div (p + q)").alias("value")) \
        .withColumn("rank", rank).filter(F.col("rank") <= top_terms)
    return pair.select("lang", "source", F.lit("pair").alias("part"), "item", "value").withColumn("rank", rank).unionByName(term)


def _pair_values(kept: DataFrame, groups: DataFrame, block: int) -> DataFrame:
    """(lang, source, item, value) of every two sources of a language, both ways."""
    langs = groups.groupBy("lang").agg(F.greatest(F.ceil(F.max("size") / block), F.lit(1)).cast("int").alias("blocks"))
    placed = kept.join(langs, "lang").withColumn("block", F.pmod(F.xxhash64("term"), "blocks").cast("int"))
    by_block = Window.partitionBy("lang", "block")
    placed = placed.withColumn("place", (F.dense_rank().over(by_block.orderBy(F.col("n_lang").desc(), "term")) - 1).cast("int"))
    placed = written(placed.select("lang", "block", "source", "place", "n", "first"), "placed")
    widths = placed.filter("first").groupBy("lang", "block").agg(F.count(F.lit(1)).alias("width"))
    heads = langs.select("lang", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block")) \
        .join(widths, ["lang", "block"], "left").fillna(0, ["width"]) \
        .join(groups.select("lang", "source", "n", "size", "tile", "tiles"), "lang").withColumn("place", F.lit(-1))
    rows = placed.join(groups.select("lang", "source", "tile", "tiles"), ["lang", "source"]) \
        .withColumn("width", F.lit(0).cast("long")).withColumn("size", F.lit(0).cast("long"))
    columns = ["lang", "block", "source", "place", "n", "width", "size", "tile", "tiles"]
    # a source meets every tile of its language: as the first tile of the two, or as the second
    met = heads.select(columns).unionByName(rows.select(columns)) \
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))) \
        .withColumn("ta", F.least("tile", "other")).withColumn("tb", F.greatest("tile", "other"))
    values = met.groupBy("lang", "block", "ta", "tb").applyInArrow(_compare, "lang string, a string, b string, value long") \
        .groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    return values.select("lang", F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")),
                                                   F.struct(F.col("b").alias("source"), F.col("a").alias("item")))).alias("s"), "value") \
        .select("lang", "s.source", "s.item", "value")
