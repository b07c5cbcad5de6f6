"""Benchmark decontamination with suffix arrays over the training words.

Every shard (a run of whole documents) gets a word-level suffix array by prefix
doubling. The suffixes of every benchmark item that begin with a whole window are
binary-searched in it, distinct windows once: one pair of searches gives the range of
training suffixes that begin with the window (all its locations). Longest verbatim matches
of all suffixes are given by ``longest_matches`` alone, which no query calls. Documents never leave their
scan task: there is no shuffle, and a passage shared by a third of all documents is
found once per shard as one range.

Edge cases: a null or wordless text has no words and no hits; a null or wordless
item has no windows; an item of fewer words than the window is one window; an item
with a null id marks words but is not listed; repeated item ids count once; repeated
document rows are judged row by row; ids may be of any type that can be ordered. Other columns
are not touched.
"""
from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ALNUM_WORDS, find_words, fresh_name, list_array, segment_sums, suffix_array, text_chunks, with_row_ids, word_hashes

WINDOW = 13
SHARD_BYTES = 2 << 20
#: Benchmark text per broadcast, and broadcasts in one pass over the documents.
BLOCK_BYTES = 8 << 20
BLOCKS_PER_PASS = 8

_U = np.uint64


@dataclass
class Block:
    """Benchmark items as word hashes: ``tokens[first[i]:first[i] + length[i]]`` is suffix i's
    window. Equal windows stand once."""
    tokens: np.ndarray
    first: np.ndarray
    length: np.ndarray
    item_offsets: np.ndarray     # items of each window, flattened
    items: np.ndarray            # indices in item_ids
    item_ids: list
    owner: np.ndarray            # item of each token
    word: np.ndarray             # its position in the item
    left: np.ndarray             # words from it to the item's end

    def fields(self) -> tuple:
        """For a broadcast, which takes no classes that executors do not have."""
        return tuple(self.__dict__.values())


def compare(shard: np.ndarray, at: np.ndarray, block: Block, first: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sign of (training suffix - test suffix) over ``length`` words, and the words they share."""
    sign = np.zeros(len(at), dtype=np.int8)
    shared = np.zeros(len(at), dtype=np.int64)
    live = np.flatnonzero(length > 0)
    j = 0
    while len(live):
        pos = at[live] + j
        over = pos >= len(shard)
        a = shard[np.minimum(pos, max(len(shard) - 1, 0))]
        b = block.tokens[first[live] + j]
        less = over | (a < b)
        sign[live[less]] = -1
        sign[live[~over & (a > b)]] = 1
        live = live[~over & (a == b)]
        j += 1
        shared[live] = j
        live = live[length[live] > j]
    return sign, shared


def search(shard: np.ndarray, sa: np.ndarray, block: Block, first: np.ndarray, length: np.ndarray, upper: bool) -> np.ndarray:
    """Binary search of all test suffixes at once: the first training suffix that is not
    below (``upper``: that is above) each test suffix's first ``length`` words."""
    lo = np.zeros(len(first), dtype=np.int64)
    hi = np.full(len(first), len(sa), dtype=np.int64)
    while True:
        live = np.flatnonzero(lo < hi)
        if not len(live):
            return lo
        mid = (lo[live] + hi[live]) // 2
        sign, _ = compare(shard, sa[mid], block, first[live], length[live])
        right = sign <= 0 if upper else sign < 0
        lo[live[right]] = mid[right] + 1
        hi[live[~right]] = mid[~right]


def make_block(table: pa.Table, window: int) -> Block:
    """Word hashes, distinct windows and their items of a part of the benchmark."""
    batch = table.combine_chunks().to_batches()
    ids, pieces, owners = [], [], []
    for chunk in text_chunks(iter(batch), chunk_bytes=1 << 20):
        w = find_words(chunk, ALNUM_WORDS)
        base = len(ids)
        ids += chunk.column("item_id").to_pylist()
        pieces.append(w.hashes)
        owners.append(w.doc + base)
    tokens = np.concatenate(pieces) if pieces else np.empty(0, _U)
    owner = np.concatenate(owners).astype(np.int64) if owners else np.empty(0, np.int64)
    n_words = np.bincount(owner, minlength=len(ids)) if len(ids) else np.empty(0, np.int64)
    ends = np.cumsum(n_words)
    rest = ends[owner] - np.arange(len(tokens))
    begins = ends[owner] - n_words[owner]
    whole = np.minimum(n_words[owner], window)
    first = np.flatnonzero((rest >= window) | (np.arange(len(tokens)) == begins))
    length = whole[first]
    # equal windows stand once: 0 pads windows shorter than the longest
    rows = np.zeros((len(first), window + 1), dtype=_U)
    rows[:, 0] = length
    for j in range(window):
        has = length > j
        rows[has, j + 1] = tokens[first[has] + j]
    _, lead, inverse = np.unique(rows, axis=0, return_index=True, return_inverse=True) if len(first) else (rows, np.empty(0, np.int64), np.empty(0, np.int64))
    links = np.unique(np.stack([inverse.reshape(-1), owner[first]], axis=1), axis=0) if len(first) else np.empty((0, 2), np.int64)
    offsets = np.searchsorted(links[:, 0], np.arange(len(lead) + 1))
    return Block(tokens, first[lead], length[lead], offsets, links[:, 1], [None if i is None else str(i) for i in ids],
                 owner, np.arange(len(tokens)) - begins, rest)


def _shards(batches: Iterator[pa.RecordBatch], shard_bytes: int):
    """(chunk, words of each document, token sequence with a separator of its own after each
    document, position of each document's first token)."""
    for chunk in text_chunks(batches, chunk_bytes=shard_bytes):
        hashes, offsets = word_hashes(chunk, ALNUM_WORDS)
        rows = np.arange(len(chunk))
        tokens = np.empty(len(hashes) + len(chunk), dtype=_U)
        tokens[np.arange(len(hashes)) + np.repeat(rows, np.diff(offsets))] = hashes
        tokens[offsets[1:] + rows] = rows
        yield chunk, np.diff(offsets), tokens, offsets[:-1] + rows


def occurrences(tokens: np.ndarray, sa: np.ndarray, block: Block) -> tuple[np.ndarray, np.ndarray]:
    """All (window, token position) of the block's windows in a shard."""
    lo = search(tokens, sa, block, block.first, block.length, upper=False)
    hi = search(tokens, sa, block, block.first, block.length, upper=True)
    count = hi - lo
    window = np.repeat(np.arange(len(lo)), count)
    place = np.arange(len(window)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(lo, count)
    return window, sa[place]


def _hits(blocks: list, shard_bytes: int, batches):
    """Per shard: chunk, its numbers of words, hit word ranges (offsets by row, flattened) and items of each row."""
    for chunk, n_words, tokens, heads in _shards(batches, shard_bytes):
        sa = suffix_array(tokens)
        cover = np.zeros(len(tokens) + 1, dtype=np.int64)
        found = [np.empty((0, 2), np.int64)]
        names: list[str | None] = []
        for b in blocks:
            block = Block(*b.value)
            window, pos = occurrences(tokens, sa, block)
            cover += np.bincount(pos, minlength=len(cover)) - np.bincount(pos + block.length[window], minlength=len(cover))
            n_windows = max(len(block.first), 1)
            pairs = np.unique((np.searchsorted(heads, pos, side="right") - 1) * n_windows + window)
            doc, window = pairs // n_windows, pairs % n_windows
            n = block.item_offsets[window + 1] - block.item_offsets[window]
            item = block.items[np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(block.item_offsets[window], n)]
            found.append(np.stack([np.repeat(doc, n), item + len(names)], axis=1))
            names += block.item_ids
        # separators are never hit, so no range runs over the end of a document
        edge = np.diff(np.concatenate(([0], (np.cumsum(cover[:-1]) > 0).astype(np.int8), [0])))
        s, e = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        doc = np.searchsorted(heads, s, side="right") - 1
        items: list[set[str]] = [set() for _ in range(len(chunk))]
        for d, i in np.concatenate(found).tolist():
            if names[i] is not None:
                items[d].add(names[i])
        yield chunk, n_words, np.searchsorted(doc, np.arange(len(chunk) + 1)), np.stack([s - heads[doc], e - heads[doc]], axis=1), items


def _scan(blocks: list, shard_bytes: int):
    """Per document row: row id, words, hit word ranges and items, for one pass of blocks."""
    schema = pa.schema([("_rid", pa.int64()), ("n_words", pa.int64()), ("spans", pa.list_(pa.int64())), ("items", pa.list_(pa.string()))])

    def run(batches):
        for chunk, n_words, offsets, spans, items in _hits(blocks, shard_bytes, batches):
            yield pa.RecordBatch.from_arrays([
                chunk.column("_rid"), pa.array(n_words, pa.int64()),
                list_array(2 * offsets, pa.array(spans.reshape(-1), pa.int64())),
                pa.array([sorted(x) for x in items], pa.list_(pa.string()))], schema=schema)

    return run


def _keep_clean(blocks: list, shard_bytes: int):
    """The rows that are not contaminated, whole."""
    def run(batches):
        for chunk, n_words, offsets, spans, _ in _hits(blocks, shard_bytes, batches):
            n_hit = segment_sums(spans[:, 1] - spans[:, 0], offsets)
            clean = ~((n_hit > 0) & (20 * n_hit >= n_words))
            yield chunk.batch.slice(chunk.first, len(chunk)).filter(pa.array(clean))

    return run


def _digest(batches):
    """Merge the passes' word ranges and items of each document row."""
    schema = pa.schema([("_rid", pa.int64()), ("n_words", pa.int64()), ("n_hit", pa.int64()), ("n_items", pa.int64()),
                        ("items_sha256", pa.string()), ("spans", pa.list_(pa.int64())), ("items", pa.list_(pa.string()))])
    empty = hashlib.sha256(b"").hexdigest()
    for batch in batches:
        rows = {k: [] for k in schema.names}
        for r in batch.to_pylist():
            merged: list[int] = []
            for s, e in sorted(zip(r["spans"][::2], r["spans"][1::2])):
                if merged and s <= merged[-1]:
                    merged[-1] = max(merged[-1], e)
                else:
                    merged += [s, e]
            items = sorted(set(r["items"]))
            rows["_rid"].append(r["_rid"])
            rows["n_words"].append(r["n_words"])
            rows["n_hit"].append(sum(merged[1::2]) - sum(merged[::2]))
            rows["n_items"].append(len(items))
            rows["items_sha256"].append(hashlib.sha256(",".join(items).encode()).hexdigest() if items else empty)
            rows["spans"].append(merged)
            rows["items"].append(items)
        yield pa.RecordBatch.from_pydict(rows, schema=schema)


def benchmark_blocks(benchmark: DataFrame, window: int, block_bytes: int) -> Iterator[Block]:
    """The benchmark in parts of about ``block_bytes`` of text, one on the driver at a time."""
    total = benchmark.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = int(total // block_bytes) + 1
    part = F.pmod(F.xxhash64("item_id", "text"), F.lit(n))
    for k in range(n):
        yield make_block(benchmark.filter(part == k).select("item_id", "text").toArrow(), window)


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", window: int = WINDOW,
                  shard_bytes: int = SHARD_BYTES, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Row of ``docs`` by row: ``id_col``, n_words, n_hit, n_items, items_sha256, spans (word
    ranges, flattened) and items. ``benchmark`` has item_id and text and is searched in
    blocks: eight broadcasts of ``block_bytes`` of text a pass, more passes beyond."""
    spark = docs.sparkSession
    whole_ids = isinstance(docs.schema[id_col].dataType, T.IntegralType)
    slim = docs.select(F.col(id_col).cast("long").alias("_rid") if whole_ids else F.lit(None).cast("long").alias("_rid"), "text")
    blocks = [spark.sparkContext.broadcast(b.fields()) for b in benchmark_blocks(benchmark, window, block_bytes)]
    passes = [blocks[k:k + BLOCKS_PER_PASS] for k in range(0, len(blocks), BLOCKS_PER_PASS)]
    result = "_rid long, n_words long, n_hit long, n_items long, items_sha256 string, spans array<long>, items array<string>"
    if len(passes) == 1 and whole_ids:
        scan = _scan(passes[0], shard_bytes)
        return slim.mapInArrow(lambda batches: _digest(scan(batches)), result).withColumnRenamed("_rid", id_col)
    named = with_row_ids(docs.select(id_col, "text"), id_col)
    merged = None
    for some in passes:
        part = named.select("_rid", "text").mapInArrow(_scan(some, shard_bytes), "_rid long, n_words long, spans array<long>, items array<string>")
        merged = part if merged is None else merged.unionByName(part)
    merged = merged.groupBy("_rid").agg(F.max("n_words").alias("n_words"), F.flatten(F.collect_list("spans")).alias("spans"),
                                        F.flatten(F.collect_list("items")).alias("items"))
    return merged.mapInArrow(_digest, result).join(named.select(id_col, "_rid"), "_rid").drop("_rid")


def is_contaminated() -> F.Column:
    """A hit, and at least a twentieth of the words hit."""
    return (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", window: int = WINDOW,
                        shard_bytes: int = SHARD_BYTES, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``docs`` without the contaminated rows; the same columns. One pass over the
    documents where the benchmark fits one, else row numbers and an anti-join."""
    blocks = [docs.sparkSession.sparkContext.broadcast(b.fields()) for b in benchmark_blocks(benchmark, window, block_bytes)]
    if len(blocks) <= BLOCKS_PER_PASS:
        return docs.mapInArrow(_keep_clean(blocks, shard_bytes), docs.schema)
    row = fresh_name(docs, "row_id")
    named = with_row_ids(docs, id_col, row)
    bad = contamination(named, benchmark, row, window, shard_bytes, block_bytes).filter(is_contaminated())
    return named.join(bad.select(row), row, "left_anti").select(*docs.columns)


def longest_matches(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", window: int = WINDOW,
                    shard_bytes: int = SHARD_BYTES, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """For every test suffix (item_id, word): the longest verbatim match in any shard
    (n_words) and its place (document id, word position); ties to the smallest place."""
    spark = docs.sparkSession
    schema = pa.schema([("item_id", pa.string()), ("word", pa.int64()), ("n_words", pa.int64()), ("doc", pa.int64()), ("position", pa.int64())])

    def scan(b):
        def run(batches):
            block = Block(*b.value)
            for chunk, _, tokens, heads in _shards(batches, shard_bytes):
                if not len(tokens) or not len(block.tokens):
                    continue
                sa = suffix_array(tokens)
                ids = chunk.column("_rid").to_pylist()
                first = np.arange(len(block.tokens))
                place = search(tokens, sa, block, first, block.left, upper=False)
                best, where = np.zeros(len(first), np.int64), np.zeros(len(first), np.int64)
                for near in (place - 1, place):
                    ok = np.flatnonzero((near >= 0) & (near < len(sa)))
                    _, shared = compare(tokens, sa[near[ok]], block, first[ok], block.left[ok])
                    more = shared > best[ok]
                    best[ok[more]], where[ok[more]] = shared[more], sa[near[ok[more]]]
                keep = np.flatnonzero(best > 0)
                doc = np.searchsorted(heads, where[keep], side="right") - 1
                yield pa.RecordBatch.from_arrays([
                    pa.array([block.item_ids[i] for i in block.owner[keep]], pa.string()), pa.array(block.word[keep], pa.int64()),
                    pa.array(best[keep], pa.int64()), pa.array([ids[d] for d in doc], pa.int64()), pa.array(where[keep] - heads[doc], pa.int64())], schema=schema)
        return run

    out = None
    for block in benchmark_blocks(benchmark, window, block_bytes):
        part = docs.select(F.col(id_col).alias("_rid"), "text").mapInArrow(
            scan(spark.sparkContext.broadcast(block.fields())), "item_id string, word long, n_words long, doc long, position long")
        out = part if out is None else out.unionByName(part)
    key = F.struct((-F.col("n_words")).alias("l"), F.col("doc").alias("d"), F.col("position").alias("p"))
    return out.groupBy("item_id", "word").agg(F.min(key).alias("b")).select(
        "item_id", "word", (-F.col("b.l")).alias("n_words"), F.col("b.d").alias(id_col), F.col("b.p").alias("position"))
