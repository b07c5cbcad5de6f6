"""Exact repeated substrings by merging Burrows-Wheeler transforms.

Every string of ``length`` bytes has one minimizer (the least-hashed of its 32-byte
pieces, leftmost on ties), so equal strings have equal minimizers.

1. Scan: each text is cut into stretches of consecutive strings with one minimizer. A
   stretch is a row of hashes and a place; a task keeps the first of equal stretches.
2. Rows meet by minimizer: equal stretches but the first are removed whole; different
   stretches of one minimizer go on. Minimizers with very many different stretches
   (passages that a large part of all documents share) go on string by string, keyed by
   the string, so that no minimizer's stretches have to fit one task.
3. Stretches of one minimizer are indexed together: each shard of them gets its
   Burrows-Wheeler transform, and the shards' transforms are merged by refining their
   interleave, one more leading byte a round, without sorting suffixes across shards.
   Round t leaves the intervals of rows that share t bytes; rows that share no more with any
   other are finished and not moved again. After ``length`` rounds the intervals that are
   left are the repeated strings. All but the first place are removed. (``merge_bwts`` moves
   all rows, and so gives their whole order and all common prefixes.)

Step 3 compares bytes; step 2 trusts two 64-bit hashes.

Edge cases: null is an empty text; texts shorter than ``length`` keep all bytes; repeated
rows are texts of their own, the later ones copies; ids that repeat or are null are numbered
apart, in id order, nulls last. Other columns are not touched.
"""
from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import (Chunk, RollingHash, fresh_name, list_parts, mix, numbers, read_all, shuffle_partitions, suffix_array,
                     text_chunks, with_row_ids, written)

LENGTH = 100
PIECE = 32
#: Different stretches of one minimizer in one scan task, and in all, beyond which they go on string by string.
TASK_STRETCHES = 64
ALL_STRETCHES = 4096
#: Bytes indexed together, and bytes of a shard of them.
INDEX_BYTES = 1 << 20
SHARD_BYTES = 1 << 18

_U = np.uint64
_HOT = 128


# ------------------------------------------------------------------ stretches
def stretches(chunk: Chunk, length: int) -> tuple[np.ndarray, ...]:
    """(row, start in the row, strings, minimizer hash, content hash) of the stretches of a chunk."""
    data, off = chunk.data, chunk.offsets
    none = np.empty(0, np.int64)
    if len(data) < length:
        return none, none, none, none.astype(_U), none.astype(_U)
    rolling = RollingHash(data)
    pieces = rolling.windows(PIECE)
    low = (pieces & _U(0xFFFFFFFF00000000)) | np.arange(len(pieces), dtype=_U)
    span, width = length - PIECE + 1, 1
    while 2 * width <= span:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    if width < span:
        low = np.minimum(low[:len(low) - (span - width)], low[span - width:])
    at = (low & _U(0xFFFFFFFF)).astype(np.int64)
    whole = np.arange(len(at)) + length <= np.repeat(off[1:], np.diff(off))[:len(at)]
    valid = np.flatnonzero(whole)
    if not len(valid):
        return none, none, none, none.astype(_U), none.astype(_U)
    where = at[valid]
    heads = np.flatnonzero(np.concatenate(([True], (valid[1:] != valid[:-1] + 1) | (where[1:] != where[:-1]))))
    n = np.diff(np.append(heads, len(valid)))
    start = valid[heads]
    row = np.searchsorted(off, start, side="right") - 1
    return row, start - off[row], n, pieces[where[heads]], rolling.ranges(start, start + n + length - 1)


def merge_spans(rid: np.ndarray, s: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Union of byte ranges of each row id; ranges that touch become one."""
    if not len(rid):
        return rid, s, e
    o = np.lexsort((s, rid))
    rid, s, e = rid[o], s[o], e[o]
    # running maximum of the ends within a row id
    group = np.cumsum(np.concatenate(([False], rid[1:] != rid[:-1])))
    width = int(e.max()) + 1
    reach = np.maximum.accumulate(group * width + e) - group * width
    new = np.concatenate(([True], (rid[1:] != rid[:-1]) | (s[1:] > reach[:-1])))
    heads = np.flatnonzero(new)
    return rid[heads], s[heads], np.maximum.reduceat(e, heads)


def _first_of(keys: tuple[np.ndarray, ...], rid: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order by keys, then place; which of the ordered rows are the first with their keys."""
    order = np.lexsort((start, rid, *keys[::-1]))
    first = np.zeros(len(order), dtype=bool)
    if len(order):
        first[0] = True
        for k in keys:
            first[1:] |= k[order][1:] != k[order][:-1]
    return order, first


_ROWS = pa.schema([("key", pa.int64()), ("content", pa.int64()), ("rid", pa.int64()), ("place", pa.int64())])
_ROWS_DDL = "key long, content long, rid long, place long"


def _rows(key, content, rid, place) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.asarray(x).astype(np.int64, copy=False)) for x in (key, content, rid, place)], schema=_ROWS)


def _scan(length: int, task_limit: int):
    """Rows of stretches. place is start * 256 + strings (+ 128: to go on string by string);
    strings 0 is a removed range, its bytes in ``content``, or with rid -1 the mark of a
    minimizer that some task found to have very many stretches."""
    def run(batches):
        parts = []
        for chunk in text_chunks(batches):
            row, start, n, key, content = stretches(chunk, length)
            parts.append((key, content, numbers(chunk.column("rid"))[row], start, n))
        if not parts:
            return
        key, content, rid, start, n = (np.concatenate(x) for x in zip(*parts))
        del parts
        order, first = _first_of((key, content), rid, start)
        again = order[~first]
        r, s, e = merge_spans(rid[again], start[again], start[again] + n[again] + length - 1)
        yield _rows(mix(r.astype(_U)), e - s, r, s * 256)
        keep = order[first]
        key, content, rid, start, n = key[keep], content[keep], rid[keep], start[keep], n[keep]
        heads = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.empty(0, np.int64)
        size = np.diff(np.append(heads, len(key)))
        hot = np.repeat(size > task_limit, size)
        yield _rows(key[heads[size > task_limit]], np.zeros(np.count_nonzero(size > task_limit)), np.full(np.count_nonzero(size > task_limit), -1), np.zeros(np.count_nonzero(size > task_limit)))
        key = np.where(hot, mix(key ^ content), key)
        for i in range(0, len(key), 100_000):
            part = slice(i, i + 100_000)
            yield _rows(key[part], content[part], rid[part], start[part] * 256 + n[part] + _HOT * hot[part])

    return run


_CANDIDATES_DDL = "rid long, start long, strings int, key long, kind int"
REMOVED, STRETCH, STRINGS = 0, 1, 2


def _meet(length: int, all_limit: int):
    """Stretches of each minimizer: removed ranges (strings: bytes), and what goes on."""
    schema = pa.schema([("rid", pa.int64()), ("start", pa.int64()), ("strings", pa.int32()), ("key", pa.int64()), ("kind", pa.int32())])

    def out(rid, start, strings, key, kind):
        return pa.RecordBatch.from_arrays([pa.array(rid, pa.int64()), pa.array(start, pa.int64()), pa.array(np.asarray(strings, np.int32)),
                                           pa.array(key, pa.int64()), pa.array(np.full(len(rid), kind, np.int32))], schema=schema)

    def run(batches):
        table = read_all(batches)
        if table is None:
            return
        key, content, rid, place = (numbers(table.column(c)) for c in _ROWS.names)
        del table
        start, n = place >> 8, place & (_HOT - 1)
        hot = (place & _HOT) > 0
        gone = np.flatnonzero((n == 0) & (rid >= 0))
        r, s, e = rid[gone], start[gone], start[gone] + content[gone]
        marked = np.unique(key[rid < 0])
        rows = np.flatnonzero(n > 0)
        key, content, rid, start, n, hot = key[rows], content[rows], rid[rows], start[rows], n[rows], hot[rows]
        order, first = _first_of((key, content), rid, start)
        again = order[~first]
        r, s, e = merge_spans(np.concatenate((r, rid[again])), np.concatenate((s, start[again])), np.concatenate((e, start[again] + n[again] + length - 1)))
        yield out(r, s, e - s, r, REMOVED)
        keep = order[first]
        key, rid, start, n, hot = key[keep], rid[keep], start[keep], n[keep], hot[keep]
        heads = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.empty(0, np.int64)
        size = np.diff(np.append(heads, len(key)))
        many = np.repeat(size, size)
        single = hot | (many > all_limit) | np.isin(key, marked)
        go = ~single & (many > 1)
        yield out(rid[go], start[go], n[go], key[go], STRETCH)
        yield out(rid[single], start[single], n[single], key[single], STRINGS)

    return run


# ------------------------------------------------------------------ strings
_STRINGS = pa.schema([("key", pa.int64()), ("rid", pa.int64()), ("start", pa.int64()), ("string", pa.binary())])
_STRINGS_DDL = "key long, rid long, start long, string binary"


def _extract(length: int):
    """Rows (rid, text, parts): the bytes of stretches, and single strings of hot stretches
    (of equal ones in a task the first; the others as removed places, without bytes)."""
    def run(batches):
        hot: list[tuple[np.ndarray, ...]] = []
        seen_text: list[bytes] = []
        for chunk in text_chunks(batches):
            off, parts = list_parts(chunk.column("parts"))
            start, n, key, kind = (numbers(parts.field(i)) for i in range(4))
            row = np.repeat(np.arange(len(chunk)), np.diff(off))
            rid = numbers(chunk.column("rid"))[row]
            begin = chunk.offsets[row] + start
            whole = chunk.data.tobytes()
            some = np.flatnonzero(kind == STRETCH)
            for i in range(0, len(some), 20_000):
                p = some[i:i + 20_000]
                yield pa.RecordBatch.from_arrays([pa.array(key[p]), pa.array(rid[p]), pa.array(start[p]),
                                                  pa.array([whole[b:b + m + length - 1] for b, m in zip(begin[p].tolist(), n[p].tolist())], pa.binary())], schema=_STRINGS)
            p = np.flatnonzero(kind == STRINGS)
            if len(p):
                step = np.arange(int(n[p].sum())) - np.repeat(np.cumsum(n[p]) - n[p], n[p])
                b = np.repeat(begin[p], n[p]) + step
                names = RollingHash(chunk.data).ranges(b, b + length)
                base = len(seen_text)
                order, first = _first_of((names,), np.repeat(rid[p], n[p]), np.repeat(start[p], n[p]) + step)
                text = np.full(len(order), -1)
                text[order[first]] = base + np.arange(np.count_nonzero(first))
                seen_text += [whole[x:x + length] for x in b[order[first]].tolist()]
                hot.append((names, np.repeat(rid[p], n[p]), np.repeat(start[p], n[p]) + step, text))
        if hot:
            names, rid, start, text = (np.concatenate(x) for x in zip(*hot))
            order, first = _first_of((names,), rid, start)
            string = np.maximum.reduceat(text[order], np.flatnonzero(first))
            head = order[first]
            for i in range(0, len(head), 20_000):
                h = head[i:i + 20_000]
                yield pa.RecordBatch.from_arrays([pa.array(names[h].astype(np.int64)), pa.array(rid[h]), pa.array(start[h]),
                                                  pa.array([seen_text[j] for j in string[i:i + 20_000]], pa.binary())], schema=_STRINGS)
            r, s, e = merge_spans(rid[order[~first]], start[order[~first]], start[order[~first]] + length)
            yield pa.RecordBatch.from_arrays([pa.array(mix(r.astype(_U)).astype(np.int64)), pa.array(r), pa.array(s),
                                              pa.array([int(x).to_bytes(8, "little") for x in e - s], pa.binary())], schema=_STRINGS)

    return run


# ------------------------------------------------------------------ Burrows-Wheeler transforms
def shard_bwt(strings: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Transform of a few strings, each with an end mark of its own, the smallest symbols in
    string order: suffix array (positions in the joined strings, marks included), preceding
    symbols (0 for none, else byte + 1), and the row of each row's preceding suffix (-1: none)."""
    joined = np.frombuffer(b"\0".join(strings) + b"\0", dtype=np.uint8)
    sizes = np.fromiter((len(s) + 1 for s in strings), np.int64, len(strings))
    marks = np.cumsum(sizes) - 1
    tokens = joined.astype(_U) + _U(1 << 32)
    tokens[marks] = np.arange(len(marks), dtype=_U)
    sa = suffix_array(tokens)
    first = np.zeros(len(joined), dtype=bool)
    first[marks + 1 - sizes] = True
    row_of = np.empty(len(sa), dtype=np.int64)
    row_of[sa] = np.arange(len(sa))
    none = first[sa]
    symbol = np.where(none, 0, joined[sa - 1].astype(np.int16) + 1)
    return sa, symbol, np.where(none, -1, row_of[sa - 1])


def merge_bwts(shards: list[tuple[np.ndarray, np.ndarray, np.ndarray]], n_marks: list[int], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Interleave of the shards' rows sorted by their first ``depth`` symbols, and the common
    prefix of each with the row before it, at most ``depth``.

    One round puts the preceding suffixes of all rows in order by one symbol more: rows are
    dealt out by preceding symbol, stably, as each shard's transform already orders its own.
    Two neighbours part in round t when their first symbols differ or what follows had parted."""
    base = np.concatenate(([0], np.cumsum([len(s[0]) for s in shards])))
    symbol = np.concatenate([s[1] for s in shards]).astype(np.uint16)
    before = np.concatenate([np.where(s[2] < 0, -1, s[2] + b) for s, b in zip(shards, base)]).astype(np.int32)
    marks = np.concatenate([np.arange(n) + b for n, b in zip(n_marks, base)]).astype(np.int32)
    n = int(base[-1])
    perm = np.arange(n, dtype=np.int32)
    lcp = np.full(n, depth, dtype=np.int32)
    block = np.zeros(n, dtype=np.int32)
    known = np.zeros(n, dtype=bool)
    for t in range(1, depth + 1):
        c = symbol[perm]
        order = np.argsort(c, kind="stable")
        order = order[len(marks):]              # rows without a preceding symbol come first
        perm = np.concatenate((marks, before[perm[order]]))
        c, b = c[order], block[order]
        part = np.ones(n, dtype=bool)
        part[len(marks) + 1:] = (c[1:] != c[:-1]) | (b[1:] != b[:-1])
        lcp[part & ~known] = t - 1
        if t > 1 and np.array_equal(part, known) and part.all():
            break
        known = part
        block = np.cumsum(part, dtype=np.int32)
    return perm, lcp


def open_intervals(shards: list[tuple[np.ndarray, np.ndarray, np.ndarray]], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(interval, row) of the shards' rows that share their first ``depth`` symbols with another row.

    The rounds of ``merge_bwts`` over the rows that are still in an interval: the preceding suffix of
    a row that shares t symbols with no other shares t + 1 with none, so it need not be looked at."""
    base = np.concatenate(([0], np.cumsum([len(s[0]) for s in shards])))
    # a row's preceding symbol and, above it, the row of its preceding suffix
    step = np.concatenate([(np.where(s[2] < 0, 0, s[2] + b) << 16) | s[1] for s, b in zip(shards, base)]).astype(np.int64)
    row = np.arange(int(base[-1]), dtype=np.int32)
    interval = np.zeros(len(row), dtype=np.int32)
    for _ in range(depth):
        if not len(row):
            break
        go = step[row]
        symbol = go.astype(np.uint16)
        order = np.argsort(symbol, kind="stable")[np.count_nonzero(symbol == 0):]      # the others have no preceding suffix
        symbol, inside = symbol[order], interval[order]
        new = np.ones(len(order) + 1, dtype=bool)
        new[1:-1] = (symbol[1:] != symbol[:-1]) | (inside[1:] != inside[:-1])
        shared = ~(new[:-1] & new[1:])
        row = (go[order[shared]] >> 16).astype(np.int32)
        interval = np.cumsum(new[:-1], dtype=np.int32)[shared]
    return interval, row


def repeated_strings(strings: list[bytes], length: int, shard_bytes: int = SHARD_BYTES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(interval, string, offset) of all substrings of ``length`` bytes that occur more than once."""
    shards, owner, offset = [], [], []
    i = 0
    while i < len(strings):
        j, size = i, 0
        while j < len(strings) and (j == i or size + len(strings[j]) <= shard_bytes):
            size += len(strings[j]) + 1
            j += 1
        shards.append(shard_bwt(strings[i:j]))
        sizes = np.fromiter((len(s) + 1 for s in strings[i:j]), np.int64, j - i)
        own = np.repeat(np.arange(j - i), sizes)
        sa = shards[-1][0]
        owner.append(own[sa] + i)
        offset.append(sa - (np.cumsum(sizes) - sizes)[own[sa]])
        i = j
    interval, rows = open_intervals(shards, length)
    return interval, np.concatenate(owner)[rows], np.concatenate(offset)[rows]


def _index(length: int, index_bytes: int, shard_bytes: int):
    """Partition of strings by key: removed ranges (rid, s, e)."""
    schema = pa.schema([("rid", pa.int64()), ("s", pa.int64()), ("e", pa.int64())])

    def run(batches):
        table = read_all(batches)
        if table is None:
            return
        key, rid, start = (numbers(table.column(c)) for c in ("key", "rid", "start"))
        strings = table.column("string").to_pylist()
        size = np.fromiter(map(len, strings), np.int64, len(strings))
        del table
        gone = np.flatnonzero(size == 8)
        out = [(rid[gone], start[gone], start[gone] + np.fromiter((int.from_bytes(strings[i], "little") for i in gone), np.int64, len(gone)))]
        rows = np.flatnonzero(size >= length)
        order = rows[np.argsort(key[rows], kind="stable")]
        k = key[order]
        same = np.concatenate(([False], k[1:] == k[:-1])) if len(k) else np.empty(0, bool)
        order = order[same | np.append(same[1:], False)]         # keys of one string repeat nothing
        k = key[order]
        heads = np.append(np.flatnonzero(np.concatenate(([True], k[1:] != k[:-1]))), len(k)) if len(k) else np.zeros(1, np.int64)
        total = np.concatenate(([0], np.cumsum(size[order] + 1)))
        i = 0
        while i < len(heads) - 1:
            j = int(np.searchsorted(total[heads], total[heads[i]] + index_bytes, side="right")) - 1
            j = min(len(heads) - 1, max(i + 1, j))
            rows = order[heads[i]:heads[j]]
            interval, own, offset = repeated_strings([strings[x] for x in rows], length, shard_bytes)
            r, s = rid[rows][own], start[rows][own] + offset
            o, first = _first_of((interval,), r, s)
            out.append((r[o[~first]], s[o[~first]], s[o[~first]] + length))
            i = j
        r, s, e = merge_spans(*(np.concatenate(x) for x in zip(*out)))
        yield pa.RecordBatch.from_arrays([pa.array(r), pa.array(s), pa.array(e)], schema=schema)

    return run


# ------------------------------------------------------------------ results
def _merged(chunk: Chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    spans = chunk.column("spans")
    empty = np.asarray(spans.is_null())
    lengths = np.where(empty, 0, np.asarray(spans.value_lengths().fill_null(0)))
    values = spans.flatten()
    row = np.repeat(np.arange(len(chunk)), lengths)
    return merge_spans(row, numbers(values.field(0)), numbers(values.field(1)))


def _kept(chunk: Chunk, row: np.ndarray, s: np.ndarray, e: np.ndarray):
    """Remaining bytes of each row, with its removed ranges."""
    cut = np.searchsorted(row, np.arange(len(chunk) + 1))
    for i in range(len(chunk)):
        text = chunk.text(i)
        a, b = s[cut[i]:cut[i + 1]].tolist(), e[cut[i]:cut[i + 1]].tolist()
        yield b"".join(text[x:y] for x, y in zip([0, *b], [*a, len(text)])), a, b


def _digest(batches):
    schema = pa.schema([("rid", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()),
                        ("kept_sha256", pa.string()), ("spans", pa.list_(pa.int64()))])
    for chunk in text_chunks(batches):
        n = np.diff(chunk.offsets)
        hashes, spans, removed = [], [], []
        for kept, a, b in _kept(chunk, *_merged(chunk)):
            hashes.append(hashlib.sha256(kept).hexdigest())
            spans.append([x for ab in zip(a, b) for x in ab])
            removed.append(sum(b) - sum(a))
        yield pa.RecordBatch.from_arrays([chunk.column("rid"), pa.array(n, pa.int64()), pa.array(removed, pa.int64()),
                                          pa.array([len(x) // 2 for x in spans], pa.int64()), pa.array(hashes), pa.array(spans, pa.list_(pa.int64()))], schema=schema)


def removed_spans(texts: DataFrame, length: int = LENGTH, task_stretches: int = TASK_STRETCHES, all_stretches: int = ALL_STRETCHES,
                  index_bytes: int = INDEX_BYTES, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Byte ranges (rid, s, e) of ``texts`` (rid unique, text) that strings of ``length`` bytes
    cover which also start earlier."""
    n = shuffle_partitions(texts.sparkSession)
    rows = texts.mapInArrow(_scan(length, task_stretches), _ROWS_DDL).repartition(4 * n, "key")
    found = written(rows.mapInArrow(_meet(length, all_stretches), _CANDIDATES_DDL), "stretches")
    parts = found.filter(F.col("kind") != REMOVED).groupBy("rid").agg(F.collect_list(F.struct("start", "strings", "key", "kind")).alias("parts"))
    strings = texts.join(parts.hint("shuffle_hash"), "rid").select("rid", "text", "parts").mapInArrow(_extract(length), _STRINGS_DDL)
    indexed = written(strings.repartition(4 * n, "key").mapInArrow(_index(length, index_bytes, shard_bytes), "rid long, s long, e long"), "repeats")
    whole = found.filter(F.col("kind") == REMOVED).select("rid", F.col("start").alias("s"), (F.col("start") + F.col("strings")).alias("e"))
    return whole.unionByName(indexed)


def repeated_bytes(docs: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """Row of ``docs`` by row: ``id_col``, n_bytes, n_removed, n_spans, kept_sha256 and spans
    (maximal removed byte ranges, flattened)."""
    named = with_row_ids(docs.select(F.col(id_col).alias("id"), "text"), "id", "rid")
    texts = named.select("rid", "text")
    spans = removed_spans(texts, **options).groupBy("rid").agg(F.collect_list(F.struct("s", "e")).alias("spans"))
    out = texts.join(spans.hint("shuffle_hash"), "rid", "left").select("rid", "text", "spans") \
        .mapInArrow(_digest, "rid long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<long>")
    if named.schema["id"].dataType == named.schema["rid"].dataType and not _renumbered(named):
        return out.withColumnRenamed("rid", id_col)
    return out.join(named.select("rid", "id"), "rid").drop("rid").withColumnRenamed("id", id_col)


def _renumbered(named: DataFrame) -> bool:
    """Whether some row number is not the row's id."""
    return bool(named.filter(~F.col("id").eqNullSafe(F.col("rid"))).limit(1).collect())


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """``docs`` without the repeated bytes (bytes that then are no UTF-8 are dropped); the same columns."""
    row = fresh_name(docs, "row_id")
    spans_name = "spans"
    named = with_row_ids(docs, id_col, row)
    spans = removed_spans(named.select(F.col(row).alias("rid"), "text"), **options) \
        .groupBy("rid").agg(F.collect_list(F.struct("s", "e")).alias(spans_name))

    def cut(batches):
        for chunk in text_chunks(batches):
            kept = [t.decode("utf-8", "ignore") for t, _, _ in _kept(chunk, *_merged(chunk))]
            yield pa.RecordBatch.from_arrays([chunk.column("rid"), pa.array([t if v else None for t, v in zip(kept, chunk.valid)], pa.string())], names=["rid", "text"])

    texts = named.select(F.col(row).alias("rid"), "text").join(spans, "rid", "left").select("rid", "text", spans_name).mapInArrow(cut, "rid long, text string")
    new = fresh_name(named, "new_text")
    joined = named.join(texts.select(F.col("rid").alias(row), F.col("text").alias(new)), row)
    return joined.select(*[F.col(new).alias(c) if c == "text" else F.col(c) for c in docs.columns])
