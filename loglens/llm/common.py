"""Shared helpers of the training-data operators.

* ``text_chunks`` / ``read_all``: Arrow batches to numpy, a bounded number of text bytes at a time.
* ``RollingHash``: 64-bit hashes of arbitrary byte ranges of a chunk, from one prefix sum.
* ``find_words``: words of every text of a chunk, with hashes, without a Python loop.
* ``components``: connected components as joins and grouped minima, lineage cut in the shared folder.
* ``with_row_ids``: unique row numbers that keep the order of an id column.

Hashes only stand for equality of strings of one job; 64 bits, mixed.
"""
from __future__ import annotations

import contextlib
import ctypes
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import scratch_path

#: Text that is worked on at a time; arrays of 8 bytes a byte of it are held, several at once.
CHUNK_BYTES = 1 << 19

_U = np.uint64
_MULT = 0x9E3779B97F4A7C15 | 1


def mix(x: np.ndarray) -> np.ndarray:
    """Finalizer: spreads every input bit over the 64 output bits."""
    x = x ^ (x >> _U(32))
    x = x * _U(0xD6E8FEB86659FD93)
    x = x ^ (x >> _U(32))
    x = x * _U(0xD6E8FEB86659FD93)
    return x ^ (x >> _U(32))


_BYTE_CODE = mix(np.arange(1, 257, dtype=_U) * _U(_MULT))
_INVERSE = pow(_MULT, -1, 1 << 64)


class _Cache(dict):
    """Filled again where it is used; sent to tasks empty."""

    def __reduce__(self):
        return dict, ()


_POWERS: dict[str, np.ndarray] = _Cache()


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POWERS or len(_POWERS["up"]) < n:
        size = max(n, CHUNK_BYTES + 4096)
        for name, base in (("up", _MULT), ("down", _INVERSE)):
            steps = np.full(size, base & (2**64 - 1), dtype=_U)
            steps[0] = 1
            _POWERS[name] = np.multiply.accumulate(steps)
    return _POWERS["up"], _POWERS["down"]


class RollingHash:
    """Hash of bytes ``[s, e)`` of ``data`` for any arrays of starts and ends."""

    def __init__(self, data: np.ndarray, codes: np.ndarray = _BYTE_CODE):
        up, self.down = _powers(len(data) + 1)
        self.sums = np.empty(len(data) + 1, dtype=_U)
        self.sums[0] = 0
        np.cumsum(codes[data] * up[:len(data)], out=self.sums[1:])

    def ranges(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.down[start])

    def windows(self, length: int) -> np.ndarray:
        """Hash of every window of ``length`` bytes, by start."""
        n = len(self.sums) - length
        if n <= 0:
            return np.empty(0, dtype=_U)
        return mix((self.sums[length:] - self.sums[:n]) * self.down[:n])


def packed_order(keys: np.ndarray) -> np.ndarray:
    """Sorting permutation of 64-bit keys: sorts the keys' high bits packed with their
    index, then checks that the whole keys came out in order."""
    n = len(keys)
    low = _U((1 << max(1, (n - 1).bit_length())) - 1)
    packed = (keys & ~low) | np.arange(n, dtype=_U)
    packed.sort()
    order = (packed & low).astype(np.int64)
    got = keys[order]
    return order if bool(np.all(got[1:] >= got[:-1])) else np.argsort(keys, kind="stable")


def suffix_array(tokens: np.ndarray) -> np.ndarray:
    """Suffix array of a sequence of 64-bit tokens by prefix doubling; only suffixes
    that are still tied are sorted again."""
    n = len(tokens)
    if n < 2:
        return np.arange(n, dtype=np.int64)
    sa = packed_order(tokens)
    rank = np.empty(n, dtype=np.int64)
    slots = np.arange(n, dtype=np.int64)

    def regroup(where: np.ndarray, changed: np.ndarray) -> np.ndarray:
        """Ranks (first slot of each group) of ``sa[where]``; the slots still tied."""
        heads = np.flatnonzero(changed)
        size = np.diff(np.append(heads, len(where)))
        rank[sa[where]] = np.repeat(where[heads], size)
        return where[np.repeat(size > 1, size)]

    ordered = tokens[sa]
    tied = regroup(slots, np.concatenate(([True], ordered[1:] != ordered[:-1])))
    bits = n.bit_length()
    h = 1
    while len(tied):
        members = sa[tied]
        own = rank[members]
        ahead = members + h
        second = np.where(ahead < n, rank[np.minimum(ahead, n - 1)] + 1, 0)
        if 3 * bits <= 64:
            packed = (own.astype(_U) << _U(2 * bits)) | (second.astype(_U) << _U(bits)) | members.astype(_U)
            packed.sort()
            members = (packed & _U((1 << bits) - 1)).astype(np.int64)
            pair = packed >> _U(bits)
            changed = np.concatenate(([True], pair[1:] != pair[:-1]))
        else:
            o = np.lexsort((members, second, own))
            members, own, second = members[o], own[o], second[o]
            changed = np.concatenate(([True], (own[1:] != own[:-1]) | (second[1:] != second[:-1])))
        sa[tied] = members
        tied = regroup(tied, changed)
        h *= 2
    return sa


# ------------------------------------------------------------------ text as bytes
@dataclass
class Chunk:
    """Whole texts of a few rows: ``data[offsets[i]:offsets[i + 1]]`` is row ``rows[i]``'s text."""
    batch: pa.RecordBatch
    first: int
    data: np.ndarray
    offsets: np.ndarray
    valid: np.ndarray

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def column(self, name: str) -> pa.Array:
        return self.batch.column(self.batch.schema.names.index(name)).slice(self.first, len(self))

    def text(self, i: int) -> bytes:
        return self.data[self.offsets[i]:self.offsets[i + 1]].tobytes()


def give_back() -> None:
    """Return freed memory to the system: Python workers stay between tasks, and an
    executor's memory limit counts what they keep."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)      # where the C library has it
    if trim is not None:
        trim(0)


def text_chunks(batches: Iterator[pa.RecordBatch], column: str = "text",
                chunk_bytes: int = CHUNK_BYTES, max_rows: int = 1 << 30) -> Iterator[Chunk]:
    """Cut batches into runs of whole rows holding about ``chunk_bytes`` of text and at
    most ``max_rows`` rows (one row at least, so a longer text is a chunk of its own).
    Null is empty."""
    for batch in batches:
        if not batch.num_rows:
            continue
        arr = batch.column(batch.schema.names.index(column))
        valid = ~np.asarray(arr.is_null())
        if arr.null_count:
            arr = arr.fill_null("")
        # the batch's own buffers, without a copy
        wide = pa.types.is_large_string(arr.type) or pa.types.is_large_binary(arr.type)
        _, off, buf = arr.buffers()
        offsets = np.frombuffer(off, dtype=np.int64 if wide else np.int32)[arr.offset:arr.offset + len(arr) + 1].astype(np.int64)
        data = np.frombuffer(buf, dtype=np.uint8) if buf is not None and buf.size else np.empty(0, np.uint8)
        i, n = 0, len(arr)
        while i < n:
            j = int(np.searchsorted(offsets, offsets[i] + chunk_bytes, side="right")) - 1
            j = min(n, i + max_rows, max(i + 1, j))
            yield Chunk(batch, i, data[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i], valid[i:j])
            i = j
        del batch, arr, data, offsets, buf, off
        give_back()


def read_all(batches: Iterator[pa.RecordBatch]) -> pa.Table | None:
    """One shuffle partition as a table (callers size partitions to fit in memory)."""
    give_back()
    kept = [b for b in batches if b.num_rows]
    return pa.Table.from_batches(kept) if kept else None


def numbers(col: pa.ChunkedArray | pa.Array, dtype=np.int64) -> np.ndarray:
    """Column without nulls as a numpy array."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    return np.asarray(col.to_numpy(zero_copy_only=False)).astype(dtype, copy=False)


def list_parts(col: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Offsets and flat values of a list column without nulls."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    off = np.asarray(col.offsets).astype(np.int64)
    return off - off[0], col.values.slice(off[0], off[-1] - off[0])


def list_array(offsets: np.ndarray, values: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), values)


def segment_sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of each ``values[offsets[i]:offsets[i + 1]]``; empty segments give 0."""
    sums = np.concatenate(([0], np.cumsum(values)))
    return sums[offsets[1:]] - sums[offsets[:-1]]


# ------------------------------------------------------------------ words
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

#: Word bytes of the two word patterns that contracts use, after lower-casing A-Z.
ALNUM_WORDS = np.zeros(256, dtype=bool)       # [^\x00-\x2F\x3A-\x60\x7B-\x7F]+
ALNUM_WORDS[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
SPACED_WORDS = np.ones(256, dtype=bool)       # [^\x20\x09-\x0D]+
SPACED_WORDS[[0x20, *range(0x09, 0x0E)]] = False


@dataclass
class Words:
    hashes: np.ndarray     # by word
    start: np.ndarray      # byte offsets in the chunk
    end: np.ndarray
    doc: np.ndarray        # row of the chunk
    offsets: np.ndarray    # first word of each row; one more entry than rows


def find_words(chunk: Chunk, word_bytes: np.ndarray) -> Words:
    """Maximal runs of word bytes of each text, A-Z lower-cased, in text order."""
    low = _LOWER[chunk.data]
    n = len(low)
    inside = word_bytes[low]
    starts_row = np.zeros(n + 1, dtype=bool)
    starts_row[chunk.offsets] = True
    before = np.concatenate(([False], inside[:-1])) if n else inside
    start = np.flatnonzero(inside & (~before | starts_row[:n]))
    after = np.concatenate((inside[1:], [False])) if n else inside
    end = np.flatnonzero(inside & (~after | starts_row[1:])) + 1
    hashes = RollingHash(low).ranges(start, end)
    offsets = np.searchsorted(start, chunk.offsets, side="left")
    doc = np.repeat(np.arange(len(chunk)), np.diff(offsets))
    return Words(hashes, start, end, doc, offsets)


def word_hashes(chunk: Chunk, word_bytes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of a large chunk and the offsets of its rows' words, found in
    pieces of whole rows."""
    found, counts, i, n = [np.empty(0, _U)], [], 0, len(chunk)
    while i < n:
        j = int(np.searchsorted(chunk.offsets, chunk.offsets[i] + CHUNK_BYTES, side="right")) - 1
        j = min(n, max(i + 1, j))
        at = chunk.offsets[i:j + 1]
        w = find_words(Chunk(chunk.batch, chunk.first + i, chunk.data[at[0]:at[-1]], at - at[0], chunk.valid[i:j]), word_bytes)
        found.append(w.hashes)
        counts.append(np.diff(w.offsets))
        i = j
    return np.concatenate(found), np.concatenate(([0], np.cumsum(np.concatenate(counts)))) if counts else np.zeros(1, np.int64)


def gram_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of every ``k`` consecutive words, by first word (rows not separated)."""
    n = len(words) - k + 1
    if n <= 0:
        return np.empty(0, dtype=_U)
    out = words[:n].copy()
    for j in range(1, k):
        out *= _U(_MULT)
        out += words[j:j + n]
    return mix(out)


# ------------------------------------------------------------------ Spark helpers
#: Lets Spark delete a statement's shuffle files when the statement ends.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Bytes of rows that Spark hands to Python at a time.
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


@contextlib.contextmanager
def setting(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    """``key`` is ``value`` for the statements that run inside, as before after them."""
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def small_batches(spark: SparkSession, n_bytes: int = 8 * CHUNK_BYTES):
    """Statements that run inside hand rows to Python by ``n_bytes`` or so: a batch is held by
    the JVM and by the worker at once, and 10 000 whole texts may be large."""
    return setting(spark, _BATCH, str(n_bytes))


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to and reread from a new table in the shared folder: cuts the
    lineage, survives lost executors and is computed once. The shuffle files of the
    write are not needed after it and go at once."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    with setting(spark, _CLEANUP, "true"):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def most_frequent(counts: DataFrame, n: str, limit: int) -> DataFrame:
    """The rows of ``counts`` with the greatest ``n`` (long, positive), ``limit`` at most: all rows from
    some count on, as many as fit. Counts are levelled, at most 8 levels a doubling, so the driver sees
    at most 512 rows."""
    level = F.floor(F.log2(n) * 8)
    fits, total = None, 0
    for r in sorted(counts.groupBy(level.alias("l")).agg(F.count(F.lit(1)).alias("c")).collect(), reverse=True):
        total += r["c"]
        if total > limit:
            break
        fits = r["l"]
    return counts.limit(0) if fits is None else counts.filter(level >= fits)


#: Kinds that Arrow and Spark take alike, without time zones.
_PLAIN = (T.StringType, T.IntegralType, T.FractionalType, T.BooleanType, T.BinaryType, T.DateType)


def small_table(spark: SparkSession, schema: T.StructType, rows: list[tuple]) -> DataFrame:
    """Rows of the driver by Arrow. Given as Python objects they are unpacked on the executors by
    Python workers with a daemon of their own, which stay there for a while."""
    if not all(isinstance(f.dataType, _PLAIN) for f in schema.fields):
        return spark.createDataFrame(rows, schema)
    return spark.createDataFrame(pa.table({f.name: pa.array([r[i] for r in rows]) for i, f in enumerate(schema.fields)}), schema)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def fresh_name(df: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of ``df`` is called so."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def with_row_ids(df: DataFrame, id_col: str, name: str = "_rid") -> DataFrame:
    """Add a unique long per row, ordered like ``id_col`` (nulls last). It is the id itself where ids
    are whole numbers, unique and not null (checked); otherwise rows are numbered in id order (ids of
    text in theirs: '01' and '1' are two), rows of one id by all their other columns that can be
    ordered. Columns may have any names."""
    spark = df.sparkSession
    if isinstance(df.schema[id_col].dataType, T.IntegralType):
        bad = df.groupBy(id_col).agg(F.count(F.lit(1)).alias("n")).filter((F.col("n") > 1) | F.col(id_col).isNull())
        if not bad.limit(1).collect():
            return df.withColumn(name, F.col(id_col).cast("long"))
    rest = [f.name for f in df.schema.fields if f.name != id_col and not re.search("map<|variant", f.dataType.simpleString())]
    part, place, shift = (fresh_name(df.withColumn(name, F.lit(0)), c) for c in ("row_part", "row_place", "row_shift"))
    by = [F.col(f"`{c.replace('`', '``')}`") for c in rest]
    ordered = written(df.orderBy(F.col(id_col).asc_nulls_last(), *([F.xxhash64(*by), *by] if by else []))
                      .withColumn(part, F.spark_partition_id()).withColumn(place, F.monotonically_increasing_id()), "row-ids")
    counts = sorted((r[0], r[1]) for r in ordered.groupBy(part).agg(F.count(F.lit(1)).alias("n")).collect())
    total, firsts = 0, []
    for p, n in counts:         # one row a partition
        firsts.append((p, total - (p << 33)))
        total += n
    shifts = small_table(spark, T.StructType([T.StructField(part, T.IntegerType()), T.StructField(shift, T.LongType())]), firsts)
    return ordered.join(F.broadcast(shifts), part).withColumn(name, F.col(place) + F.col(shift)).drop(part, place, shift)


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components of undirected ``edges`` (u, v long): rows (node, component),
    the component being its smallest node. Alternates large-star and small-star
    rounds, each a grouped minimum and a join; every round is written to the shared folder."""
    e = written(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
                .filter("u <> v").distinct(), "edges")
    last = None
    for _ in range(max_rounds):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.filter("u <> v").distinct()
        small_low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(small_low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
        e = written(small.unionByName(small_low.withColumnRenamed("m", "v"))
                    .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
        state = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == last:
            return e.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component")) \
                .unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        last = state
    raise RuntimeError("components did not settle")
