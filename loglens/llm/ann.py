"""Nearest neighbours by cosine with randomly rotated one-bit codes, in lists by centroid.

Index: every vector is scaled to length one and rotated at random (one fixed orthogonal
matrix); the signs of its coordinates are its packed code, and the inner product of the
rotated vector with its code's own unit vector is its correction scalar. Each half of the
rotated vector has centroids of its own, the root of rows over LIST_SIZE many, and a vector's list
is the pair of its nearest two. They are fitted on about SAMPLE distinct vectors (by hash; at
most twice as many); every row is indexed.

Search: a query meets the lists nearest to it. How many is taken from the sample: as many
as hold LISTED of the true neighbours that sampled queries have in the sample (true ones in all
rows are nearer, so are their lists). Vectors without any clusters need most lists, clustered ones few.
Lists are cut into blocks of a bounded number of codes and of queries, whatever the table's size or
a list's; a vector travels once for each query block of its list. A query that found fewer
than k (its lists hold too few) meets all lists.

In a block, the inner product of a query with a vector is that with the vector's code over the
correction; the error lies, for a random rotation, within
EPSILON * sqrt((1 - c^2) / c^2 / (dimensions - 1)) (c: the correction) but for a small part.
A block's best estimates are compared exactly first; then every vector whose upper bound
reaches the k-th best exact value found is reranked. Scores are cosines in double precision
on the original vectors.

Of rows with one and the same vector only the first k + 1 by id can be among any query's k nearest
(equal scores go to the smaller id), so only these meet queries: copies, however many, cost no more.

Edge cases: vectors that are null, zero, hold null or non-finite components, or have another
length than most take no part; ties go to the smaller id; rows are told apart also when ids
repeat or are null, a query never finds its own row; with fewer candidates than k all are
returned; other columns are not touched.
"""
from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import list_parts, numbers, with_row_ids, written

K = 5
QUERY_EVERY = 50
EPSILON = 2.5
SEED = 20240501
#: Codes and queries of a block.
CODE_BLOCK, QUERY_BLOCK = 8192, 2048
#: Rows a list on average, vectors that centroids are fitted on, rounds of that, and the part of
#: sampled neighbours that the lists of a query hold.
LIST_SIZE, SAMPLE, FIT_ROUNDS, LISTED = 8192, 16384, 12, 0.98
#: Sampled queries that tell how many lists to meet.
ASKED = 512
#: Queries estimated at a time.
_STEP = 256


def rotation(dims: int, seed: int = SEED) -> np.ndarray:
    """Random orthogonal matrix over the dimensions, filled up to whole bytes."""
    wide = -(-dims // 8) * 8
    q, r = np.linalg.qr(np.random.default_rng([seed, wide]).standard_normal((wide, wide)))
    return (q * np.sign(np.diag(r)))[:dims].astype(np.float64)


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def encode(x: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Packed sign bits and correction scalars of the rows of ``x``."""
    y = unit(x) @ turn
    return np.packbits(y > 0, axis=1), np.abs(y).sum(axis=1) / np.sqrt(turn.shape[1])


@dataclass
class Lists:
    """Centroids of the two halves of rotated unit vectors; list a * len(right) + b."""
    left: np.ndarray
    right: np.ndarray
    probes: int = 1

    def __len__(self) -> int:
        return len(self.left) * len(self.right)

    def _gaps(self, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        half = self.left.shape[1]
        return gaps(y[:, :half], self.left), gaps(y[:, half:], self.right)

    def nearest(self, y: np.ndarray) -> np.ndarray:
        left, right = self._gaps(y)
        return left.argmin(axis=1) * len(self.right) + right.argmin(axis=1)

    def all_gaps(self, y: np.ndarray) -> np.ndarray:
        left, right = self._gaps(y)
        return (left[:, :, None] + right[:, None, :]).reshape(len(y), -1)

    def probed(self, y: np.ndarray, n: int) -> np.ndarray:
        """The ``n`` nearest lists of each row, in no order."""
        if n >= len(self):
            return np.tile(np.arange(len(self)), (len(y), 1))
        step = max(1, (1 << 22) // len(self))
        return np.concatenate([np.argpartition(self.all_gaps(y[i:i + step]), n - 1, axis=1)[:, :n] for i in range(0, len(y), step)])


def gaps(y: np.ndarray, centers: np.ndarray) -> np.ndarray:
    """Squared distances less the rows' own squared lengths."""
    return (centers * centers).sum(axis=1) - 2 * (y @ centers.T)


def centroids(y: np.ndarray, k: int, rng) -> np.ndarray:
    """k-means of the rows of ``y`` from ``k`` of them."""
    centers = y[np.sort(rng.permutation(len(y))[:k])]
    for _ in range(FIT_ROUNDS):
        to = gaps(y, centers).argmin(axis=1)
        n = np.bincount(to, minlength=len(centers))
        sums = np.stack([np.bincount(to, weights=column, minlength=len(centers)) for column in y.T], axis=1)
        centers = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centers)
    return centers


def fit_lists(x: np.ndarray, turn: np.ndarray, side: int, k: int = K, seed: int = SEED) -> Lists:
    """Centroids, ``side`` a half, from sampled vectors, and how many lists a query meets."""
    if not len(x):
        return Lists(np.zeros((1, turn.shape[1] // 2)), np.zeros((1, turn.shape[1] // 2)))
    rng = np.random.default_rng([seed, side])
    unit_x = unit(x)
    y, half = unit_x @ turn, turn.shape[1] // 2
    lists = Lists(centroids(y[:, :half], side, rng), centroids(y[:, half:], side, rng))
    if len(x) > 1 and len(lists) > 1:
        asked = rng.permutation(len(x))[:ASKED]
        score = unit_x[asked] @ unit_x.T
        score[np.arange(len(asked)), asked] = -np.inf
        near = np.argpartition(-score, min(k, len(x) - 1) - 1, axis=1)[:, :min(k, len(x) - 1)]
        home, ranks = lists.nearest(y), []
        for i, row in zip(asked, near):
            gap = lists.all_gaps(y[i:i + 1])[0]
            ranks.append((gap[None, :] < gap[home[row]][:, None]).sum(axis=1) + 1)
        lists.probes = int(np.quantile(np.concatenate(ranks), LISTED, method="higher"))
    return lists


def _encode_rows(dims: int, seed: int, lists: Lists):
    schema = pa.schema([("rid", pa.int64()), ("id", pa.int64()), ("code", pa.binary()), ("correction", pa.float64()), ("list", pa.int64()), ("vector", pa.list_(pa.float64()))])

    def run(batches):
        turn = rotation(dims, seed)
        for batch in batches:
            if not batch.num_rows:
                continue
            _, flat = list_parts(batch.column(2))
            x = numbers(flat, np.float64).reshape(-1, dims)
            code, correction = encode(x, turn)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([c.tobytes() for c in code], pa.binary()),
                                              pa.array(correction), pa.array(lists.nearest(unit(x) @ turn)), batch.column(2)], schema=schema)

    return run


@dataclass
class Index:
    """Rows (rid, id, code, correction, list, vector) of every vector that takes part, in the shared folder."""
    rows: DataFrame
    dims: int
    seed: int
    lists: Lists


def build_index(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", seed: int = SEED, list_size: int = LIST_SIZE, k: int = K) -> Index:
    v = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("vector"))
    good = F.col("vector").isNotNull() & F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("vector", lambda x: x != 0)
    v = v.filter(F.coalesce(good, F.lit(False)))
    most = v.groupBy(F.size("vector").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "d").limit(1).collect()
    dims, n = (most[0]["d"], most[0]["n"]) if most else (1, 0)
    v = v.filter(F.size("vector") == dims)
    taken = F.pmod(F.xxhash64("vector"), F.lit(1 << 30)) < int(min(1.0, SAMPLE / max(n, 1)) * (1 << 30))
    sample = v.filter(taken).select("vector").distinct().limit(2 * SAMPLE).toArrow()
    x = numbers(list_parts(sample.column(0))[1], np.float64).reshape(-1, dims) if sample.num_rows else np.zeros((0, dims))
    x = x[np.lexsort(x.T)]
    lists = fit_lists(x, rotation(dims, seed), max(1, min(len(x), math.ceil(math.sqrt(n / list_size)))), k, seed)
    rows = with_row_ids(v, "id", "rid").select("rid", "id", "vector")
    coded = rows.mapInArrow(_encode_rows(dims, seed, lists), "rid long, id long, code binary, correction double, list long, vector array<double>")
    return Index(written(coded, "codes"), dims, seed, lists)


def _nearest(x: np.ndarray, rid: np.ndarray, q: np.ndarray, rows: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` rows nearest to ``q`` of ``rows``, and their cosines."""
    y = x[rows]
    with np.errstate(over="ignore", invalid="ignore", divide="ignore"):
        score = (y * q).sum(axis=1) / (np.sqrt((y * y).sum(axis=1)) * np.sqrt((q * q).sum()))
    odd = ~np.isfinite(score)
    if odd.any():       # lengths beyond the range of doubles
        score[odd] = (unit(y[odd]) * unit(q[None, :])).sum(axis=1)
    best = np.lexsort((rid[rows], -score))[:k]
    return rows[best], score[best]


def search_block(code: np.ndarray, correction: np.ndarray, x: np.ndarray, rid: np.ndarray, queries: np.ndarray, query_rid: np.ndarray,
                 turn: np.ndarray, k: int, epsilon: float):
    """For each query its ``k`` nearest rows of the block: (query, rows, cosines)."""
    wide = turn.shape[1]
    signs = np.unpackbits(code, axis=1).astype(np.float32) * 2 - 1
    scale = (1 / (np.sqrt(wide) * correction)).astype(np.float32)
    error = (epsilon * np.sqrt(np.maximum(1 - correction ** 2, 0) / correction ** 2 / max(wide - 1, 1)) + 1e-6).astype(np.float32)
    for i in range(0, len(queries), _STEP):
        part = queries[i:i + _STEP]
        estimate = ((unit(part) @ turn).astype(np.float32) @ signs.T) * scale
        for j in range(len(part)):
            row = estimate[j]
            row[rid == query_rid[i + j]] = -np.inf
            first = np.argpartition(-row, min(4 * k, len(row) - 1))[:4 * k]
            first = first[np.isfinite(row[first])]
            if not len(first):
                continue
            near, score = _nearest(x, rid, part[j], first, k)
            if len(near) == k:
                near, score = _nearest(x, rid, part[j], np.flatnonzero(row + error >= score[-1]), k)
            else:
                near, score = _nearest(x, rid, part[j], np.flatnonzero(np.isfinite(row)), k)
            yield i + j, near, score


def _probes(dims: int, seed: int, lists: Lists, n: int):
    """Rows (rid, id, code, correction, vector) of queries with each list that they meet."""
    def run(batches):
        turn = rotation(dims, seed)
        for batch in batches:
            if not batch.num_rows:
                continue
            x = numbers(list_parts(batch.column(4))[1], np.float64).reshape(-1, dims)
            met = pa.array(list(lists.probed(unit(x) @ turn, n)), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([*batch.columns, met], names=[*batch.schema.names, "lists"])

    return run


def _search(dims: int, seed: int, k: int, epsilon: float):
    """One block: rows (is_query, rid, id, code, correction, vector)."""
    schema = pa.schema([("query_rid", pa.int64()), ("query_id", pa.int64()), ("rid", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])

    def run(table):
        turn = rotation(dims, seed)
        is_query = numbers(table.column("is_query"), bool)
        rid, correction = numbers(table.column("rid")), numbers(table.column("correction"), np.float64)
        ids = table.column("id").to_pylist()
        x = numbers(list_parts(table.column("vector"))[1], np.float64).reshape(-1, dims)
        code = np.frombuffer(b"".join(table.column("code").to_pylist()), np.uint8).reshape(len(x), -1)
        q, c = np.flatnonzero(is_query), np.flatnonzero(~is_query)
        out: list[list] = [[], [], [], [], []]
        for j, near, score in search_block(code[c], correction[c], x[c], rid[c], x[q], rid[q], turn, k, epsilon) if len(c) else ():
            for values, new in zip(out, ([rid[q[j]]] * len(near), [ids[q[j]]] * len(near), rid[c[near]], [ids[r] for r in c[near]], score)):
                values.extend(new)
        return pa.table([pa.array(v, t.type) for v, t in zip(out, schema)], schema=schema)

    return run


def blocks(index: Index, queries: DataFrame, n_lists: int, k: int = K, code_block: int = CODE_BLOCK, query_block: int = QUERY_BLOCK) -> DataFrame:
    """Rows of the blocks in which queries meet vectors: (block, is_query, rid, id, code, correction,
    vector). A block is one key, so that the blocks of a list are not dealt out by the list alone."""
    columns = ["rid", "id", "code", "correction", "vector"]
    first = F.row_number().over(Window.partitionBy("code", "vector").orderBy("rid"))
    held = index.rows.withColumn("copy", first).filter(F.col("copy") <= k + 1)
    asked = queries.select(*columns).mapInArrow(_probes(index.dims, index.seed, index.lists, n_lists),
                                                "rid long, id long, code binary, correction double, vector array<double>, lists array<long>")
    asked = asked.select(*columns, F.explode("lists").alias("list"))
    cut = lambda df, size, name: df.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / size).cast("int").alias(name))
    mine = lambda n: F.pmod(F.xxhash64("rid"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    n_blocks = cut(held, code_block, "n_code").join(cut(asked, query_block, "n_query"), "list")
    base = held.join(n_blocks, "list").select("list", mine("n_code").alias("code_block"), every("n_query").alias("query_block"), F.lit(False).alias("is_query"), *columns)
    met = asked.join(n_blocks, "list").select("list", every("n_code").alias("code_block"), mine("n_query").alias("query_block"), F.lit(True).alias("is_query"), *columns)
    return base.unionByName(met).select(F.struct("list", "code_block", "query_block").alias("block"), "is_query", *columns)


def search(index: Index, queries: DataFrame, k: int = K, epsilon: float = EPSILON, **sizes) -> DataFrame:
    """The ``k`` nearest indexed rows found of each query (rows of the index): query_id, rank, vec_id, score."""
    def found(asked: DataFrame, n_lists: int) -> DataFrame:
        hits = blocks(index, asked, n_lists, k, **sizes).groupBy("block") \
            .applyInArrow(_search(index.dims, index.seed, k, epsilon), "query_rid long, query_id long, rid long, vec_id long, score double")
        rank = F.row_number().over(Window.partitionBy("query_rid").orderBy(F.desc("score"), "rid"))
        return hits.withColumn("rank", rank).filter(F.col("rank") <= k)

    near = found(queries, index.lists.probes)
    if index.lists.probes < len(index.lists):
        near = written(near, "near")
        whole = near.filter(F.col("rank") == k).select(F.col("query_rid").alias("rid"))
        few = written(queries.join(whole, "rid", "left_anti"), "few-found")
        near = near.join(whole, F.col("query_rid") == whole["rid"], "left_semi").unionByName(found(few, len(index.lists)))
    return near.select("query_id", "rank", "vec_id", "score")


def nearest_neighbours(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", every: int = QUERY_EVERY,
                       k: int = K, list_size: int = LIST_SIZE, **options) -> DataFrame:
    """Index all ``vectors`` and search those whose id is divisible by ``every``."""
    index = build_index(vectors, id_col, vector_col, list_size=list_size, k=k)
    return search(index, index.rows.filter(F.col("id") % every == 0), k, **options)
