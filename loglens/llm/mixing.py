"""Mixing sources to target weights by entropy balancing.

Documents get rates r as near as can be to one use each (least relative entropy
sum(r ln r - r + 1)) under one constraint a source, that its tokens, sum(size r), are
its target, and none is used more than CAP times. The solution tilts exponentially,
r = min(CAP, exp(l size)), with one dual variable l a source. The dual is convex; it is
solved by Newton steps whose gradient and curvature are sums over all documents,
taken by Spark in every round (over the counts of documents by source and size). A
step that leaves the bracket known so far is replaced by its middle.

Rates become whole copies by error diffusion: a source's sizes are walked from the
largest down, and each size's documents get the whole number of copies that their rates and
the words owed so far allow. What is owed at the end is less than the last document that
could still be used once more; so many of its words are taken, and it is the only
document of its source that is used in part. Which documents of a size get one copy
more is decided by a hash of their id.

Only numbers of a source (sum, target, dual variable) come to the driver, and only
counts by size meet in a task, never a source's documents.

Edge cases: null text is of size 0; null is a source, the last; sources without words
have target 0; documents of size 0 take nothing; repeated rows are documents of
their own; a table without words gives targets 0.
"""
from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import fresh_name, numbers, small_table, with_row_ids, written

WEIGHTS = (3, 1, 2)
SHARE = 1.5
CAP = 2
TOLERANCE = 1e-6
MAX_ROUNDS = 80
#: Parts by hash in which documents of one source and size are ranked.
PARTS = 1024


def targets_of(sizes: list[float], weights: list[float], total: float, cap: float = CAP) -> list[float]:
    """Shares of ``total`` by weight, none above ``cap`` times its size; the excess of those
    above is shared again by weight."""
    out = [0.0] * len(sizes)
    live, rest = list(range(len(sizes))), total
    while live:
        weight = sum(weights[i] for i in live)
        over = [i for i in live if rest * weights[i] / weight > cap * sizes[i]]
        if not over:
            for i in live:
                out[i] = rest * weights[i] / weight
            break
        for i in over:
            out[i] = float(cap * sizes[i])
        rest -= sum(out[i] for i in over)
        live = [i for i in live if i not in set(over)]
    return out


def word_count(col) -> F.Column:
    """Runs of ``[^\\x20\\x09-\\x0D]+``."""
    return F.coalesce(F.regexp_count(col, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def solve_rates(spark: SparkSession, cells: DataFrame, sizes: list[int], targets: list[float], cap: float = CAP) -> list[float]:
    """Dual variables by source number; ``cells`` has rows (src, size, n), size above 0.
    A target of ``cap`` times the size is the limit of large variables (infinity), 0 that of small ones."""
    n = len(sizes)
    log_cap, targets = math.log(cap), [float(t) for t in targets]
    ends = {r["src"]: (r["lo"], r["hi"]) for r in cells.groupBy("src").agg(F.min("size").alias("lo"), F.max("size").alias("hi")).collect()}
    dual = [math.inf if targets[i] >= cap * sizes[i] else -math.inf if targets[i] <= 0 else 0.0 for i in range(n)]
    low = [-math.inf] * n
    high = [log_cap / ends[i][0] if i in ends else 0.0 for i in range(n)]     # there all rates are at the cap
    live = [i for i in range(n) if math.isfinite(dual[i])]
    for _ in range(MAX_ROUNDS):
        if not live:
            return dual
        state = F.broadcast(small_table(spark, T.StructType([T.StructField("src", T.IntegerType()), T.StructField("l", T.DoubleType())]), [(i, dual[i]) for i in live]))
        rate = F.when(F.col("l") * F.col("size") >= log_cap, float(cap)).otherwise(F.exp(F.col("l") * F.col("size")))
        free = F.when(F.col("l") * F.col("size") < log_cap, F.col("size").cast("double") * F.col("size") * F.col("n") * rate).otherwise(0.0)
        sums = cells.join(state, "src").groupBy("src").agg(F.sum(F.col("size") * F.col("n") * rate).alias("g"), F.sum(free).alias("h")).collect()
        for r in sums:
            i, gap = r["src"], r["g"] - targets[r["src"]]
            if abs(gap) <= TOLERANCE * max(targets[i], 1.0):
                live.remove(i)
                continue
            if gap > 0:
                high[i] = min(high[i], dual[i])
            else:
                low[i] = max(low[i], dual[i])
            step = dual[i] - gap / r["h"] if r["h"] > 0 else math.nan
            if not low[i] < step < high[i]:
                step = (low[i] + high[i]) / 2 if math.isfinite(low[i]) else 2 * min(dual[i], -1.0 / ends[i][1])
            dual[i] = step
    raise RuntimeError(f"no rates found for source numbers {live}")


def _copies(dual: list[float], targets: list[float], cap: int):
    """One source's counts by size: copies of all its documents of a size, how many get one
    more, and the words that the next one gives besides."""
    schema = pa.schema([("src", pa.int32()), ("size", pa.int64()), ("copies", pa.int64()), ("more", pa.int64()), ("part", pa.int64())])

    def run(table):
        src = numbers(table.column("src"))
        order = np.argsort(-numbers(table.column("size")))
        size, n = numbers(table.column("size"))[order], numbers(table.column("n"))[order]
        l, left = dual[int(src[0])], round(targets[int(src[0])])
        due, given, last, copies = 0.0, 0, -1, []
        for i, (s, m) in enumerate(zip(size.tolist(), n.tolist())):
            due += (cap if l * s >= math.log(cap) else math.exp(max(l * s, -700.0))) * s * m
            k = min(cap * m, max(0, int((min(due, left) - given) // s)))
            given += k * s
            copies.append(k)
            if k < cap * m:
                last = i
        part = np.zeros(len(copies), dtype=np.int64)
        if last >= 0:
            part[last] = min(max(0, left - given), size[last])
        k = np.array(copies, dtype=np.int64)
        return pa.table([pa.array(src[order], pa.int32()), pa.array(size), pa.array(k // n), pa.array(k % n), pa.array(part)], schema=schema)

    return run


def mix(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", weights: tuple = WEIGHTS,
        share: float = SHARE, cap: int = CAP) -> DataFrame:
    """Row of ``docs`` by row: ``id_col``, size, source, source_size, target, copies (whole ones) and
    taken (copies times size, and the words of the one partial use of a source)."""
    spark = docs.sparkSession
    sized = written(docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), word_count("text").alias("size")), "sizes")
    sources = sorted(((r["source"], r["n"]) for r in sized.groupBy("source").agg(F.sum("size").alias("n")).collect()), key=lambda r: (r[0] is None, r[0] or ""))
    sizes = [n for _, n in sources]
    targets = targets_of(sizes, [float(weights[i % len(weights)]) for i in range(len(sizes))], share * sum(sizes), cap)
    kind = sized.schema["source"].dataType
    schema = T.StructType([T.StructField("source", kind), T.StructField("src", T.IntegerType()),
                           T.StructField("source_size", T.LongType()), T.StructField("target", T.DoubleType())])
    named = F.broadcast(small_table(spark, schema, [(s, i, n, targets[i]) for i, (s, n) in enumerate(sources)]))
    placed = sized.join(named.withColumnRenamed("source", "source_"), F.col("source").eqNullSafe(F.col("source_"))).drop("source_")
    cells = written(placed.filter("size > 0").groupBy("src", "size").agg(F.count(F.lit(1)).alias("n")), "size-counts")
    dual = solve_rates(spark, cells, sizes, targets, cap)
    copies = cells.groupBy("src").applyInArrow(_copies(dual, targets, cap), "src int, size long, copies long, more long, part long")
    # who gets one more: the first by hash, ranked in parts
    ranked = placed.withColumn("h", F.xxhash64("id")).withColumn("slot", F.pmod("h", F.lit(PARTS)))
    ahead = ranked.filter("size > 0").groupBy("src", "size", "slot").agg(F.count(F.lit(1)).alias("n")) \
        .withColumn("ahead", F.sum("n").over(Window.partitionBy("src", "size").orderBy("slot")) - F.col("n")).drop("n")
    within = F.row_number().over(Window.partitionBy("src", "size", "slot").orderBy("h", "id"))
    out = ranked.withColumn("rank", within).join(ahead, ["src", "size", "slot"], "left").join(copies, ["src", "size"], "left")
    place = F.col("ahead") + F.col("rank") - F.col("more")
    got = F.coalesce(F.col("copies") + F.when(place <= 0, 1).otherwise(0), F.lit(0)).cast("long")
    part = F.coalesce(F.when(place == 1, F.col("part")), F.lit(0)).cast("long")
    return out.select(F.col("id").alias(id_col), "size", "source", "source_size", "target", got.alias("copies"), (got * F.col("size") + part).alias("taken"))


def with_copies(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source") -> DataFrame:
    """``docs`` with the columns size, source_size, target, copies and taken of its mix (names that
    are taken are lengthened). A document is one row however often it is used; 0 copies: not used."""
    row = fresh_name(docs, "row_id")
    named = with_row_ids(docs, id_col, row)
    mixed = mix(named.select(row, F.col(source_col).alias("source"), "text"), row, "source")
    new = ("size", "source_size", "target", "copies", "taken")
    out = mixed.select(F.col(row).alias(f"{row}_"), *[F.col(c).alias(fresh_name(docs, c)) for c in new])
    return named.join(out, F.col(row) == F.col(f"{row}_")).drop(row, f"{row}_")
