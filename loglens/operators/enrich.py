"""Enrichment: address location (J9), host names (J10), map feed.

Location is a point-in-range lookup. Blocks may nest and overlap; an address lies where the smallest
block around it says (equal sizes: the smaller start, then the smaller values). ``disjoint_blocks``
cuts the blocks into segments that meet no other, bucket by bucket of a /16 (at most 65 536 buckets a
block, usually one):
1. a block's part of a bucket is the union of at most 30 aligned powers of two, and each of these
   keeps its smallest block (a grouped minimum; a hot bucket is spread over its powers of two);
2. between any two neighbouring block edges of a bucket the answer is one, so each such segment asks
   the 17 aligned powers of two around its first address, by equality, and takes the smallest block.

A range condition alone would plan as a nested-loop join, so addresses join segments on the bucket and
are then filtered on the exact range, which only one segment fulfils. Addresses in a hot /16 are split
by adaptive skew-join handling; whether the segments or names are broadcast is decided by their size
in bytes when the query runs.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.counts import add_bytes, byte_sum
from ..functions.ip import ipv4_to_long, is_public, is_strict_ip
from .topk import top_k

BUCKET_BITS = 16
UNRESOLVED = "unresolvable"


def _bucketed(blocks: DataFrame) -> DataFrame:
    """The parts of blocks by bucket: offsets ``lo`` to ``hi`` in it and the whole block, smallest first in order."""
    start, end = F.col("start_ip"), F.col("end_ip")
    values = [c for c in blocks.columns if c not in ("start_ip", "end_ip")]
    first = F.shiftleft(F.col("bucket"), BUCKET_BITS)
    parts = blocks.filter(start <= end).select(
        "start_ip", "end_ip", F.struct((end - start).alias("size"), start.alias("start"), F.struct(*values).alias("values")).alias("block"),
        F.explode(F.sequence(F.shiftright(start, BUCKET_BITS), F.shiftright(end, BUCKET_BITS))).alias("bucket"))
    return parts.select("bucket", "block", (F.greatest(start, first) - first).alias("lo"),
                        (F.least(end, first + (1 << BUCKET_BITS) - 1) - first).alias("hi"))


def disjoint_blocks(blocks: DataFrame) -> DataFrame:
    """``blocks`` cut into segments that do not overlap, each with the values of the smallest
    block around it; with the ``bucket`` that the segment lies in."""
    parts = _bucketed(blocks)
    levels = F.explode(F.sequence(F.lit(0), F.lit(BUCKET_BITS))).alias("level")
    powers = parts.select("bucket", "block", "lo", "hi", levels) \
        .withColumn("from", F.expr("shiftright(lo + shiftleft(1L, level) - 1, level)")) \
        .withColumn("to", F.expr("shiftright(hi + 1, level)")).filter(F.col("from") < F.col("to"))
    powers = powers.select("bucket", "level", "block", F.explode(F.array_compact(F.array(
        F.when(F.col("from") % 2 == 1, F.col("from")), F.when(F.col("to") % 2 == 1, F.col("to") - 1)))).alias("power"))
    smallest = powers.groupBy("bucket", "level", "power").agg(F.min("block").alias("block"))
    edges = parts.select("bucket", F.explode(F.array(F.col("lo"), F.col("hi") + 1)).alias("first")) \
        .filter(F.col("first") < (1 << BUCKET_BITS)).distinct()
    following = F.lead("first").over(Window.partitionBy("bucket").orderBy("first"))     # of at most 65 536
    segments = edges.withColumn("last", F.coalesce(following, F.lit(1 << BUCKET_BITS)) - 1)
    asked = segments.select("bucket", "first", "last", levels).withColumn("power", F.expr("shiftright(first, level)"))
    found = asked.join(smallest, ["bucket", "level", "power"]).groupBy("bucket", "first", "last").agg(F.min("block").alias("block"))
    base = F.shiftleft(F.col("bucket"), BUCKET_BITS)
    return found.select("bucket", (base + F.col("first")).alias("start_ip"), (base + F.col("last")).alias("end_ip"), "block.values.*")


def locate(df: DataFrame, address_col: str, blocks: DataFrame) -> DataFrame:
    """Add latitude, longitude, country, region, city, one location an address; unlocated rows are dropped."""
    ip_num = ipv4_to_long(F.col(address_col))
    left = df.withColumn("_ipnum", ip_num).filter(F.col("_ipnum").isNotNull()) \
             .withColumn("_bucket", F.shiftright(F.col("_ipnum"), BUCKET_BITS))
    b = disjoint_blocks(blocks).withColumnRenamed("bucket", "_bucket")
    j = left.join(b, "_bucket", "inner").filter(
        (F.col("_ipnum") >= F.col("start_ip")) & (F.col("_ipnum") <= F.col("end_ip")))
    return j.drop("_bucket", "_ipnum", "start_ip", "end_ip")


def resolve_names(df: DataFrame, address_col: str, names: DataFrame) -> DataFrame:
    """Add ``name`` for the address column; ``unresolvable`` when absent."""
    n = names.groupBy("address").agg(F.min("name").alias("name"))   # one name per address
    j = df.join(n, df[address_col] == n["address"], "left")
    return j.select(*[df[c] for c in df.columns], F.coalesce(n["name"], F.lit(UNRESOLVED)).alias("name"))


def map_feed(facts: DataFrame, blocks: DataFrame, kind: str = "proxy", k: int | None = None,
             names: DataFrame | None = None, full_rfc1918: bool = False) -> DataFrame:
    """Top destinations (proxy, 100) or clients (web, 500) by total bytes, private
    addresses excluded (F7, D24, D25: ``full_rfc1918`` excludes all of 172.16/12), then located
    (J9); unlocated ones drop out.

    Host-name destinations are located through ``names`` (address, name) when given:
    the name's address is looked up, as a forward name lookup would."""
    key = "destip" if kind == "proxy" else "clientip"
    k = k or (100 if kind == "proxy" else 500)
    g = facts.filter(is_public(F.col(key), full_rfc1918=full_rfc1918)).groupBy("datasource_id", key).agg(
        byte_sum(add_bytes("bytesIn", "bytesOut")).alias("totalBytes"))
    top = top_k(g, k, [F.col("totalBytes").desc(), F.col(key)])
    if names is None:
        return locate(top, key, blocks).withColumnRenamed(key, "address")
    forward = names.groupBy(F.col("name").alias("_name")).agg(F.min("address").alias("_address"))
    top = top.join(forward, top[key] == forward["_name"], "left")
    top = top.withColumn("_lookup", F.when(is_strict_ip(F.col(key)), F.col(key)).otherwise(F.col("_address")))
    located = locate(top.drop("_name", "_address"), "_lookup", blocks)
    return located.drop("_lookup").withColumnRenamed(key, "address")


def address_location(addresses: DataFrame, blocks: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """A28 for chosen addresses or host names (column ``address``): their location, without
    totals. Host names are looked up in ``names`` when given; unlocated ones drop out."""
    a = addresses.select("address").distinct()
    if names is None:
        return locate(a, "address", blocks)
    forward = names.groupBy(F.col("name").alias("_name")).agg(F.min("address").alias("_address"))
    a = a.join(forward, a["address"] == forward["_name"], "left")
    a = a.withColumn("_lookup", F.when(is_strict_ip(F.col("address")), F.col("address")).otherwise(F.col("_address")))
    return locate(a.drop("_name", "_address"), "_lookup", blocks).drop("_lookup")
