"""Proxy reports: detail and summary per client (A1-A4), client leaders.

Reports cover every data source of the fitting type at once (F12 type gate);
rows carry ``datasource_id``. Aggregations are partial (map-side) before the
shuffle, so a hot client costs one pre-aggregated row per map task.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.counts import add_bytes, byte_sum
from ..plans.registry import of_types, restrict_to_types
from .topk import top_k


def pair_direction(b_in, b_out):
    """direction of a pair from its summed bytes."""
    return F.when(b_in > b_out, "in").when(b_out > b_in, "out").otherwise("==")


def bluecoat_detail(proxy: DataFrame, datasources: DataFrame) -> DataFrame:
    """A1: per (client, destination): bytes in, out, total, requests, direction; total desc."""
    p = restrict_to_types(proxy, datasources, ["bluecoat"])
    g = p.groupBy("datasource_id", "clientip", "destip").agg(
        byte_sum("bytesIn").alias("bytesIn"), byte_sum("bytesOut").alias("bytesOut"),
        F.count("id").alias("count"))
    return g.select("datasource_id", "clientip", "destip", "bytesIn", "bytesOut",
                    add_bytes("bytesIn", "bytesOut").alias("byteTotal"), "count",
                    pair_direction(F.col("bytesIn"), F.col("bytesOut")).alias("direction")) \
            .orderBy(F.col("byteTotal").desc(), "datasource_id", "clientip", "destip")


def bluecoat_summary(proxy: DataFrame, datasources: DataFrame) -> DataFrame:
    """A2: per client: bytes in, out, total, distinct destinations; total desc."""
    p = restrict_to_types(proxy, datasources, ["bluecoat"])
    g = p.groupBy("datasource_id", "clientip").agg(
        byte_sum("bytesIn").alias("bytesIn"), byte_sum("bytesOut").alias("bytesOut"),
        F.countDistinct("destip").alias("hosts"))
    return g.select("datasource_id", "clientip", "bytesIn", "bytesOut",
                    add_bytes("bytesIn", "bytesOut").alias("byteTotal"), "hosts") \
            .orderBy(F.col("byteTotal").desc(), "datasource_id", "clientip")


def squid_detail(proxy: DataFrame, datasources: DataFrame) -> DataFrame:
    """A3: per (client, destination): bytes, direction (D23: deterministic pick), requests."""
    p = restrict_to_types(proxy, datasources, ["squid"])
    g = p.groupBy("datasource_id", "clientip", "destip").agg(
        byte_sum("bytesIn").alias("bytes"), F.min("direction").alias("direction"), F.count("id").alias("count"))
    return g.orderBy(F.col("bytes").desc(), "datasource_id", "clientip", "destip")


def squid_summary(proxy: DataFrame, datasources: DataFrame) -> DataFrame:
    """A4: per client: bytes, distinct destinations; bytes desc."""
    p = restrict_to_types(proxy, datasources, ["squid"])
    g = p.groupBy("datasource_id", "clientip").agg(byte_sum("bytesIn").alias("bytes"),
                                                     F.countDistinct("destip").alias("hosts"))
    return g.orderBy(F.col("bytes").desc(), "datasource_id", "clientip")


# Which stored column means "in"/"out" differs by type (D33): Squid rows keep their
# single byte count in bytesIn, so the charts read bytesOut for "in" there.
def _measure(which: str):
    t = F.col("type")
    if which == "in":
        return F.when(t == "bluecoat", F.col("bytesIn")).otherwise(F.col("bytesOut"))
    if which == "out":
        return F.when(t == "bluecoat", F.col("bytesOut")).otherwise(F.col("bytesIn"))
    if which == "total":
        return F.when(t == "bluecoat", add_bytes("bytesIn", "bytesOut")).otherwise(F.col("bytesIn"))
    raise ValueError(which)


def top_clients_by_bytes(proxy: DataFrame, datasources: DataFrame, which: str, k: int = 50) -> DataFrame:
    """A14 (``in``), A15 (``out``), A16 (``total``): top clients per proxy source."""
    p = of_types(proxy, datasources, ["bluecoat", "squid"])
    g = p.groupBy("datasource_id", "clientip").agg(byte_sum(_measure(which)).alias("totalBytes"))
    return top_k(g, k, [F.col("totalBytes").desc(), F.col("clientip")])


def top_clients_by_hosts(proxy: DataFrame, datasources: DataFrame, k: int = 40) -> DataFrame:
    """Top clients by distinct destinations."""
    p = restrict_to_types(proxy, datasources, ["bluecoat", "squid"])
    g = p.groupBy("datasource_id", "clientip").agg(F.countDistinct("destip").alias("hostCount"))
    return top_k(g, k, [F.col("hostCount").desc(), F.col("clientip")])
