"""Exploration: page search (A23, F8), IP report (A20, A21, F9), kB projection."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.counts import add_bytes, byte_sum
from ..functions.ip import client_or_dest
from ..functions.times import hour_bucket, minute_text
from .topk import top_k


def kilobytes(col) -> Column:
    """bytes as kB with two decimals (half-up on the scaled value)."""
    c = F.col(col) if isinstance(col, str) else col
    return F.floor(c / 1024 * 100 + 0.5) / 100


def _contains(col: str, word: str, wildcards: bool) -> Column:
    """Case-insensitive substring test. User ``%``/``_`` are literal unless ``wildcards``."""
    if wildcards:
        return F.col(col).ilike(f"%{word}%")
    return F.lower(F.col(col)).contains(word.lower())


def holds_word(word: str, kind: str = "proxy", wildcards: bool = False) -> Column:
    """F8: proxy rows match on page or destination, web rows on page."""
    cond = _contains("page", word, wildcards)
    return cond | _contains("destip", word, wildcards) if kind == "proxy" else cond


def listing_of_hits(grouped: DataFrame) -> DataFrame:
    """Columns and order of A23 for hits by (source, client)."""
    return grouped.select("datasource_id", "clientip", "pageCount",
                          minute_text(F.col("first_time")).alias("first_seen"),
                          minute_text(F.col("last_time")).alias("last_seen"), "bytes") \
                  .orderBy(F.col("pageCount").desc(), "datasource_id", "clientip")


def page_search(facts: DataFrame, word: str, kind: str = "proxy", wildcards: bool = False) -> DataFrame:
    """Per client hits, first/last seen (``%Y-%m-%d %H:%M`` UTC) and bytes; hits desc."""
    hits = F.count("time") if kind == "proxy" else F.count("page")
    return listing_of_hits(facts.filter(holds_word(word, kind, wildcards)).groupBy("datasource_id", "clientip").agg(
        hits.alias("pageCount"), F.min("time").alias("first_time"), F.max("time").alias("last_time"),
        byte_sum(add_bytes("bytesIn", "bytesOut")).alias("bytes")))


def _for_ip(facts: DataFrame, ip: str, kind: str) -> DataFrame:
    return facts.filter(client_or_dest(ip, "clientip", "destip" if kind == "proxy" else None))


def ip_hourly(facts: DataFrame, ip: str, kind: str = "proxy", hours: int = 25) -> DataFrame:
    """Hourly bytes in, out and total for one address: first ``hours`` hours."""
    g = _for_ip(facts, ip, kind).groupBy("datasource_id", hour_bucket(F.col("time")).alias("hour")).agg(
        byte_sum("bytesIn").alias("bytes_in"), byte_sum("bytesOut").alias("bytes_out"))
    g = g.withColumn("bytes_total", add_bytes("bytes_out", "bytes_in"))
    return top_k(g, hours, [F.col("hour")])


def ip_top_targets(facts: DataFrame, ip: str, kind: str = "proxy", k: int = 25) -> DataFrame:
    """Top destinations (proxy) or pages (web) of one address by total bytes."""
    key = "destip" if kind == "proxy" else "page"
    g = _for_ip(facts, ip, kind).groupBy("datasource_id", key).agg(
        byte_sum(add_bytes("bytesOut", "bytesIn")).alias("totalBytes"))
    return top_k(g, k, [F.col("totalBytes").desc(), F.col(key)])
