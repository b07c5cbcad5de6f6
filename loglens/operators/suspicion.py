"""Suspicion index: per-client shares of a data source's totals.

Baselines are one row per data source; per-client aggregates are joined to them
on ``datasource_id`` (one row per source). One aggregate per (source, client, page or
destination) reads the rows; clients are rolled up from it, and so are sources, by way of
(source, page or destination), whose rows also count the distinct ones. Both roll-ups use the
same columns, so they share one scan and one shuffle (a test counts them). Indicator and
beacon sums are pre-aggregated per (source, client) or per source and left-joined (J3-J5; D19).
Percentages use half-up rounding on the scaled value, ``floor(x*100+0.5)/100``
(D22), and divide by ``nullif(total, 0)`` (D21).
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.counts import add_bytes, byte_sum


def round2(col: Column) -> Column:
    return F.floor(col * 100 + 0.5) / 100


def share(part: Column, total: Column) -> Column:
    """Percentage of the total, rounded; 0 when the part is 0 or the total is 0/NULL."""
    pct = part.cast("double") / F.nullif(total, F.lit(0)).cast("double") * 100
    return F.when(F.coalesce(part, F.lit(0)) == 0, F.lit(0.0)).otherwise(F.coalesce(round2(pct), F.lit(0.0)))


def _web_clients(pages: DataFrame, xss: DataFrame) -> DataFrame:
    per_client = pages.groupBy("datasource_id", "clientip").agg(
        F.sum("hits").alias("hits"), F.count("page").alias("pages"), byte_sum("bytes").alias("bytes"))
    ind = xss.groupBy("datasource_id", "clientip").agg(F.count("query").alias("xss"))
    return per_client.join(ind, ["datasource_id", "clientip"], "left").fillna(0, ["xss"])


def _proxy_clients(dests: DataFrame, beacons: DataFrame) -> DataFrame:
    per_client = dests.groupBy("datasource_id", "clientip").agg(F.count("destip").alias("dests"), byte_sum("bytes").alias("bytes"))
    bsum = beacons.groupBy("datasource_id", "clientip").agg(F.sum("beaconScore").alias("beacon"))
    return per_client.join(bsum, ["datasource_id", "clientip"], "left")


def _per_item(facts: DataFrame, item: str) -> DataFrame:
    """One row per (source, client, item): the only aggregate that reads the rows. Client
    and source figures are rolled up from it."""
    return facts.groupBy("datasource_id", "clientip", item).agg(
        F.count(item).alias("hits"), byte_sum(add_bytes("bytesIn", "bytesOut")).alias("bytes"))


def _totals(items: DataFrame, item: str, distinct: str) -> DataFrame:
    """Per source: hits, bytes and distinct items, by way of one row per (source, item)."""
    each = items.groupBy("datasource_id", item).agg(F.sum("hits").alias("hits"), byte_sum("bytes").alias("bytes"))
    return each.groupBy("datasource_id").agg(F.sum("hits").alias("total_hits"), byte_sum("bytes").alias("total_bytes"),
                                             F.count(item).alias(distinct))


def _web_base(items: DataFrame, xss: DataFrame) -> DataFrame:
    found = xss.groupBy("datasource_id").agg(F.count("query").alias("total_xss"))
    return _totals(items, "page", "total_pages").join(found, "datasource_id", "left").fillna(0, ["total_xss"]) \
        .select("datasource_id", "total_hits", "total_pages", "total_bytes", "total_xss")


def _proxy_base(items: DataFrame, beacons: DataFrame) -> DataFrame:
    found = beacons.groupBy("datasource_id").agg(F.sum("beaconScore").alias("total_beacon"))
    return _totals(items, "destip", "total_dests").join(found, "datasource_id", "left") \
        .select("datasource_id", "total_hits", "total_dests", "total_bytes", "total_beacon")


def web_baseline(web: DataFrame, xss: DataFrame) -> DataFrame:
    """A24 + J5: per source hits, distinct pages, bytes, indicator total."""
    return _web_base(_per_item(web, "page"), xss)


def proxy_baseline(proxy: DataFrame, beacons: DataFrame) -> DataFrame:
    """A25 + J5: per source distinct destinations, bytes, beacon-score total."""
    return _proxy_base(_per_item(proxy, "destip"), beacons).drop("total_hits")


def web_suspicion(web: DataFrame, xss: DataFrame, limit: int | None = None) -> DataFrame:
    """Hits, pages, bytes and indicator shares per client, summed; index desc.
    ``limit`` keeps the top rows after sorting (never before, D20)."""
    items = _per_item(web, "page")
    c = _web_clients(items, xss)
    c = c.join(_web_base(items, xss), "datasource_id")   # one row per source (J6)
    scored = c.select(
        "datasource_id", "clientip",
        share(F.col("hits"), F.col("total_hits")).alias("hitsScore"),
        share(F.col("pages"), F.col("total_pages")).alias("pageScore"),
        share(F.col("bytes"), F.col("total_bytes")).alias("bytesScore"),
        share(F.col("xss"), F.col("total_xss")).alias("xssScore"))
    total = F.col("hitsScore") + F.col("pageScore") + F.col("bytesScore") + F.col("xssScore")
    out = scored.withColumn("suspicionScore", round2(total)) \
                .orderBy(F.col("suspicionScore").desc(), "datasource_id", "clientip")
    return out.limit(limit) if limit else out


def proxy_suspicion(proxy: DataFrame, beacons: DataFrame, limit: int | None = None) -> DataFrame:
    """Destination, bytes and beacon shares per client, summed; index desc.
    ``limit`` keeps the top rows after sorting (never before, D20)."""
    items = _per_item(proxy, "destip")
    c = _proxy_clients(items, beacons)
    c = c.join(_proxy_base(items, beacons), "datasource_id")
    scored = c.select(
        "datasource_id", "clientip",
        share(F.col("dests"), F.col("total_dests")).alias("ipScore"),
        share(F.col("bytes"), F.col("total_bytes")).alias("bytesScore"),
        share(F.col("beacon"), F.col("total_beacon")).alias("beaconScore"))
    total = F.col("ipScore") + F.col("bytesScore") + F.col("beaconScore")
    out = scored.withColumn("suspicionScore", round2(total)) \
                .orderBy(F.col("suspicionScore").desc(), "datasource_id", "clientip")
    return out.limit(limit) if limit else out
