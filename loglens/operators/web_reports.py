"""Web reports: traffic leaders (A8-A13, A18), latest time (A29), page changes."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.counts import add_bytes, byte_sum
from ..functions.times import WEEK_SECONDS
from .topk import top_k

MEASURES = {
    "bytesOut": lambda: byte_sum("bytesOut"),
    "bytesIn": lambda: byte_sum("bytesIn"),
    "total": lambda: byte_sum(add_bytes("bytesOut", "bytesIn")),
    "pages": lambda: F.count("page"),
}


def web_top(web: DataFrame, key: str, measure: str, k: int = 20, client: str | None = None,
            alias: str | None = None) -> DataFrame:
    """Top ``k`` clients or pages per data source by one measure (one function for A8-A13, A18).

    ``client`` restricts to one client first (A12 with an address)."""
    if client is not None:
        web = web.filter(F.col("clientip") == client)
    name = alias or ("totalPages" if measure == "pages" else "totalBytes")
    g = web.groupBy("datasource_id", key).agg(MEASURES[measure]().alias(name))
    return top_k(g, k, [F.col(name).desc(), F.col(key)])


def web_leaders(web: DataFrame, reports: list[tuple[str, str, str]], k: int = 20) -> DataFrame:
    """Several top-``k`` reports (label, key, measure) in one frame (report, source, item, value):
    one aggregate of the rows per key, all its measures at once; the top ``k`` of each
    measure are then taken from the grouped rows."""
    out = None
    for key in dict.fromkeys(r[1] for r in reports):
        mine = [(label, measure) for label, at, measure in reports if at == key]
        g = web.groupBy("datasource_id", F.col(key).alias("item")).agg(*[MEASURES[m]().alias(label) for label, m in mine])
        pairs = F.explode(F.array(*[F.struct(F.lit(label).alias("report"), F.col(label).cast("bigint").alias("value")) for label, _ in mine]))
        long = g.select("datasource_id", "item", pairs.alias("r")).select("r.report", "datasource_id", "item", "r.value")
        top = top_k(long, k, [F.col("value").desc(), F.col("item")], ("report", "datasource_id"))
        out = top if out is None else out.unionByName(top)
    return out


def traffic_summary(web: DataFrame) -> DataFrame:
    """A8 + A9 + A10 (the report's three tables) with a ``report`` label."""
    return web_leaders(web, [("clients_by_bytes_out", "clientip", "bytesOut"), ("clients_by_pages", "clientip", "pages"),
                             ("pages_by_bytes_out", "page", "bytesOut")])


def byte_leaders(web: DataFrame) -> DataFrame:
    """Pages and clients by bytes in and out, with a ``report`` label."""
    return web_leaders(web, [("pages_by_bytes_in", "page", "bytesIn"), ("pages_by_bytes_out", "page", "bytesOut"),
                             ("clients_by_bytes_out", "clientip", "bytesOut"), ("clients_by_bytes_in", "clientip", "bytesIn")])


def latest_time(web: DataFrame) -> DataFrame:
    """Newest event time per data source."""
    return web.groupBy("datasource_id").agg(F.max("time").alias("last_time"))


def _weeks(web: DataFrame, last_times: dict[int, int] | None = None) -> DataFrame:
    """Rows tagged ``current`` (last - 1 week < t < last) or ``previous``
    (last - 2 weeks < t < last - 1 week); bounds exclusive (D16, D17).

    The newest time of each source is joined, one row a source. A caller that knows the newest
    times passes them (``last_times``, source to time): the two weeks are then a literal
    predicate that reaches the Parquet scan and skips row groups by their statistics."""
    if last_times is None:
        w = web.select("datasource_id", "time", "page").join(latest_time(web), "datasource_id")
        w = w.filter((F.col("time") > F.col("last_time") - 2 * WEEK_SECONDS) & (F.col("time") < F.col("last_time")))
        return tag_weeks(w)
    window, last_col = F.lit(False), F.lit(None).cast("bigint")
    for ds, newest in last_times.items():
        mine = F.col("datasource_id") == int(ds)
        window = window | (mine & (F.col("time") > int(newest) - 2 * WEEK_SECONDS) & (F.col("time") < int(newest)))
        last_col = F.when(mine, F.lit(int(newest)).cast("bigint")).otherwise(last_col)
    return tag_weeks(web.filter(window).select("datasource_id", "time", "page", last_col.alias("last_time")))


def tag_weeks(w: DataFrame) -> DataFrame:
    """Rows (datasource_id, time, page, last_time) with their week; others are left out."""
    t, lt = F.col("time"), F.col("last_time")
    week = (F.when((t < lt) & (t > lt - WEEK_SECONDS), "current")
             .when((t < lt - WEEK_SECONDS) & (t > lt - 2 * WEEK_SECONDS), "previous"))
    return w.withColumn("week", week).filter(F.col("week").isNotNull())


def page_week_totals(web: DataFrame, last_times: dict[int, int] | None = None) -> DataFrame:
    """Per data source: last time and the distinct (time, page) totals of both weeks."""
    return totals_of_weeks(_weeks(web, last_times))


def totals_of_weeks(weeks: DataFrame) -> DataFrame:
    d = weeks.select("datasource_id", "last_time", "week", "time", "page").distinct()
    return d.groupBy("datasource_id", "last_time").agg(
        F.count(F.when(F.col("week") == "current", 1)).alias("current_total"),
        F.count(F.when(F.col("week") == "previous", 1)).alias("previous_total"))


def page_changes(web: DataFrame, last_times: dict[int, int] | None = None) -> DataFrame:
    """P2 + P3 in one pass: pages seen in only one of the two weeks, with ``change``
    ``new`` (current only) or ``gone`` (previous only). One shuffle on (source, page)."""
    return changes_of_weeks(_weeks(web, last_times))


def changes_of_weeks(weeks: DataFrame) -> DataFrame:
    g = weeks.groupBy("datasource_id", "page").agg(
        F.max(F.when(F.col("week") == "current", 1).otherwise(0)).alias("cur"),
        F.max(F.when(F.col("week") == "previous", 1).otherwise(0)).alias("prev"))
    return g.filter(F.col("cur") != F.col("prev")).select(
        "datasource_id", "page", F.when(F.col("cur") == 1, "new").otherwise("gone").alias("change"))


def new_pages(web: DataFrame, last_times: dict[int, int] | None = None) -> DataFrame:
    """Pages of the current week that the previous week has not."""
    return page_changes(web, last_times).filter(F.col("change") == "new").drop("change")


def gone_pages(web: DataFrame, last_times: dict[int, int] | None = None) -> DataFrame:
    """Pages of the previous week that the current week has not."""
    return page_changes(web, last_times).filter(F.col("change") == "gone").drop("change")
