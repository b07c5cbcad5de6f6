"""Indicator scan (P4, F3, F17-F20) and listing.

All four detectors run in one projection; each hit becomes one row (a query can
give up to four), as the reference's four sequential tests did.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.indicators import detector_hits


def indicator_rows(web: DataFrame, text_col: str = "query") -> DataFrame:
    """``xss_data`` rows: (clientip, query, xsstype, detector, datasource_id) per hit.

    Only non-empty queries are scanned (F3)."""
    q = web.filter(F.col(text_col) != "").select("datasource_id", "clientip", F.col(text_col).alias("query"))
    hits = q.select("datasource_id", "clientip", "query", F.explode(detector_hits(F.col("query"))).alias("hit"))
    return hits.select("clientip", "query", F.col("hit.xsstype").alias("xsstype"),
                       F.col("hit.detector").alias("detector"), F.col("datasource_id").cast("int"))


def reject_indicators(rejects: DataFrame) -> DataFrame:
    """F17-F20 over lines that gave no row (D36): (datasource_id, kind, reason, line, xsstype,
    detector) per hit. An attack with an unpaired apostrophe loses its row, not its indicator."""
    hits = rejects.filter(F.col("line") != "").select("datasource_id", "kind", "reason", "line", F.explode(detector_hits(F.col("line"))).alias("hit"))
    return hits.select("datasource_id", "kind", "reason", "line", F.col("hit.xsstype").alias("xsstype"), F.col("hit.detector").alias("detector"))


def indicator_listing(xss: DataFrame, datasource_id: int | None = None, client: str | None = None) -> DataFrame:
    """Indicators of a data source, all clients or one."""
    df = xss
    if datasource_id is not None:
        df = df.filter(F.col("datasource_id") == int(datasource_id))
    if client is not None:
        df = df.filter(F.col("clientip") == client)
    return df.select("datasource_id", "clientip", "query", "xsstype")


def detector_counts(texts: DataFrame, text_col: str) -> DataFrame:
    """Texts scanned and texts hit per detector over a free-text column (R1), one
    aggregate pass over whole texts."""
    from ..functions.indicators import DETECTORS, matches
    aggs = [F.count(F.lit(1)).alias("texts")]
    aggs += [F.count_if(matches(F.col(text_col), pattern)).alias(f"{name}_hits") for name, pattern, _ in DETECTORS]
    return texts.agg(*aggs)
