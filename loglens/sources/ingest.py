"""S10-S11 and the import path: lines -> typed proxy/web rows (+ rejects).

The driver only plans; executors tokenise and parse their own input splits.
The data-source type comes from the registry, joined on ``datasource_id``; Spark
broadcasts the registry by its size in bytes.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import PROXY_ROW_FIELDS, PROXY_TYPES, WEB_ROW_FIELDS, WEB_TYPES
from .parsers import annotate
from .text import read_log_lines

ROW_FIELDS = {"proxy": PROXY_ROW_FIELDS, "web": WEB_ROW_FIELDS}
KIND_TABLES = {"proxy": "proxy_data", "web": "web_data"}
KIND_TYPES = {"proxy": PROXY_TYPES, "web": WEB_TYPES}


def attach_types(lines: DataFrame, datasources: DataFrame) -> DataFrame:
    """Add each line's data-source ``type`` from the registry."""
    types = datasources.select(F.col("id").cast("int").alias("datasource_id"), F.col("type"))
    return lines.join(types, "datasource_id", "inner")


def spread(lines: DataFrame, min_partitions: int | None) -> DataFrame:
    """Round-robin the lines over ``min_partitions`` tasks before the CPU-bound parse
    (for inputs known to have few splits); ``None`` leaves the input as it is."""
    if not min_partitions or lines.isStreaming:
        return lines
    return lines.repartition(int(min_partitions))


def parse_lines(lines: DataFrame, kind: str, log_type="type", line_col: str = "line",
                tz: str = "UTC", keep: list[str] | None = None, assign_id: bool = False,
                min_partitions: int | None = None, positions: dict | None = None) -> DataFrame:
    """Parsed rows of one kind (``proxy``/``web``); unparseable lines vanish.

    ``log_type`` is a type string (one format for all lines) or the name of a column.
    ``positions`` names other token positions by log type, e.g. ``{"iis": {"query": 6}}`` (D31)."""
    keep = [c for c in (keep if keep is not None else ["datasource_id"]) if c in lines.columns]
    lines = spread(lines, min_partitions)
    ann = annotate(lines, kind, log_type, line_col, tz, positions)
    # A line yields zero or one record. Emitting it through a generator (rather than
    # filtering on the parsed struct) keeps the optimizer from pushing a filter down
    # with the whole parser expression inlined once per token reference.
    one = ann.select(*keep, F.explode(F.filter(F.array("_rec"), lambda r: r.isNotNull())).alias("_r"))
    rows = one.select(*keep, *[F.col("_r")[f].alias(f) for f in ROW_FIELDS[kind]])
    if assign_id:
        # Stable under task retries for file scans: partition index + position in split.
        rows = rows.withColumn("id", F.monotonically_increasing_id())
    return rows


def rejected_lines(lines: DataFrame, kind: str, log_type="type", line_col: str = "line",
                   tz: str = "UTC", keep: list[str] | None = None) -> DataFrame:
    """Lines that gave no row, with the reason."""
    keep = [c for c in (keep if keep is not None else ["datasource_id"]) if c in lines.columns]
    ann = annotate(lines, kind, log_type, line_col, tz)
    return ann.select(*keep, F.col(line_col).alias("line"),
                      F.explode(F.filter(F.array("_reason"), lambda r: r.isNotNull())).alias("reason"))


def tagged_lines(lines: DataFrame, kind: str, log_type="type", line_col: str = "line", tz: str = "UTC",
                 keep: list[str] | None = None, positions: dict | None = None) -> DataFrame:
    """Every line once, from one parse: its ``row`` (struct; NULL if the line gave none), ``line``
    and ``reason`` (NULL if it gave one)."""
    keep = [c for c in (keep if keep is not None else ["datasource_id"]) if c in lines.columns]
    ann = annotate(lines, kind, log_type, line_col, tz, positions)
    # through a generator for the reason given in parse_lines
    one = ann.select(*keep, F.explode(F.array(F.struct(F.col("_rec").alias("row"), F.col(line_col).alias("line"), F.col("_reason").alias("reason")))).alias("_t"))
    return one.select(*keep, "_t.row", "_t.line", "_t.reason")


def reject_counts(lines: DataFrame, kind: str, log_type="type", tz: str = "UTC") -> DataFrame:
    """S11 summary: rejected lines per data source and reason (partial aggregation)."""
    return (rejected_lines(lines, kind, log_type, tz=tz)
            .groupBy("datasource_id", "reason").agg(F.count(F.lit(1)).alias("lines")))


def read_source_file(spark: SparkSession, paths, datasource_id: int, log_type: str,
                     tz: str = "UTC") -> DataFrame:
    """Import one data source's files (the reference's per-file import): rows with an id."""
    kind = "proxy" if log_type in PROXY_TYPES else "web"
    lines = read_log_lines(spark, paths).withColumn("datasource_id", F.lit(int(datasource_id)))
    return parse_lines(lines, kind, log_type, tz=tz, assign_id=True)
