"""Continuous import: new log files in a folder -> parsed rows -> partitioned Parquet.

The parsers are pure column expressions, so the batch import plan runs unchanged
on a streaming source. The sink is exactly-once through its checkpoint folder
(below ``spark.checkpoint.dir`` unless given) and writes its own table folder: a
streaming Parquet sink keeps a commit log that batch appends would bypass.
Streamed rows carry no ``id``: there is no table-wide counter across micro-batches.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..schemas import PROXY_TYPES, TABLES
from ..session import scratch_path
from ..sources.ingest import parse_lines
from ..sources.text import latin1_line


def parsed_stream(spark: SparkSession, folder: str, log_type: str, datasource_id: int,
                  tz: str = "UTC", max_files_per_trigger: int | None = None) -> DataFrame:
    """Streaming DataFrame of parsed rows from text files arriving in ``folder``."""
    reader = spark.readStream.format("text")
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", int(max_files_per_trigger))
    raw = reader.load(folder)
    kind = "proxy" if log_type in PROXY_TYPES else "web"
    lines = raw.select(latin1_line("value").alias("line"), F.lit(int(datasource_id)).alias("datasource_id"))
    rows = parse_lines(lines, kind, log_type, tz=tz)
    table = "proxy_data" if kind == "proxy" else "web_data"
    return rows.withColumn("id", F.lit(None).cast("bigint")).select(*TABLES[table].fieldNames())


def start_import(spark: SparkSession, folder: str, log_type: str, datasource_id: int, table_path: str,
                 checkpoint: str | None = None, tz: str = "UTC", available_now: bool = True,
                 processing_time: str | None = None) -> StreamingQuery:
    """Start the continuous import; ``available_now`` processes what is there and stops."""
    stream = parsed_stream(spark, folder, log_type, datasource_id, tz)
    writer = (stream.writeStream.format("parquet").option("path", table_path)
              .option("checkpointLocation", checkpoint or scratch_path(spark, "stream-checkpoint"))
              .partitionBy("datasource_id").outputMode("append"))
    if available_now:
        writer = writer.trigger(availableNow=True)
    elif processing_time:
        writer = writer.trigger(processingTime=processing_time)
    return writer.start()
