"""Distributed text scan of log files, one record per line, Latin-1."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import default_parallelism


def latin1_line(col="value"):
    """Re-decode the raw bytes of a text row as ISO-8859-1.

    The text reader keeps the file's bytes, so casting to binary and decoding
    gives the Latin-1 reading (the reader's ``encoding`` option does not transcode)."""
    c = F.col(col) if isinstance(col, str) else col
    return F.decode(c.cast("binary"), "ISO-8859-1")


# Compressed files that a text scan cannot split (one file = one task).
UNSPLITTABLE = (".gz", ".zst", ".zstd", ".snappy", ".lz4", ".z")


def read_log_lines(spark: SparkSession, paths, encoding: str = "ISO-8859-1",
                   with_file: bool = False, spread: bool | None = None) -> DataFrame:
    """Read text logs as a ``line`` column; input splits give the parallelism.

    Partition folders such as ``datasource_id=3`` become columns (partition discovery).
    A compressed file that a scan cannot split is one task. When a given path or pattern names
    such files, the lines are dealt out over the cluster's parallelism, so that the CPU-bound
    parse is not bound to one task a file (``spread`` overrides this for folders)."""
    paths = [paths] if isinstance(paths, str) else list(paths)
    raw = spark.read.text(paths)
    if spread if spread is not None else any(p.lower().endswith(UNSPLITTABLE) for p in paths):
        raw = raw.repartition(default_parallelism(spark))
    line = latin1_line("value") if encoding.upper() in ("ISO-8859-1", "LATIN-1", "LATIN1") \
        else F.decode(F.col("value").cast("binary"), encoding)
    cols = [line.alias("line")] + [F.col(c) for c in raw.columns if c != "value"]
    if with_file:
        cols.append(F.col("_metadata.file_path").alias("source_file"))
    return raw.select(*cols)
