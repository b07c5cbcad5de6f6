"""Pages by day, for page changes (P1-P3) that read two weeks of a source and nothing older.

An import adds its distinct (source, time, page) in folders by source and UTC day (``day``: days since
1970, kept within 32 bits). The newest time of each source
(A29) comes from Parquet's file footers: the greatest ``time`` per folder is an aggregate that the
reader answers from statistics, without reading a row. The two weeks before it are at most 15 days a source; a
join on (source, day) leaves other days' folders unread (dynamic partition pruning). Rows of a day are
sorted by time and dealt out by (source, day, time, page), so a source with a third of all rows, or a busy day, is
spread over tasks.

Rows without a time or a page count as in the reports over the facts: no time, no week; a null page
is a page of its own. Imports that overlap repeat rows; the reports count distinct ones.
"""
from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.times import WEEK_SECONDS
from ..plans import claims
from ..session import scratch_path
from .web_reports import tag_weeks

DAY_SECONDS = 86400
_MAX_DAY = (1 << 31) - 1
SCHEMA = "time bigint, page string, datasource_id int, day int"
#: The aggregate is answered from footers only by the newer Parquet reader, which these settings choose.
_FOOTERS = {"spark.sql.sources.useV1SourceList": "", "spark.sql.parquet.aggregatePushdown": "true"}


def day_of(seconds: Column) -> Column:
    """Day of epoch seconds, kept within 32 bits; NULL without them."""
    days = (seconds - F.pmod(seconds, F.lit(DAY_SECONDS))) / F.lit(DAY_SECONDS)
    return F.when(seconds.isNotNull(), F.least(F.greatest(days, F.lit(-float(_MAX_DAY))), F.lit(float(_MAX_DAY)))).cast("int")


class PageDays:
    """The folders below ``root``, one an import, and a log of those that are whole."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def add(self, rows: DataFrame) -> str:
        """Add an import's rows; only these are read."""
        name = uuid.uuid4().hex
        seen = rows.filter(F.col("time").isNotNull()).select("time", "page", "datasource_id").distinct().withColumn("day", day_of(F.col("time")))
        seen.repartitionByRange("datasource_id", "day", "time", "page").sortWithinPartitions("datasource_id", "day", "time") \
            .write.partitionBy("datasource_id", "day").parquet(f"{self.root}/days/{name}")
        claims.create_once(self.spark, f"{self.root}/log/{name}")
        return name

    def _read(self, spark: SparkSession) -> list[DataFrame]:
        return [spark.read.schema(SCHEMA).parquet(f"{self.root}/days/{name}") for name in claims.names(self.spark, f"{self.root}/log")]

    def rows(self) -> DataFrame:
        """(time, page, datasource_id, day) of all imports."""
        out = self.spark.range(0).select(F.from_json(F.lit("{}"), SCHEMA).alias("r")).select("r.*")
        for part in self._read(self.spark):
            out = out.unionByName(part)
        return out

    def latest_time(self) -> DataFrame:
        """A29 from file footers: the newest time of each source."""
        reader = self.spark.newSession()
        for key, value in _FOOTERS.items():
            reader.conf.set(key, value)
        newest = [part.groupBy("datasource_id", "day").agg(F.max("time").alias("last_time")) for part in self._read(reader)]
        out = reader.range(0).select(F.from_json(F.lit("{}"), "datasource_id int, last_time bigint").alias("r")).select("r.*")
        for part in newest:
            out = out.unionByName(part.drop("day"))
        return out.groupBy("datasource_id").agg(F.max("last_time").alias("last_time"))

    def weeks(self) -> DataFrame:
        """Rows (datasource_id, time, page, last_time, week) of the two weeks before each source's newest
        time, for ``web_reports.totals_of_weeks`` (P1) and ``changes_of_weeks`` (P2, P3). The wanted days are
        written first, at most 15 rows a source, so that their size is known to the planner."""
        path = scratch_path(self.spark, "newest")
        last = F.col("last_time")
        days = F.explode(F.sequence(day_of(last - 2 * WEEK_SECONDS), day_of(last)))
        self.latest_time().select("datasource_id", "last_time", days.alias("day")).write.parquet(path)
        wanted = self.spark.read.schema("datasource_id int, last_time bigint, day int").parquet(path).filter(F.col("day") <= _MAX_DAY)
        rows = self.rows().join(wanted, ["datasource_id", "day"])
        return tag_weeks(rows.select("datasource_id", "time", "page", "last_time"))
