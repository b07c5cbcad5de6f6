"""Beacon statistics kept up to date (A5, A7): what an import adds is merged, old rows are not read again.

The state of a (source, client, destination) pair is its hour slices: requests, sums and the distinct
seconds of the slice (at most ``slice_seconds``, sorted). Slices of one key merge exactly, in any order and
any number: counts and sums add, seconds unite; the squared gaps inside a slice follow from its seconds.

An import appends the slices of its own rows and nothing else. Reading merges the slices that several
imports touched; ``compact`` stores them merged; ``index`` stores them as a table that is bucketed and sorted by
pair (K8), over which scoring shuffles no pair: a bucket holds a hot pair's slices, not its rows. Both group by (pair, slice), so a pair that holds a third of
all rows is spread over its slices, and a slice is as large as its seconds at most, times its imports.
"""
from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.counts import byte_sum
from ..plans import claims
from .beacon import DEFAULT_SLICE_SECONDS, PAIR, scores_of_pairs, stats_of_slices

STATE_SCHEMA = ("clientip string, destip string, slice bigint, n bigint, content_sum bigint, bytes_sum bigint, "
                "seconds array<bigint>, datasource_id int")


def slices_of_rows(proxy: DataFrame, slice_seconds: int = DEFAULT_SLICE_SECONDS) -> DataFrame:
    """State of some rows. Rows without a time are left out, as in scoring."""
    rows = proxy.select(*PAIR, "time", "bytesDiff", "contentType").filter(F.col("time").isNotNull())
    rows = rows.withColumn("slice", F.floor(F.col("time") / F.lit(slice_seconds)))
    seconds = rows.groupBy(*PAIR, "slice", "time").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.coalesce("contentType", F.lit(0))).cast("bigint").alias("content_sum"),
        byte_sum(F.coalesce(F.col("bytesDiff"), F.lit(0))).alias("bytes_sum"), F.array(F.col("time")).alias("seconds"))
    return merge_slices(seconds)


def merge_slices(slices: DataFrame) -> DataFrame:
    """One row per (pair, slice) from any number of them."""
    return slices.groupBy(*PAIR, "slice").agg(
        F.sum("n").alias("n"), F.sum("content_sum").cast("bigint").alias("content_sum"), byte_sum("bytes_sum").alias("bytes_sum"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("seconds")))).alias("seconds"))


def slice_figures(slices: DataFrame) -> DataFrame:
    """First and last second and squared gaps of merged slices, as ``beacon.slice_stats`` gives them."""
    size = F.size("seconds")
    gaps = F.zip_with(F.slice("seconds", F.lit(2), size), F.slice("seconds", F.lit(1), size - 1), lambda b, a: (b - a) * (b - a))
    return slices.select(*PAIR, "slice", "n", "content_sum", "bytes_sum", F.element_at("seconds", 1).alias("t_first"),
                         F.element_at("seconds", -1).alias("t_last"),
                         F.aggregate(gaps, F.lit(0).cast("bigint"), lambda s, g: s + g).alias("sq_inner"))


def pair_stats_of_state(slices: DataFrame) -> DataFrame:
    """A5 over merged slices, e.g. those of an index table."""
    return stats_of_slices(slice_figures(slices))


class BeaconState:
    """The state below ``root``: one folder an import, and a log of which folders hold. Folders not in
    the log (of an import that failed) are never read."""

    def __init__(self, spark: SparkSession, root: str, slice_seconds: int = DEFAULT_SLICE_SECONDS):
        self.spark, self.root, self.slice_seconds = spark, root.rstrip("/"), slice_seconds

    def _log(self, entry: str, content: str = "") -> bool:
        return claims.create_once(self.spark, f"{self.root}/log/{entry}", content.encode())

    def _holding(self) -> tuple[list[str], int]:
        """Folders that hold, and the number of compactions so far."""
        entries = claims.names(self.spark, f"{self.root}/log")
        held = {e[len("added-"):] for e in entries if e.startswith("added-")}
        swaps = [e for e in entries if e.startswith("swap-")]
        if swaps:
            found = [r["value"].split("\n") for r in self.spark.read.text([f"{self.root}/log/{e}" for e in swaps], wholetext=True).collect()]
            held = (held | {new for new, *_ in found}) - {name for _, *old in found for name in old}
        return sorted(held), len(swaps)

    def _write(self, slices: DataFrame) -> str:
        name = uuid.uuid4().hex
        slices.write.partitionBy("datasource_id").parquet(f"{self.root}/slices/{name}")
        return name

    def add(self, rows: DataFrame) -> str:
        """An import's rows; only these are read. They hold when this returns, whole."""
        name = self._write(slices_of_rows(rows, self.slice_seconds))
        self._log(f"added-{name}")
        return name

    def _read(self, folders: list[str]) -> DataFrame:
        paths = [f"{self.root}/slices/{name}" for name in folders]
        parts = [self.spark.read.schema(STATE_SCHEMA).parquet(p) for p in paths]
        out = self.spark.range(0).select(F.from_json(F.lit("{}"), STATE_SCHEMA).alias("s")).select("s.*")
        for p in parts:
            out = out.unionByName(p)
        return out

    def slices(self) -> DataFrame:
        return merge_slices(self._read(self._holding()[0]))

    def compact(self) -> bool:
        """Store the merged slices of all folders as one. A single log entry names the new folder and
        those that it replaces, so readers see either; of two compactions at once the second is
        given up (False). Imports that end meanwhile stay as they are."""
        old, swaps = self._holding()
        if len(old) < 2:
            return False
        name = self._write(merge_slices(self._read(old)))
        return self._log(f"swap-{swaps:06d}", "\n".join([name, *old]))

    def index(self, buckets: int) -> str:
        """K8: the merged slices as a table of the catalog, bucketed by (source, client, destination) and
        sorted by slice within; its name. For a pair's slices to be read by few tasks, ``buckets`` is
        about the state's bytes over 128 MB. The table is a copy: made again after imports."""
        name = f"beacon_index_{uuid.uuid4().hex}"
        self.slices().repartition(buckets, *PAIR).write.bucketBy(buckets, *PAIR).sortBy(*PAIR, "slice") \
            .option("path", f"{self.root}/index/{name}").saveAsTable(name)
        return name

    def scores(self, datasources: DataFrame) -> DataFrame:
        """``beacon_data`` rows, equal to scoring all rows at once."""
        return scores_of_pairs(pair_stats_of_state(self.slices()), datasources)
