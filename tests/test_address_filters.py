"""Reports on one address skip the row groups whose Bloom filters do not hold it. (Few addresses in a
column are a dictionary, which tells as much; many are not.)"""
from pyspark.sql import functions as F

from loglens.functions.ip import client_or_dest
from loglens.plans.store import LogStore


def _scanned(df):
    """Rows that the file scans of a run query gave."""
    rows = len(df.collect())
    total, todo = 0, [df._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        if node.nodeName().startswith("AdaptiveSparkPlan"):
            todo.append(node.executedPlan())
            continue
        children = node.children()
        todo += [children.apply(i) for i in range(children.size())]
        if node.nodeName().startswith("Scan parquet"):
            total += node.metrics().apply("numOutputRows").value()
    return rows, total


def test_row_groups_without_the_address_are_skipped(spark, tmp_path):
    store = LogStore(spark, str(tmp_path / "s"))
    e = spark.range(300_000).repartition(3)
    store.append("proxy_data", e.select(
        "id", F.concat(F.lit("d"), F.col("id"), F.lit(".example")).alias("clientip"), F.concat(F.lit("dest-"), F.col("id"), F.lit(".example")).alias("destip"),
        (F.lit(1_700_000_000) + F.col("id")).alias("time"), F.lit(1).cast("bigint").alias("bytesIn"), F.lit(1).cast("bigint").alias("bytesOut"),
        F.lit(0).cast("bigint").alias("bytesDiff"), F.lit("").alias("direction"), F.lit(0).alias("contentType"), F.lit("/").alias("page"),
        F.lit(1).alias("datasource_id")))

    def read(**options):
        return spark.read.options(**options).parquet(store.path("proxy_data"))
    # within the least and the largest client and destination
    absent = client_or_dest("dest-5x.example", "clientip", "destip")
    assert _scanned(read().filter(absent)) == (0, 0)
    rows, scanned = _scanned(read(**{"parquet.filter.bloom.enabled": "false"}).filter(absent))
    assert rows == 0 and scanned > 50_000
    rows, scanned = _scanned(read().filter(client_or_dest("dest-77.example", "clientip", "destip")))
    assert rows == 1 and 0 < scanned < 300_000
