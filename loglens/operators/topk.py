"""O1/O2/O3: ordering and top-k per data source.

``row_number() <= k`` over ``partitionBy(datasource_id)`` lets Spark insert a
partial window-group limit before the exchange, so each map task ships at most
``k`` rows per data source: a source with billions of groups never lands whole
in one task. Every order gets a final tie-break so results are deterministic.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_k(df: DataFrame, k: int, order: list[Column], partition: tuple[str, ...] = ("datasource_id",)) -> DataFrame:
    w = Window.partitionBy(*partition).orderBy(*order)
    ranked = df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= k)
    return ranked.drop("_rn")
