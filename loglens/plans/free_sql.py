"""Q1: free SQL over the tables, first column resolved to names (J10), written as CSV (K7)."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators.enrich import resolve_names
from .store import write_names_csv


def register_tables(spark: SparkSession, tables: dict[str, DataFrame]) -> None:
    for name, df in tables.items():
        df.createOrReplaceTempView(name)


def resolve_query(spark: SparkSession, query: str, names: DataFrame, tables: dict[str, DataFrame] | None = None,
                  out_path: str | None = None) -> DataFrame:
    """Run ``query``; its first column is looked up in ``names``; optionally written as CSV."""
    if tables:
        register_tables(spark, tables)
    result = spark.sql(query)
    key = result.columns[0]
    resolved = resolve_names(result.select(key), key, names).withColumnRenamed(key, "key")
    if out_path:
        write_names_csv(resolved, out_path, "key")
    return resolved
