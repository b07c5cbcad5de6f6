"""Data-source registry: collections and data sources.

The registry is a small dimension (one row per imported log source). New ids are
``max(id) + 1`` as an auto-increment column would give.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import COLLECTIONS, DATASOURCES, LOG_TYPES

# The registry seed used with the stand-in data (FIXTURES §1).
SEED_COLLECTIONS = [(1, "incident", "Example incident"), (2, "empty", "No sources")]
SEED_DATASOURCES = [(1, 1, "bc", "bluecoat", ""), (2, 1, "sq", "squid", ""), (3, 1, "www", "apache", ""),
                    (4, 1, "iis", "iis", ""), (5, 1, "iiss", "iis-short", "")]


def empty_table(spark: SparkSession, schema) -> DataFrame:
    """A table with ``schema`` and no rows, built JVM-side (no Python worker is started)."""
    return spark.range(0).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in schema.fields])


def literal_table(spark: SparkSession, rows, schema) -> DataFrame:
    """A small table from literal rows, built JVM-side (no Python worker is started)."""
    structs = [F.struct(*[F.lit(v).cast(f.dataType).alias(f.name) for v, f in zip(r, schema.fields)]) for r in rows]
    if not structs:
        return empty_table(spark, schema)
    return spark.range(1).select(F.inline(F.array(*structs)))


def seed_registry(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    return (literal_table(spark, SEED_COLLECTIONS, COLLECTIONS),
            literal_table(spark, SEED_DATASOURCES, DATASOURCES))


def _next_id(df: DataFrame) -> DataFrame:
    return df.agg((F.coalesce(F.max("id"), F.lit(0)) + 1).cast("int").alias("id"))


def add_collection(collections: DataFrame, name: str, description: str = "") -> DataFrame:
    """K6: append a collection with the next id."""
    row = _next_id(collections).select("id", F.lit(name).alias("name"), F.lit(description).alias("description"))
    return collections.unionByName(row)


def add_datasource(datasources: DataFrame, name: str, log_type: str, collection_id: int,
                   description: str = "") -> DataFrame:
    """K6: append a data source with the next id."""
    if log_type not in LOG_TYPES:
        raise ValueError(f"unknown log type {log_type!r}; expected one of {LOG_TYPES}")
    row = _next_id(datasources).select("id", F.lit(int(collection_id)).alias("collection_id"),
                                        F.lit(name).alias("name"), F.lit(log_type).alias("type"),
                                        F.lit(description).alias("description"))
    return datasources.unionByName(row)


def sources_with_collection(datasources: DataFrame, collections: DataFrame) -> DataFrame:
    """Data sources with their collection's name (inner join)."""
    c = collections.select(F.col("id").alias("collection_id"), F.col("name").alias("collection_name"))
    return datasources.join(c, "collection_id", "inner").select(
        F.col("name").alias("datasource_name"), F.col("id").alias("datasource_id"), "type",
        "collection_name", "collection_id")


def collections_nested(collections: DataFrame, datasources: DataFrame) -> DataFrame:
    """Each collection with an array of its data sources; empty collections kept."""
    ds = datasources.select(F.col("collection_id"), F.struct("id", "name", "description", "type").alias("ds"))
    joined = collections.join(ds, collections.id == ds.collection_id, "left")
    return joined.groupBy(collections.id, collections.name, collections.description).agg(
        F.array_sort(F.filter(F.collect_list("ds"), lambda x: x.isNotNull())).alias("datasources"))


def sources_of_types(datasources: DataFrame, types) -> DataFrame:
    return datasources.filter(F.col("type").isin(*types)).select(F.col("id").alias("datasource_id"), "type")


def restrict_to_types(facts: DataFrame, datasources: DataFrame, types) -> DataFrame:
    """keep fact rows whose data source has one of ``types`` (semi join; Spark broadcasts the registry by its size)."""
    return facts.join(sources_of_types(datasources, types), "datasource_id", "left_semi")


def with_type(facts: DataFrame, datasources: DataFrame) -> DataFrame:
    """Add the data-source ``type`` column to fact rows."""
    t = datasources.select(F.col("id").alias("datasource_id"), "type")
    return facts.join(t, "datasource_id", "inner")


def of_types(facts: DataFrame, datasources: DataFrame, types) -> DataFrame:
    """F12 with the ``type`` column: rows of data sources of ``types``, one join."""
    return facts.join(sources_of_types(datasources, types), "datasource_id", "inner")
