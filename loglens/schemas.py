"""Table definitions (K1): fixed schemas, declared once, never inferred."""
from __future__ import annotations

from pyspark.sql.types import (DoubleType, IntegerType, LongType, StringType,
                               StructField, StructType)


def _s(*fields: tuple[str, object]) -> StructType:
    return StructType([StructField(name, dtype, True) for name, dtype in fields])


PROXY_DATA = _s(("id", LongType()), ("clientip", StringType()), ("destip", StringType()),
                ("time", LongType()), ("bytesIn", LongType()), ("bytesOut", LongType()),
                ("bytesDiff", LongType()), ("direction", StringType()), ("contentType", IntegerType()),
                ("page", StringType()), ("datasource_id", IntegerType()))

WEB_DATA = _s(("id", LongType()), ("clientip", StringType()), ("time", LongType()),
              ("bytesIn", LongType()), ("bytesOut", LongType()), ("page", StringType()),
              ("query", StringType()), ("datasource_id", IntegerType()))

BEACON_DATA = _s(("clientip", StringType()), ("destip", StringType()), ("mean", DoubleType()),
                 ("stdDev", DoubleType()), ("count", LongType()), ("beaconScore", IntegerType()),
                 ("raw_score", IntegerType()), ("datasource_id", IntegerType()))

XSS_DATA = _s(("clientip", StringType()), ("query", StringType()), ("xsstype", StringType()),
              ("detector", StringType()), ("datasource_id", IntegerType()))

# Lines that gave no row (S11), kept for search and for the detectors.
REJECTS = _s(("kind", StringType()), ("line", StringType()), ("reason", StringType()), ("datasource_id", IntegerType()))

COLLECTIONS = _s(("id", IntegerType()), ("name", StringType()), ("description", StringType()))

DATASOURCES = _s(("id", IntegerType()), ("collection_id", IntegerType()), ("name", StringType()),
                 ("type", StringType()), ("description", StringType()))

GEO_BLOCKS = _s(("start_ip", LongType()), ("end_ip", LongType()), ("latitude", DoubleType()),
                ("longitude", DoubleType()), ("country", StringType()), ("region", StringType()),
                ("city", StringType()))

HOST_NAMES = _s(("address", StringType()), ("name", StringType()))

# Fact tables are partitioned by data source; the registry tables are not.
TABLES: dict[str, StructType] = {
    "proxy_data": PROXY_DATA,
    "web_data": WEB_DATA,
    "beacon_data": BEACON_DATA,
    "xss_data": XSS_DATA,
    "rejects": REJECTS,
    "collections": COLLECTIONS,
    "datasources": DATASOURCES,
}
PARTITIONED = {"proxy_data", "web_data", "beacon_data", "xss_data", "rejects"}

# The data-source type strings the parsers and reports accept.
PROXY_TYPES = ("bluecoat", "squid")
WEB_TYPES = ("apache", "iis", "iis-short")
LOG_TYPES = PROXY_TYPES + WEB_TYPES

PROXY_ROW_FIELDS = ["clientip", "destip", "time", "bytesIn", "bytesOut", "bytesDiff",
                    "direction", "contentType", "page"]
WEB_ROW_FIELDS = ["clientip", "time", "bytesIn", "bytesOut", "page", "query"]
