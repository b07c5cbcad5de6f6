"""Table store and sinks.

The registry's tables (K6) are append-only logs: one small Parquet file for each version of a row,
named by id and version and created once (``claims``), so two writers never get one id and nothing that
is stored is ever overwritten; reading keeps the last version of each row.

Fact tables are Parquet folders partitioned by ``datasource_id``; replacing sources'
rows overwrites only their partition folders, after the new rows are computed, and
an empty result also clears old rows (D18). Reads name the schema (no inference) and
filter on the partition column, which prunes folders.
"""
from __future__ import annotations

import io
import uuid

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import IntegerType, StructField, StructType

from ..schemas import LOG_TYPES, PARTITIONED, TABLES
from ..sources.ingest import KIND_TABLES, tagged_lines
from . import claims
from .registry import empty_table


#: An import reserves 2^SLAB_BITS ids, 2^TASK_BITS of them for each task: 2^20 tasks of 67
#: million rows an import, and 131 072 imports into a table (beyond either it fails with a message).
SLAB_BITS, TASK_BITS = 46, 26
#: Columns that reports look single addresses up in (F9, A20-A22): row groups get Bloom filters of them.
ADDRESSES = ("clientip", "destip")
REGISTRY = [name for name in TABLES if name not in PARTITIONED]


def _with_filters(writer, columns):
    """Bloom filters for the address columns, as large as their distinct addresses need."""
    found = [c for c in ADDRESSES if c in columns]
    for c in found:
        writer = writer.option(f"parquet.bloom.filter.enabled#{c}", "true")
    return writer.option("parquet.bloom.filter.adaptive.enabled", "true") if found else writer


def _versioned(table: str) -> StructType:
    return StructType([*TABLES[table].fields, StructField("version", IntegerType())])


class LogStore:
    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root.rstrip("/")

    def path(self, table: str) -> str:
        return f"{self.root}/table={table}" if table in PARTITIONED else f"{self.root}/{table}"

    def create_table(self, name: str) -> None:
        """K1 for one table (``IF NOT EXISTS``): its folder, which many writers can make at once. Schemas
        are named by every reader, so a table without rows needs no file."""
        claims.make_folder(self.spark, self.path(name))

    def create_tables(self) -> list[str]:
        """K1: create every table that does not exist yet."""
        for name in TABLES:
            self.create_table(name)
        return list(TABLES)

    def read(self, table: str, datasource_id: int | None = None) -> DataFrame:
        """A table, optionally one data source (partition pruned)."""
        schema = TABLES[table]
        if table in REGISTRY:
            log = self.spark.read.schema(_versioned(table)).parquet(self.path(table))
            return log.groupBy("id").agg(F.max_by(F.struct(*schema.fieldNames()), "version").alias("row")).select("row.*")
        df = self.spark.read.schema(schema).option("basePath", self.path(table)).parquet(self.path(table))
        df = df.select(*schema.fieldNames())
        if datasource_id is not None:
            df = df.filter(F.col("datasource_id") == int(datasource_id))
        return df

    # ---- ids: unique across imports, like an auto-increment key.
    def _claims_path(self, table: str) -> str:
        return f"{self.root}/_meta/{table}_ids"

    def reserve_ids(self, table: str) -> int:
        """Reserve a block of 2^SLAB_BITS ids before anything is written and return its first
        id. A block is a file that can be created once, so it belongs to one import, also if that
        fails later, and imports at once get different blocks. Rows that were appended with ids of
        their own are respected."""
        taken = claims.names(self.spark, self._claims_path(table))
        slab = max((int(n[5:]) for n in taken if n.startswith("slab-")), default=-1) + 1
        if slab == 0 or any(n.startswith("given-") for n in taken):
            self.create_table(table)
            stored = self.read(table).agg(F.max("id")).first()[0]
            slab = max(slab, 0 if stored is None else (int(stored) >> SLAB_BITS) + 1)
        while not claims.create_once(self.spark, f"{self._claims_path(table)}/slab-{slab:06d}"):
            slab += 1
        if slab >= 1 << (63 - SLAB_BITS):
            raise RuntimeError(f"{table} has no block of ids left")
        return slab << SLAB_BITS

    def _new_ids(self, table: str) -> F.Column:
        local = F.monotonically_increasing_id()
        task, row = F.shiftright(local, 33), local.bitwiseAND(F.lit((1 << 33) - 1))
        fits = (task < F.lit(1 << (SLAB_BITS - TASK_BITS))) & (row < F.lit(1 << TASK_BITS))
        return F.when(fits, F.lit(self.reserve_ids(table)) + F.shiftleft(task, TASK_BITS) + row) \
            .otherwise(F.raise_error(F.lit(f"more than 2^{TASK_BITS} rows in one task: use more partitions")).cast("bigint"))

    def append(self, table: str, df: DataFrame, new_ids: bool = False) -> None:
        """K2/K3: append rows; partition folders per data source.

        ``new_ids`` gives the rows ids of a block that is reserved before the write: first id
        + task number * 2^TASK_BITS + row in the task (a task with more rows fails with a
        message; deal its rows out over more partitions). Otherwise given ids are kept. Fact
        rows are sorted by time inside each task, so Parquet row-group statistics follow time
        and time-window reports skip most row groups; Bloom filters of the addresses let reports
        on one address skip those that do not hold it."""
        cols = TABLES[table].fieldNames()
        if "id" in cols and new_ids:
            df = df.withColumn("id", self._new_ids(table))
        elif "id" in cols:
            claims.create_once(self.spark, f"{self._claims_path(table)}/given-{uuid.uuid4().hex}")
        rows = df.select(*cols)
        if "time" in cols:
            rows = rows.sortWithinPartitions("datasource_id", "time")
        _with_filters(rows.write, cols).mode("append").partitionBy("datasource_id").parquet(self.path(table))

    def import_lines(self, lines: DataFrame, kind: str, log_type="type", tz: str = "UTC", positions: dict | None = None) -> None:
        """S10 + S11 + K2/K3: one job that reads and parses every line once and writes the rows to
        their table and the lines that gave none, with the reason, to ``rejects``. ``lines`` has
        ``line`` and ``datasource_id``."""
        table = KIND_TABLES[kind]
        for name in (table, "rejects"):
            self.create_table(name)
        fields = [f for f in TABLES[table].fieldNames() if f not in ("id", "datasource_id")]
        tagged = tagged_lines(lines, kind, log_type, tz=tz, positions=positions)
        is_row = F.col("row").isNotNull()
        rows = tagged.select(
            F.when(is_row, table).otherwise("rejects").alias("table"), F.col("datasource_id").cast("int").alias("datasource_id"),
            F.when(is_row, self._new_ids(table)).alias("id"), *[F.col("row")[f].alias(f) for f in fields],
            F.when(~is_row, kind).alias("kind"), F.when(~is_row, F.col("line")).alias("line"), "reason")
        rows = rows.sortWithinPartitions("table", "datasource_id", "time")
        _with_filters(rows.write, rows.columns).mode("append").partitionBy("table", "datasource_id").parquet(self.root)

    def replace_source(self, table: str, datasource_id: int, df: DataFrame) -> None:
        """K4/K5: replace one data source's rows."""
        self.replace_sources(table, df, [datasource_id])

    def replace_sources(self, table: str, df: DataFrame, datasource_ids) -> None:
        """K4/K5 for several sources in one job. The result is computed and written first
        (dynamic partition overwrite: a source's old files go when the job commits, and stay
        if it fails); sources that got no row are emptied afterwards (D18)."""
        ids = [int(i) for i in datasource_ids]
        schema = TABLES[table]
        self.create_table(table)
        seen = Observation(f"replaced_{uuid.uuid4().hex[:8]}")
        rows = df.filter(F.col("datasource_id").isin(*ids)).select(*schema.fieldNames())
        rows = rows.observe(seen, F.collect_set("datasource_id").alias("sources"))
        _with_filters(rows.write, rows.columns).mode("overwrite").option("partitionOverwriteMode", "dynamic") \
            .partitionBy("datasource_id").parquet(self.path(table))
        written = {int(i) for i in seen.get.get("sources") or []}
        empty = empty_table(self.spark, schema).drop("datasource_id")
        for i in ids:
            if i not in written:
                empty.write.mode("overwrite").parquet(f"{self.path(table)}/datasource_id={i}")

    def register_views(self) -> list[str]:
        """Q1: every stored table as a temporary view of its name, for free SQL."""
        for name in TABLES:
            self.create_table(name)
            self.read(name).createOrReplaceTempView(name)
        return list(TABLES)

    def register_tables(self, database: str) -> list[str]:
        """K1 + Q1: every stored table in Spark's catalog, for free SQL without temporary views: fact
        tables as partitioned external tables with their partitions, registry tables as views of
        their last versions. Row counts and column statistics (distinct values, ranges, nulls) are
        taken, one scan a table, so that the cost-based planner can order joins by them
        (``spark.sql.cbo.enabled``, which ``build_session`` sets); call it again after imports."""
        spark = self.spark
        spark.sql(f"CREATE DATABASE IF NOT EXISTS `{database}`")
        for name, schema in TABLES.items():
            self.create_table(name)
            full, ddl = f"`{database}`.`{name}`", ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
            if name in REGISTRY:
                spark.sql(f"DROP VIEW IF EXISTS {full}")
                spark.sql(f"DROP TABLE IF EXISTS `{database}`.`{name}_log`")
                spark.sql(f"CREATE TABLE `{database}`.`{name}_log` ({ddl}, version int) USING parquet LOCATION '{self.path(name)}'")
                fields = ", ".join(schema.fieldNames())
                spark.sql(f"CREATE VIEW {full} AS SELECT last.* FROM (SELECT max_by(struct({fields}), version) AS last FROM `{database}`.`{name}_log` GROUP BY id)")
                full = f"`{database}`.`{name}_log`"
            else:
                spark.sql(f"DROP TABLE IF EXISTS {full}")       # external: the rows stay
                spark.sql(f"CREATE TABLE {full} ({ddl}) USING parquet PARTITIONED BY (datasource_id) LOCATION '{self.path(name)}'")
                spark.sql(f"MSCK REPAIR TABLE {full}")
            spark.sql(f"ANALYZE TABLE {full} COMPUTE STATISTICS FOR ALL COLUMNS")
        return list(TABLES)

    # ---- registry (K6): one row an imported log source, so a listing and a few rows on the driver.
    def _record(self, table: str, row: dict, version: int) -> bool:
        """Store one version of a row; False if someone else stored that version first."""
        schema = _versioned(table)
        out = io.BytesIO()
        pq.write_table(pa.Table.from_pylist([{**row, "version": version}], schema=to_arrow_schema(schema)), out)
        return claims.create_once(self.spark, f"{self.path(table)}/{int(row['id']):010d}.{version:06d}.parquet", out.getvalue())

    def _versions(self, table: str) -> dict[int, int]:
        """The last version of every id."""
        found: dict[int, int] = {}
        for name in claims.names(self.spark, self.path(table)):
            row_id, version = name.split(".")[:2]
            found[int(row_id)] = max(found.get(int(row_id), 0), int(version))
        return found

    def _add(self, table: str, **fields) -> int:
        row_id = max(self._versions(table), default=0) + 1
        while not self._record(table, {"id": row_id, **fields}, 0):
            row_id += 1
        return row_id

    def add_collection(self, name: str, description: str = "") -> int:
        """K6: store a new collection; its id is its own, whoever else adds one."""
        return self._add("collections", name=name, description=description)

    def add_datasource(self, name: str, log_type: str, collection_id: int, description: str = "") -> int:
        """K6: store a new data source; its id is its own, whoever else adds one."""
        if log_type not in LOG_TYPES:
            raise ValueError(f"unknown log type {log_type!r}; expected one of {LOG_TYPES}")
        return self._add("datasources", collection_id=int(collection_id), name=name, type=log_type, description=description)

    def write_registry(self, collections: DataFrame, datasources: DataFrame) -> None:
        """K6: store rows, also ones that are derived from what is stored: new ids are added, rows
        that differ from their stored version get a next version, nothing is removed."""
        for table, df in (("collections", collections), ("datasources", datasources)):
            self.create_table(table)
            rows = [r.asDict() for r in df.select(*TABLES[table].fieldNames()).collect()]
            stored = {r["id"]: r.asDict() for r in self.read(table).collect()}
            versions = self._versions(table)
            for row in rows:
                if stored.get(row["id"]) != row:
                    version = versions.get(row["id"], -1) + 1
                    while not self._record(table, row, version):
                        version += 1


def write_names_csv(df: DataFrame, path: str, key_col: str, name_col: str = "name") -> None:
    """K7: ``key,name`` lines without a header."""
    df.select(F.col(key_col).cast("string"), F.col(name_col)).write.mode("overwrite").option("header", False).csv(path)
