"""Session construction and shared-folder helpers.

Jobs never write to a machine-local temporary folder on a cluster: scratch
data and lineage cuts go below the folder named by ``spark.checkpoint.dir``.
A local folder is created only when that setting is absent (tests, local runs).
"""
from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import SparkSession

DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.cbo.enabled": "true",                    # used where tables have statistics (LogStore.register_tables)
    "spark.sql.cbo.joinReorder.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(master: str | None = "local[*]", app_name: str = "loglens",
                  shuffle_partitions: int | None = None, conf: dict | None = None) -> SparkSession:
    """A session. ``master=None`` leaves the master to spark-submit; shuffle partitions are
    set only when given, so that the cluster's own setting holds otherwise."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    settings = {**DEFAULT_CONF, **(conf or {})}
    if shuffle_partitions is not None:
        settings["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    checkpoint_root(spark)
    return spark


_LOCAL_FALLBACK: dict[str, str] = {}


def _local_folder(key: str, master: str) -> str:
    """A folder of this machine, for sessions that run on it alone."""
    if not re.fullmatch(r"local(\[[^\]]*\])?", master or ""):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share: "
                           f"a machine-local folder would lose rows on {master!r}")
    return _LOCAL_FALLBACK.setdefault(key, tempfile.mkdtemp(prefix="loglens-checkpoint-"))


def checkpoint_root(spark: SparkSession) -> str:
    """The shared checkpoint folder, as the session names it. Only a session on one machine
    (``local[n]``) gets a folder of its own when none is named; others raise."""
    try:
        sc = spark.sparkContext
    except Exception:   # a remote (Connect) session has no SparkContext
        return spark.conf.get("spark.checkpoint.dir", None) or _local_folder(str(id(spark)), spark.conf.get("spark.master", ""))
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = sc.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        configured = _local_folder(sc.applicationId, sc.master)
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


def default_parallelism(spark: SparkSession) -> int:
    """Task slots of the cluster (falls back to the shuffle partition setting)."""
    try:
        return int(spark.sparkContext.defaultParallelism)
    except Exception:
        return int(spark.conf.get("spark.sql.shuffle.partitions", "8"))


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder path below the shared checkpoint folder."""
    return f"{checkpoint_root(spark).rstrip('/')}/scratch/{name}-{uuid.uuid4().hex[:12]}"
