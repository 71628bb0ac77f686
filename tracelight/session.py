"""Session settings the engine relies on, and the shared scratch folder."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession

# Later keys win when a JSON object repeats a key, and timestamps are read as UTC.
_RUNTIME_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.variant.allowDuplicateKeys": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Wide generated methods beyond the JIT's 8 KB limit run interpreted, so fall back before that.
    "spark.sql.codegen.hugeMethodLimit": "8000",
    # Stateful operators keep several variables per key, which only this store offers; it also holds
    # state beyond the memory of an executor.
    "spark.sql.streaming.stateStore.providerClass": (
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    ),
}

CHECKPOINT_CONF = "spark.checkpoint.dir"


def prepare_session(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to an existing session; returns it for chaining."""
    for key, value in _RUNTIME_CONF.items():
        spark.conf.set(key, value)
    return spark


def shared_folder(spark: SparkSession) -> str:
    """Folder for checkpoints and intermediate tables, seen by the driver and all executors.

    A cluster names it in ``spark.checkpoint.dir``. Where that is unset it is the folder ``_scratch`` of
    the warehouse, if that is no local path or all of Spark runs on this machine; else it is an error.
    """
    configured = spark.conf.get(CHECKPOINT_CONF, None) or spark.sparkContext.getConf().get(
        CHECKPOINT_CONF, None
    )
    if not configured:
        warehouse = spark.conf.get("spark.sql.warehouse.dir").rstrip("/")
        remote = "://" in warehouse and not warehouse.startswith("file:")
        if not remote and not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"set {CHECKPOINT_CONF} to a folder that the driver and all executors reach")
        configured = f"{warehouse}/_scratch"
        spark.conf.set(CHECKPOINT_CONF, configured)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(configured)
    return configured


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, unused path below the shared folder."""
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
