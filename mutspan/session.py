"""Session defaults and the few settings that library code reads back."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # keyed state of all mutants lives on disk, not on the heap
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}


def build_session(app: str = "mutspan", master: str | None = None, **extra: str) -> SparkSession:
    """Create (or fetch) a session; cluster settings given by spark-submit win."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULTS, **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder, taking the cluster's setting first.

    Only a local session without any setting gets a temporary folder: on a
    cluster a machine-local folder would not survive the loss of an executor.
    """
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", "") or context.getConf().get(
        "spark.checkpoint.dir", ""
    )
    if not configured:
        if not context.master.startswith("local"):
            raise RuntimeError(
                "set spark.checkpoint.dir to a shared folder before running iterative operators"
            )
        configured = os.path.join(tempfile.gettempdir(), "mutspan-checkpoints")
    context.setCheckpointDir(configured)
    return configured


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise an iteration result in the reliable checkpoint folder."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def shared_folder(spark: SparkSession, name: str) -> str:
    """Fresh folder beside the checkpoints, for tables and streams of one run."""
    root = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{root}/{name}-{uuid.uuid4().hex}"
