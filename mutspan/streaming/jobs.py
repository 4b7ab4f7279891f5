"""Streaming form of the log reductions.

State lives in Spark's state store (streaming aggregations in update mode). Each
micro-batch writes the changed keys to a folder named by its batch id, replacing
what an earlier try of the same batch left there, so a restart from the
checkpoint neither loses nor doubles a row. Readers take the newest row per key.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import fixed
from ..functions.status import is_true
from ..functions.text import first_non_blank, safe
from ..operators import upserts
from ..operators.bandit import linear_statistics
from ..operators.ordering import latest_by

BATCH = "batch_id"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"


def json_stream(spark: SparkSession, path: str, schema: str, files_per_batch: int = 1000) -> DataFrame:
    """New files of a log folder; broken lines are dropped, as in the batch reader."""
    raw = (
        spark.readStream.schema(f"{schema}, _broken string")
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", "_broken")
        .option("maxFilesPerTrigger", files_per_batch)
        .json(path)
    )
    return raw.filter(F.col("_broken").isNull()).drop("_broken")


def parquet_stream(spark: SparkSession, path: str, like: DataFrame, files_per_batch: int = 1000, pattern: str = "*.parquet") -> DataFrame:
    return (
        spark.readStream.schema(like.schema)
        .option("maxFilesPerTrigger", files_per_batch)
        .option("pathGlobFilter", pattern)
        .parquet(path)
    )


def table_stream(spark: SparkSession, root: str, name: str, like: DataFrame, files_per_batch: int = 1000) -> DataFrame:
    """A table as a stream, kept as one file or as a folder of part files."""
    path = f"{root.rstrip('/')}/{{{name}.parquet}}"  # in braces the name may stand for either; a plain path must be a folder
    return spark.readStream.schema(like.schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def write_updates(
    updates: DataFrame, out: str, checkpoint: str, mode: str = "update", prepare: Callable[[DataFrame], DataFrame] | None = None,
    state_store: str | None = None,
) -> StreamingQuery:
    """Write each micro-batch to its own folder and stop when no input is left.

    ``state_store`` names the provider that this stream needs, whatever the session has; the session keeps its own.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        rows = prepare(batch) if prepare else batch
        rows.write.mode("overwrite").parquet(f"{out}/{BATCH}={batch_id}")

    writer = updates.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(write)
    if state_store is None:
        return writer.start()
    conf = updates.sparkSession.conf
    before = conf.get(PROVIDER, None)
    conf.set(PROVIDER, state_store)
    try:
        return writer.start()  # a stream runs with a copy of the settings at its start
    finally:
        conf.set(PROVIDER, before) if before else conf.unset(PROVIDER)


def append_rows(rows: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Append-only JSON sink."""
    return (
        rows.writeStream.format("json").outputMode("append")
        .option("checkpointLocation", checkpoint)
        .option("path", out)
        .trigger(availableNow=True)
        .start()
    )


def read_state(spark: SparkSession, out: str, keys: list[str]) -> DataFrame:
    """Newest row per key over all micro-batches."""
    rows = spark.read.parquet(out)
    return latest_by(rows, keys, [F.col(BATCH)]).drop(BATCH)


def compact_state(spark: SparkSession, out: str, keys: list[str], target: str) -> None:
    """Newest rows only, in a fresh folder that a later reader can take instead."""
    read_state(spark, out, keys).withColumn(BATCH, F.lit(0)).write.mode("overwrite").partitionBy(BATCH).parquet(target)


# --- reductions -----------------------------------------------------------------------
def mutant_state(log: DataFrame) -> DataFrame:
    """Latest status and whether ever killed, per mutant."""
    return log.groupBy("mutant_id").agg(
        F.max_by("target_status", "line_no").alias("last_status"),
        F.max("line_no").alias("last_line_no"),
        F.bool_or(is_true("killed") | (safe("target_status") == fixed.KILLED)).alias("killed_ever"),
    )


def task_state(log: DataFrame, by: list[str]) -> DataFrame:
    """Latest flags per task key; loop statistics count these rows."""
    return log.withColumn("task_key", first_non_blank("task_id", "mutant_id", "operator")).groupBy(*by, "task_key").agg(
        F.max_by(F.struct("compile_success", "killed", "target_status", "line_no"), "line_no").alias("r")
    ).select(*by, F.col("task_key").alias("task_id"), F.col("task_key").alias("mutant_id"), F.lit("").alias("operator"), "r.*")


def bandit_state(log: DataFrame, key: str) -> DataFrame:
    """Count and reward sum per action and bucket; the mean is their quotient."""
    return log.groupBy(key, "action").agg(F.count(F.lit(1)).alias("samples"), F.sum("reward").alias("reward_sum"))


def feedback_state(events: DataFrame) -> DataFrame:
    """Feedback events merged by their twelve keys."""
    return upserts.upsert_events(events)


def linear_update(dim: int) -> Callable[[DataFrame], DataFrame]:
    """Per-batch sums of the linear model; sums of batches add up."""
    return lambda batch: linear_statistics(batch, dim, ridge=0.0)


def summed_linear_state(spark: SparkSession, out: str, ridge: float) -> DataFrame:
    cells = spark.read.parquet(out).groupBy("action", "part", "row", "col").agg(F.sum("value").alias("value"))
    diagonal: Column = (F.col("part") == "A") & (F.col("row") == F.col("col"))
    return cells.withColumn("value", F.col("value") + F.when(diagonal, F.lit(ridge)).otherwise(F.lit(0.0)))
