"""Micro-batches that count only once they are listed.

A batch is written to a folder of its own try and then listed in the manifest
with its row count. A try that fails in between leaves a folder that nothing
lists; the restart runs the same batch again from the checkpoint. A batch
that is listed already (its commit to the checkpoint was lost) is not written
again. Readers take the listed folders only and check their row counts.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.errors import AnalysisException

MANIFEST = "batch_id long, folder string, rows long"


def manifest(spark: SparkSession, out: str) -> DataFrame:
    """(batch_id, folder, rows) of all committed batches."""
    try:
        return spark.read.schema(MANIFEST).json(f"{out}/manifest/*")
    except AnalysisException:  # no batch was committed yet
        return spark.createDataFrame([], MANIFEST)


def write_committed(
    rows: DataFrame, out: str, checkpoint: str, mode: str = "append", before_commit: Callable[[int], None] | None = None
) -> StreamingQuery:
    """Write each micro-batch once and list it; ``before_commit`` is called between the two steps."""

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        if not manifest(spark, out).filter(F.col("batch_id") == batch_id).isEmpty():
            return
        folder = f"data/batch-{batch_id}-{uuid.uuid4().hex}"
        batch.write.parquet(f"{out}/{folder}")
        count = spark.read.parquet(f"{out}/{folder}").count()
        if before_commit:
            before_commit(batch_id)
        entry = spark.range(1).select(F.lit(batch_id).cast("long").alias("batch_id"), F.lit(folder).alias("folder"), F.lit(count).cast("long").alias("rows"))
        entry.write.mode("overwrite").json(f"{out}/manifest/{batch_id}")

    return rows.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(write).start()


def read_committed(spark: SparkSession, out: str, schema: str) -> DataFrame:
    """Rows of all committed batches; a folder with another row count than listed is an error."""
    listed = manifest(spark, out).collect()  # one row per micro-batch
    if not listed:
        return spark.createDataFrame([], schema)
    rows = spark.read.schema(schema).parquet(*[f"{out}/{r.folder}" for r in listed])
    found = rows.count()
    if found != sum(r.rows for r in listed):
        raise ValueError(f"{out}: {found} rows in the listed folders, {sum(r.rows for r in listed)} in the manifest")
    return rows


def uncommitted(spark: SparkSession, out: str) -> DataFrame:
    """Files of tries that were never listed, for a cleaner: (path, length)."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").load(f"{out}/data").select("path", "length")
    listed = manifest(spark, out).select(F.regexp_replace("folder", r"^data/", "").alias("_try"))
    return files.withColumn("_try", F.regexp_extract("path", r"/data/([^/]+)/[^/]*$", 1)).join(listed, "_try", "left_anti").drop("_try")
