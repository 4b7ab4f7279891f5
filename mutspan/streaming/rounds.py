"""Loop statistics of rounds over a stream, emitted once when a round is closed.

A round is one run's round on one day of its records. The watermark closes it: its tasks
leave the state, their newest records are counted and the row is written once.
Records that are late within the bound still count; later ones do not, and are
reported from the log beside the closed rounds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import first_non_blank
from ..operators.trajectory import loop_counts

ROUND = ["run_id", "outer_loop_round"]


def closed_rounds(log: DataFrame, time: str, bound: str, length: str = "1 day") -> DataFrame:
    """(window, run_id, outer_loop_round, records, counts) of rounds that the watermark has passed."""
    task = first_non_blank("task_id", "mutant_id", "operator")
    key = F.when(task == "", F.concat(F.lit("entry-"), F.col("line_no").cast("string"))).otherwise(task)
    tasks = (
        log.withWatermark(time, bound)
        .groupBy(F.window(time, length), *ROUND, key.alias("task_key"))
        .agg(F.max_by(F.struct("compile_success", "killed", "target_status"), "line_no").alias("r"), F.count(F.lit(1)).alias("task_records"))
    )
    return tasks.groupBy("window", *ROUND).agg(F.sum("task_records").alias("records"), *loop_counts())


def late_records(log: DataFrame, closed: DataFrame, time: str, length: str = "1 day") -> DataFrame:
    """(window, run_id, outer_loop_round, late) of closed rounds that some records came too late for.

    ``log`` is the whole log as a batch; rounds up to the last closed window are compared.
    """
    all_rows = log.groupBy(F.window(time, length), *ROUND).agg(F.count(F.lit(1)).alias("_rows"))
    last = closed.agg(F.max("window.end").alias("_last"))
    passed = all_rows.join(F.broadcast(last), F.col("window.end") <= F.col("_last"))  # one row
    counted = closed.select(F.col("window.start").alias("_start"), *ROUND, F.col("records").alias("_records"))
    met = passed.withColumn("_start", F.col("window.start")).join(counted, ["_start", *ROUND], "left")
    late = F.col("_rows") - F.coalesce("_records", F.lit(0))
    return met.select("window", *ROUND, late.alias("late")).filter("late > 0")
