"""Status of every mutant over a stream, with state for unfinished mutants only.

State holds one small row per mutant. A killed mutant is finished: when its
last record is older than `idle` in event time, a timer takes its state away. Each
micro-batch emits the mutants that it changed; a finished mutant that comes back
starts anew, and readers combine all its emitted rows, so nothing is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..functions import fixed
from ..functions.status import is_true
from ..functions.text import safe

STATE = "last_line_no long, last_status string, killed_ever boolean, due_ms long"
#: Timers and state of one processor are column families, which the default provider lacks.
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
OUT = "mutant_id string, last_status string, last_line_no long, killed_ever boolean"


class LatestStatus(StatefulProcessor):
    """Newest status and whether ever killed; finished mutants leave the state after `idle_ms`."""

    def __init__(self, idle_ms: int):
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("status", STATE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        line, status, killed, due = self.state.get() if self.state.exists() else (None, None, False, None)
        seen = None
        for part in rows:
            last = part.loc[part["line_no"].idxmax()]
            if line is None or last["line_no"] >= line:
                line, status = int(last["line_no"]), last["target_status"]
            killed = bool(killed or part["dead"].any())
            newest = int(part["seen_ms"].max())
            seen = newest if seen is None else max(seen, newest)
        if due is not None:
            self.handle.deleteTimer(due)
        due = max(seen + self.idle_ms, due or 0) if killed else None
        if due is not None:
            due = max(due, timerValues.getCurrentWatermarkInMs() + 1)  # a timer lies in the future
            self.handle.registerTimer(due)
        self.state.update((line, status, killed, due))
        yield pd.DataFrame({"mutant_id": [key[0]], "last_status": [status], "last_line_no": [line], "killed_ever": [killed]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.state.exists() and self.state.get()[3] == expiredTimerInfo.getExpiryTimeInMs():
            self.state.clear()
        return iter(())

    def close(self) -> None:
        pass


def mutant_status(log: DataFrame, time: str, bound: str, idle_ms: int) -> DataFrame:
    """Changed mutants per micro-batch; records may come up to `bound` late."""
    rows = log.withWatermark(time, bound).select(
        "mutant_id", "line_no", "target_status", time,
        F.coalesce(is_true("killed") | (safe("target_status") == fixed.KILLED), F.lit(False)).alias("dead"),
        F.unix_millis(F.col(time).cast("timestamp")).alias("seen_ms"),
    )
    return rows.groupBy("mutant_id").transformWithStateInPandas(LatestStatus(idle_ms), OUT, "Update", "EventTime")


def read_mutant_status(spark: SparkSession, out: str) -> DataFrame:
    """Newest status per mutant over all micro-batches; a kill counts whichever of them saw it."""
    return spark.read.parquet(out).groupBy("mutant_id").agg(
        F.max_by("last_status", "last_line_no").alias("last_status"), F.max("last_line_no").alias("last_line_no"), F.bool_or("killed_ever").alias("killed_ever")
    )
