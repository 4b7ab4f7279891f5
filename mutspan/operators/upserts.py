"""Merge-style writes as set operations: the newer or the stronger value wins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.attribution import Targets
from ..functions.status import is_true
from ..functions.text import safe

EVENT_KEY = [
    "mutant_id", "failure_stage", "root_cause", "primary_fix", "secondary_fix", "symptom", "auto_repairable",
    "why", "signal_ledger", "action", "failure_reason", "run_id",
]
CANDIDATE_KEY = ["event_id", "candidate_kind", "candidate_value", "source_kind", "usage_context", "scope_type", "scope_key"]


def upsert_latest(old: DataFrame, new: DataFrame, keys: list[str], order: str = "seq") -> DataFrame:
    """Rows by key; the values written last win."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    rest = [c for c in old.columns if c not in keys]
    merged = both.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct("_new", order)).alias("_row"))
    return merged.select(*keys, "_row.*").select(*old.columns)


def upsert_events(rows: DataFrame, order: str = "seq") -> DataFrame:
    """Feedback events by their twelve key columns.

    Row id: last that is not null. Confidence: highest. Creation time: first
    that is not blank.
    """
    keyed = rows.withColumns({c: safe(c) for c in EVENT_KEY if c != "auto_repairable"})
    usable = F.when(safe("created_at") != "", F.struct(order, safe("created_at").alias("t")))
    known = F.when(F.col("mutant_row_id").isNotNull(), F.struct(order, "mutant_row_id"))
    return keyed.groupBy(*EVENT_KEY).agg(
        F.max(known)["mutant_row_id"].alias("mutant_row_id"),
        F.max("confidence").alias("confidence"),
        F.coalesce(F.min(usable)["t"], F.lit("")).alias("created_at"),
    )


def upsert_candidates(rows: DataFrame, order: str = "seq") -> DataFrame:
    """Feedback candidates: highest priority, support and acceptance.

    The acceptance time stays once it is set. The very first row may bring one
    without being accepted; later rows only when they are.
    """
    keyed = rows.withColumns({c: safe(c) for c in CANDIDATE_KEY if c != "event_id"})
    first = F.min(F.struct(order, safe("accepted_at").alias("t")))["t"]
    accepted = F.min(F.when((F.col("accepted") == 1) & (safe("accepted_at") != ""), F.struct(order, safe("accepted_at").alias("t"))))["t"]
    return keyed.groupBy(*CANDIDATE_KEY).agg(
        F.max("priority").alias("priority"),
        F.max("support_count").alias("support_count"),
        F.max("accepted").alias("accepted"),
        F.coalesce(F.nullif(first, F.lit("")), accepted, F.lit("")).alias("accepted_at"),
    )


def replace_children(old: DataFrame, new: DataFrame, parents: DataFrame, key: str) -> DataFrame:
    """Children of the refreshed parents come from ``new`` only."""
    return old.join(parents.select(key), key, "left_anti").unionByName(new)


def with_drop_reason(
    feedback: DataFrame, accept_all: bool = False, min_confidence: float = 0.7, auto_only: bool = True,
    targets: Targets = Targets(),
) -> DataFrame:
    """Why a feedback event does not reach the fact base; '' when it does."""
    low = F.coalesce(F.col("confidence"), F.lit(0.0)) < F.lit(min_confidence)
    manual = F.lit(auto_only) & ~is_true("auto_repairable")
    reason = (
        F.when(F.col("analysed") == False, F.lit("NO_ANALYSIS"))  # noqa: E712
        .when(F.upper(safe("primary_fix")) != targets.knowledge, F.lit("OTHER_TARGET"))
        .when(F.lit(accept_all), F.lit(""))
        .when(low, F.lit("LOW_CONFIDENCE"))
        .when(manual, F.lit("NOT_AUTO_REPAIRABLE"))
        .otherwise(F.lit(""))
    )
    return feedback.withColumn("drop_reason", reason)


def funnel_counts(with_reason: DataFrame) -> DataFrame:
    r = F.col("drop_reason")
    return with_reason.agg(
        F.count(F.lit(1)).alias("events"),
        F.count_if(r == "NO_ANALYSIS").alias("no_analysis"),
        F.count_if(r == "OTHER_TARGET").alias("other_target"),
        F.count_if(r == "LOW_CONFIDENCE").alias("low_confidence"),
        F.count_if(r == "NOT_AUTO_REPAIRABLE").alias("not_auto_repairable"),
        F.count_if(r == "").alias("accepted"),
    )
