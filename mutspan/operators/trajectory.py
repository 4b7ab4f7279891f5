"""Append-only run log: repaired records, latest state, attempts, episodes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed, status
from ..functions.keys import backfilled_id, function_id, operator_family, site_id_by_family
from ..functions.status import is_true
from ..functions.text import first_non_blank, safe
from .ordering import first_by, latest_by, with_position

LINE = "line_no"


def resolve_paths(df: DataFrame, paths: dict[str, tuple[str, list[str]]]) -> DataFrame:
    """Bring records of several layouts into one: first usable path per field.

    ``paths`` maps a field to (type, candidate columns or nested paths). Texts
    skip blanks; other types skip nulls and texts that do not parse.
    """
    out = []
    for name, (kind, candidates) in paths.items():
        if kind == "string":
            out.append(first_non_blank(*candidates).alias(name))
        else:
            out.append(F.coalesce(*[safe(c).try_cast(kind) for c in candidates]).alias(name))
    return df.select(*out)


def repaired(df: DataFrame) -> DataFrame:
    """Fill blank statuses and ids; records that still have no id are dropped."""
    return df.withColumns(
        {
            "target_status": status.backfilled_status("target_status", "killed", "compile_success"),
            "mutant_id": backfilled_id("mutant_id", "project", "class_name", "method", "operator"),
        }
    ).filter(F.regexp_replace("mutant_id", ":", "") != "")


def latest_records(df: DataFrame, keys: list[str] | None = None) -> DataFrame:
    return latest_by(df, keys or ["mutant_id"], [F.col(LINE)])


def first_records(df: DataFrame, keys: list[str] | None = None) -> DataFrame:
    return first_by(df, keys or ["mutant_id"], [F.col(LINE)])


def with_display_round(df: DataFrame, block: Column | None = None) -> DataFrame:
    """Add the occurrence index of each record and the round shown for it."""
    return with_position(df, ["mutant_id"], LINE, "occurrence", block).withColumn(
        "display_round",
        F.when(F.col("outer_loop_round") > 0, F.col("outer_loop_round").cast("long")).otherwise(F.col("occurrence")),
    )


def first_non_executed(df: DataFrame) -> DataFrame:
    """First record per mutant whose status says that nothing ran."""
    return first_records(df.filter(status.is_non_executed("target_status")))


def killed_ever(df: DataFrame) -> DataFrame:
    """Latest status per mutant and whether any record ever killed it."""
    return (
        df.groupBy("mutant_id")
        .agg(
            F.max_by("target_status", LINE).alias("last_status"),
            F.max(LINE).alias("last_line_no"),
            F.bool_or(is_true("killed") | (safe("target_status") == fixed.KILLED)).alias("killed_ever"),
        )
        .withColumn("bucket", F.when(F.col("killed_ever"), F.lit("KILLED")).otherwise(F.lit("NOT_KILLED")))
    )


def latest_survivors(df: DataFrame, time: str = "generated_at") -> DataFrame:
    """Latest surviving record per mutant by time; of equal times the later line."""
    alive = df.filter(~is_true("killed") & (safe("target_status") == fixed.SURVIVED))
    return latest_by(alive, ["mutant_id"], [F.col(time), F.col(LINE)])


def with_batch_statistics(df: DataFrame, order: str, block: Column | None = None) -> DataFrame:
    """Totals per function and site, and how many of each came before this row."""
    keyed = df.withColumn("function_key", function_id("project", "class_name", "method")).withColumn(
        "site_key", site_id_by_family("function_key", "operator")
    )
    for key, name in (("function_key", "function"), ("site_key", "site")):
        keyed = with_position(keyed, [key], order, f"{name}_processed", block, f"{name}_total").withColumn(
            f"{name}_processed", F.col(f"{name}_processed") - 1
        )
    return keyed


def attempt_order() -> list[Column]:
    """Best attempt first: rank, flags, then fewer repairs and less time."""
    rank = status.attempt_rank("target_status", "killed", "compile_success", "original_pass", "timed_out")
    return [
        rank,
        is_true("killed"),
        is_true("compile_success"),
        is_true("original_pass"),
        ~is_true("timed_out"),
        -F.coalesce(F.col("repair_rounds").cast("long"), F.lit(fixed.INT_MAX)),
        -F.coalesce(F.col("elapsed_ms").cast("long"), F.lit(2**62)),
        -F.col(LINE),
    ]


def best_attempts(df: DataFrame) -> DataFrame:
    """Best record per mutant; of equal records the earlier one stays."""
    ranked = df.withColumn(
        "attempt_rank", status.attempt_rank("target_status", "killed", "compile_success", "original_pass", "timed_out")
    )
    return latest_by(ranked, ["mutant_id"], attempt_order())


def episodes(df: DataFrame) -> DataFrame:
    """Initial, best and last attempt of every mutant, from one aggregation."""
    view = F.struct("target_status", "reward", "action", LINE)
    best = F.struct(*[c.alias(f"o{i}") for i, c in enumerate(attempt_order())])
    out = df.groupBy("mutant_id").agg(
        F.min_by(view, LINE).alias("initial"),
        F.max_by(view, best).alias("best"),
        F.max_by(view, LINE).alias("last"),
        F.bool_or(is_true("killed")).alias("target_killed"),
        F.count(F.lit(1)).alias("attempts"),
        F.sum(F.coalesce("llm_calls", F.lit(0))).alias("total_llm_calls"),
        F.sum(F.coalesce("compile_calls", F.lit(0))).alias("total_compile_calls"),
        F.sum(F.coalesce("elapsed_ms", F.lit(0))).alias("total_ms"),
    )
    return out.select(
        "mutant_id",
        F.col("initial.target_status").alias("initial_status"),
        F.col("initial.action").alias("initial_action"),
        F.col("initial.reward").alias("initial_reward"),
        F.col("best.target_status").alias("best_status"),
        F.col("best.reward").alias("best_reward"),
        F.col(f"best.{LINE}").alias("best_line_no"),
        F.col("last.target_status").alias("last_status"),
        F.col("last.reward").alias("last_reward"),
        "target_killed",
        "attempts",
        "total_llm_calls",
        "total_compile_calls",
        "total_ms",
    )


def loop_statistics(df: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Counts by status class over the latest record per task (or mutant) key."""
    keyed = df.withColumn(
        "_key",
        first_non_blank("task_id", "mutant_id", "exact_bucket_key", "operator")
        if "exact_bucket_key" in df.columns
        else first_non_blank("task_id", "mutant_id", "operator"),
    ).withColumn("_key", F.when(F.col("_key") == "", F.concat(F.lit("entry-"), F.col(LINE).cast("string"))).otherwise(F.col("_key")))
    keys = [*(by or []), "_key"]
    latest = keyed.groupBy(*keys).agg(
        F.max_by(F.struct("compile_success", "killed", "target_status"), LINE).alias("r")
    )
    return latest.groupBy(*(by or [])).agg(*loop_counts())


def loop_counts() -> list[Column]:
    """Aggregates over the newest record ``r`` of each task."""
    executed = status.is_executed("r.target_status")
    upper = F.upper(safe("r.target_status"))
    dead = is_true("r.killed")
    return [
        F.count(F.lit(1)).alias("total_mutants"),
        F.count_if(is_true("r.compile_success")).alias("compiled"),
        F.count_if(executed).alias("executed"),
        F.count_if(executed & dead).alias("killed"),
        F.count_if(executed & ~dead & (upper == fixed.SURVIVED)).alias("survived"),
        F.count_if(executed & ~dead & (upper == fixed.EQUIVALENT_SUSPECTED)).alias("equivalent_suspected"),
        F.count_if(~executed).alias("not_executed"),
    ]


def operator_families(df: DataFrame) -> DataFrame:
    return df.withColumn("operator_family", operator_family("operator"))
