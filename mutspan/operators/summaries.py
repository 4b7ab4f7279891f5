"""Headline metrics of an experiment and counts of feedback events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.attribution import KNOWLEDGE_KILL_CAUSES, Targets, is_kill_actionable, is_retryable
from ..functions.status import is_true
from ..functions.text import ratio, safe


def experiment_metrics(details: DataFrame) -> DataFrame:
    """Compile, execution, target-kill and suite rates with mean stage times.

    ``details`` has one row per target mutant. One row per project; the total
    row has project null.
    """
    grouped = details.rollup("project").agg(
        F.count(F.lit(1)).alias("mutants"),
        F.count_if(is_true("compiled")).alias("compiled"),
        F.count_if(is_true("executed")).alias("executed"),
        F.count_if(is_true("target_killed")).alias("target_killed"),
        F.count_if(is_true("suite_killed")).alias("suite_killed"),
        *[F.avg(c).alias(f"mean_{c}") for c in ("evidence_ms", "generation_ms", "compile_ms", "total_ms", "repair_rounds")],
    )
    total = F.col("mutants")
    return grouped.withColumns(
        {
            "compile_rate": ratio(F.col("compiled"), total, 100.0),
            "execution_rate": ratio(F.col("executed"), total, 100.0),
            "target_kill_rate": ratio(F.col("target_killed"), total, 100.0),
            "mutation_score": ratio(F.col("suite_killed"), total, 100.0),
        }
    )


def feedback_counts(feedback: DataFrame, min_confidence: float, targets: Targets = Targets(), by: list[str] | None = None) -> DataFrame:
    """Feedback events by place of the fault and by what can be done about them."""
    t, s = F.upper(safe("primary_fix")), F.upper(safe("failure_stage"))
    analysed = is_true("analysed")
    kb = analysed & (t == targets.knowledge)
    evidence = analysed & ~kb & ((t == targets.evidence) | (s == targets.evidence))
    generator = analysed & ~kb & ~evidence & ((t == targets.generator) | (s == targets.generator))
    strong = kb & is_true("auto_repairable") & (F.coalesce("confidence", F.lit(0.0)) >= F.lit(min_confidence))
    cause = F.upper(safe("root_cause"))
    imports = F.coalesce(F.size("suspected_imports"), F.lit(0)) > 0
    alive = is_true("compiled") & is_true("original_passed") & ~is_true("killed") & (
        F.upper(safe("target_status")) != "EQUIVALENT_SUSPECTED"
    )
    actionable = F.when(
        analysed,
        is_kill_actionable(
            "compiled", "original_passed", "killed", "target_status", "root_cause", "primary_fix", "failure_stage",
            "confidence", "auto_repairable", "plan_exhausted", targets,
        ),
    ).otherwise(alive & ~is_true("plan_exhausted"))
    return feedback.groupBy(*(by or [])).agg(
        F.count(F.lit(1)).alias("events"),
        F.count_if(kb).alias("knowledge_events"),
        F.count_if(strong).alias("actionable_knowledge"),
        F.count_if(strong & (cause == "MISSING_IMPORT_KNOWLEDGE") & imports).alias("actionable_imports"),
        F.count_if(strong & cause.isin(KNOWLEDGE_KILL_CAUSES)).alias("actionable_other"),
        F.count_if(evidence).alias("evidence_events"),
        F.count_if(generator).alias("generator_events"),
        F.count_if(analysed & ~kb & ~evidence & ~generator).alias("other_events"),
        F.count_if(~is_true("compiled") & is_retryable("target_status", "symptom")).alias("retryable"),
        F.count_if(actionable).alias("actionable_kills"),
    )
