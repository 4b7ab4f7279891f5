"""Root cause of a failed run from status columns and signal flags.

The names of the three places where a fault can be mended are labels of the
logs at hand, so they are parameters (``Targets``) and not fixed here.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed
from .status import is_true
from .text import contains_any, first_match, safe


@dataclass(frozen=True)
class Targets:
    """Labels for the fact base, the evidence builder and the test generator."""

    knowledge: str = "KNOWLEDGE_BASE"
    evidence: str = "EVIDENCE_BUILDER"
    generator: str = "TEST_GENERATOR"


FLAG_COLUMNS = [
    "import_in_kb", "import_in_evidence", "entry_in_kb", "entry_in_evidence", "receiver_in_kb",
    "receiver_in_evidence", "reach_in_kb", "reach_in_evidence", "observable_in_kb", "observable_in_evidence",
    "observable_in_prompt", "assertion_in_prompt", "self_update_hint", "core_missing", "core_entry_missing",
    "core_entry_unsatisfied", "core_guards_missing", "core_false_polarity_guard", "core_infection_missing",
    "core_has_cofactors", "core_observable_missing", "core_observable_indirect", "core_oracle_missing",
    "requires_entry_chain", "front_loaded_exception", "boundary_guidance", "symbolic_plan",
]


def root_cause(columns: list[str], targets: Targets = Targets()) -> Column:
    """Struct (stage, cause, confidence, primary_fix, secondary_fix, auto_repairable).

    Needs the columns killed, target_status, failure_reason, timed_out,
    compiled, original_passed, equivalence_suspicion, regeneration_round; each
    of ``FLAG_COLUMNS`` that is absent counts as false.
    """
    kb, ev, gen = targets.knowledge, targets.evidence, targets.generator
    present = set(columns)

    def flag(name: str) -> Column:
        return is_true(name) if name in present else F.lit(False)

    reason = F.lower(safe("failure_reason"))
    status = F.upper(safe("target_status"))
    compiled, passed = is_true("compiled"), is_true("original_passed")

    def says(*words: str) -> Column:
        return contains_any(reason, list(words))

    precheck = reason.contains("semantic precheck failed")
    imports = says("symbol", "import") | (says("package ") & says(" does not exist"))
    entries = says("private access", "has protected access", "cannot be accessed", "non-static method") | (
        says("method") & says("cannot be applied")
    )
    receivers = says(
        "constructor", "cannot be applied to given types", "actual and formal argument lists differ",
        "nullpointerexception",
    )
    path_missed = precheck & says("symbolic", "path constraint", "preferred observable")
    input_missed = precheck & says("distinguishing input", "boundary-sensitive", "default literals")
    import_case = ~compiled & imports
    entry_case = ~compiled & entries
    receiver_case = (~compiled & receivers) | (compiled & ~passed)

    # (condition, stage, cause, confidence, primary, secondary, auto-repairable); first match wins
    rules = [
        (is_true("killed"), "UNKNOWN", "UNCLASSIFIED_FAILURE", 1.0, "", "", False),
        (status == fixed.API_FAILED, gen, "API_TRANSPORT_FAILURE", 1.0, "LLM_API", "", False),
        (status == fixed.GENERATION_FAILED, gen, "GENERATION_PIPELINE_FAILURE", 0.95, gen, "", False),
        (contains_any(reason, fixed.ENVIRONMENT_WORDS), gen, "RUNTIME_CLASSPATH_OR_ENVIRONMENT", 0.96, gen, "", False),
        (is_true("timed_out") | status.contains("TIMEOUT"), gen, "TIMEOUT_OR_BUDGET_LIMIT", 0.95, gen, "", False),
        (import_case & ~flag("import_in_kb"), kb, "MISSING_IMPORT_KNOWLEDGE", 0.90, kb, "", True),
        (import_case & ~flag("import_in_evidence"), ev, "IMPORT_ASSEMBLY_BUG", 0.90, ev, kb, False),
        (import_case, gen, "IMPORT_NOT_USED", 0.85, gen, ev, False),
        (entry_case & ~flag("entry_in_kb"), kb, "MISSING_ENTRY_CANDIDATE", 0.88, kb, "", False),
        (entry_case & ~flag("entry_in_evidence"), ev, "ENTRY_ASSEMBLY_BUG", 0.84, ev, kb, False),
        (entry_case, gen, "ENTRY_NOT_USED", 0.84, gen, ev, False),
        (receiver_case & ~flag("receiver_in_kb"), kb, "MISSING_RECEIVER_CONSTRUCTION", 0.80, kb, "", False),
        (receiver_case & ~flag("receiver_in_evidence"), ev, "ENTRY_ASSEMBLY_BUG", 0.74, ev, kb, False),
        (receiver_case, gen, "RECEIVER_SETUP_WEAK", 0.76, gen, ev, False),
        (~compiled, gen, "COMPILE_REPAIR_WEAK", 0.70, gen, "", False),
        (is_true("equivalence_suspicion"), "CROSS_STAGE", "LIKELY_EQUIVALENT_MUTANT", 0.82, "MANUAL_OR_EQ_RULE", "", False),
        (flag("self_update_hint"), "CROSS_STAGE", "LIKELY_EQUIVALENT_MUTANT", 0.66, "MANUAL_OR_EQ_RULE", gen, False),
        (flag("core_missing"), ev, "CANONICAL_CORE_MISSING", 0.86, ev, "", False),
        (flag("core_entry_missing"), ev, "ENTRY_ASSEMBLY_BUG", 0.82, ev, kb, False),
        (flag("core_entry_unsatisfied"), ev, "ENTRY_CONSTRAINT_UNSATISFIED", 0.84, ev, kb, False),
        (flag("core_guards_missing"), ev, "RIP_REACHABILITY_MISSING", 0.78, ev, "", False),
        (flag("core_false_polarity_guard") & path_missed, gen, "PATH_GUARD_POLARITY_MISMATCH", 0.82, gen, ev, False),
        (flag("core_infection_missing"), ev, "RIP_INFECTION_MISSING", 0.80, ev, "", False),
        (flag("core_has_cofactors") & input_missed, gen, "MANDATORY_COFACTOR_UNSATISFIED", 0.80, gen, ev, False),
        (flag("core_observable_missing"), ev, "OBSERVABLE_PLAN_MISSING", 0.78, ev, "", False),
        (flag("core_observable_indirect"), ev, "OBSERVABLE_TOO_INDIRECT", 0.68, ev, "", False),
        (flag("core_oracle_missing"), ev, "ORACLE_MISMATCH", 0.70, ev, gen, False),
        (~flag("reach_in_evidence") & flag("reach_in_kb"), ev, "RIP_REACHABILITY_MISSING", 0.82, ev, kb, False),
        (~flag("observable_in_evidence") & flag("observable_in_kb"), ev, "OBSERVABLE_PLAN_MISSING", 0.80, ev, kb, False),
        (
            ~flag("observable_in_prompt") & flag("observable_in_evidence"),
            gen, "PROMPT_COMPRESSION_LOSS", 0.78, gen, ev, False,
        ),
        (
            flag("requires_entry_chain") & precheck & says("real entry chain", "guided entry", "bypassed entry"),
            gen, "ENTRY_CHAIN_BYPASSED", 0.83, gen, ev, False,
        ),
        (
            flag("front_loaded_exception")
            & precheck
            & says("front-loaded exception", "null-guard", "exception-only oracle"),
            gen, "FRONT_GUARD_EXCEPTION_BIAS", 0.81, gen, ev, False,
        ),
        (flag("boundary_guidance") & input_missed, gen, "DISTINGUISHING_INPUT_NOT_USED", 0.79, gen, ev, False),
        (flag("symbolic_plan") & path_missed, gen, "SYMBOLIC_PATH_VIOLATED", 0.84, gen, ev, False),
        (flag("assertion_in_prompt"), gen, "ASSERTION_GENERATION_WEAK", 0.76, gen, ev, False),
        (
            (F.coalesce(F.col("regeneration_round"), F.lit(0)) > 0) & says("still", "again", "same", "survived"),
            gen, "REGENERATION_STRATEGY_WEAK", 0.75, gen, "", False,
        ),
    ]
    names = ["stage", "cause", "confidence", "primary_fix", "secondary_fix", "auto_repairable"]

    def outcome(values) -> Column:
        return F.struct(*[F.lit(v).alias(n) for n, v in zip(names, values)])

    fallback = outcome(("CROSS_STAGE", "UNCLASSIFIED_FAILURE", 0.45, "MANUAL_REVIEW", "", False))
    return first_match([(rule[0], outcome(rule[1:])) for rule in rules], fallback)


def is_retryable(status: Column | str, symptom: Column | str) -> Column:
    return F.upper(safe(status)).isin(fixed.RETRYABLE_STATUSES) | F.upper(safe(symptom)).isin(fixed.RETRYABLE_SYMPTOMS)


# fixed values: causes whose repair can lead to a kill
KILL_CAUSES = [
    "ASSERTION_GENERATION_WEAK",
    "OBSERVABLE_PLAN_MISSING",
    "OBSERVABLE_NOT_USED",
    "MISSING_OBSERVABLE_CANDIDATE",
    "MISSING_ENTRY_CANDIDATE",
]
KNOWLEDGE_KILL_CAUSES = ["MISSING_ENTRY_CANDIDATE", "MISSING_RECEIVER_CONSTRUCTION"]


def is_kill_actionable(
    compiled, original_passed, killed, status, cause, target, stage, confidence, auto_repairable, exhausted,
    targets: Targets = Targets(),
) -> Column:
    """True when another round may kill a surviving mutant."""
    t, s = F.upper(safe(target)), F.upper(safe(stage))
    evidence_side = (t == targets.evidence) | (s == targets.evidence)
    can_change = (t == targets.knowledge) | evidence_side
    alive = (
        is_true(compiled) & is_true(original_passed) & ~is_true(killed)
        & (F.upper(safe(status)) != fixed.EQUIVALENT_SUSPECTED)
    )
    known_cause = F.upper(safe(cause)).isin(KILL_CAUSES)
    promising = (evidence_side | (t == targets.generator) | (s == targets.generator)) & (
        (F.coalesce(F.col(confidence) if isinstance(confidence, str) else confidence, F.lit(0.0)) >= 0.60)
        | is_true(auto_repairable)
    )
    return (~is_true(exhausted) | can_change) & alive & (known_cause | promising)
