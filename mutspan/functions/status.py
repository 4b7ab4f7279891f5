"""Target statuses, final categories, phases and flags of one run."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed
from .text import col, first_match, safe


def is_true(flag: Column | str) -> Column:
    return col(flag).eqNullSafe(F.lit(True))


def is_false(flag: Column | str) -> Column:
    return col(flag).eqNullSafe(F.lit(False))


def backfilled_status(status: Column | str, killed: Column | str, compiled: Column | str) -> Column:
    """Recorded status, else the one that the two flags imply, else ''."""
    return first_match(
        [
            (safe(status) != "", safe(status)),
            (is_true(killed), fixed.KILLED),
            (is_false(compiled), fixed.COMPILE_FAILED_AFTER_REPAIR),
            (is_true(compiled), fixed.SURVIVED),
        ],
        "",
    )


def is_compile_failure(status: Column | str, compiled: Column | str) -> Column:
    named = F.upper(safe(status)).isin(fixed.COMPILE_FAILURE_STATUSES)
    return named | (is_false(compiled) & (safe(status) == ""))


def final_category(status: Column | str, killed: Column | str, compiled: Column | str) -> Column:
    return first_match(
        [
            ((col(status) == fixed.KILLED) | is_true(killed), fixed.CATEGORY_KILLED),
            (is_compile_failure(status, compiled), fixed.CATEGORY_COMPILE_FAILED),
            ((col(status) == fixed.SURVIVED) | is_true(compiled), fixed.CATEGORY_SURVIVED),
        ],
        fixed.CATEGORY_OTHER,
    )


def category_order(category: Column | str) -> Column:
    c = col(category)
    return first_match(
        [(c == fixed.CATEGORY_KILLED, 0), (c == fixed.CATEGORY_SURVIVED, 1), (c == fixed.CATEGORY_COMPILE_FAILED, 2)],
        3,
    )


def is_executed(status: Column | str) -> Column:
    return F.upper(safe(status)).isin(fixed.EXECUTED_STATUSES)


def is_non_executed(status: Column | str) -> Column:
    return F.upper(safe(status)).isin(fixed.NON_EXECUTED_STATUSES)


def non_executed_status(
    status: Column | str, reason: Column | str, repair_rounds: Column | str, compile_rounds: Column | str
) -> Column:
    """Status of a row that never ran, read from its failure reason when not recorded."""
    text = F.lower(F.coalesce(col(reason), F.lit("")))
    repaired = (F.coalesce(col(repair_rounds), F.lit(0)) > 0) | (F.coalesce(col(compile_rounds), F.lit(0)) > 1)
    return first_match(
        [
            (safe(status) != "", safe(status)),
            (text.startswith("skipped by output.json:"), fixed.SKIPPED_BY_EVIDENCE),
            (
                text.contains("empty visible content") | text.contains("reasoning_content only"),
                fixed.LLM_NO_VISIBLE_CODE,
            ),
            (
                text.contains("finish_reason=length")
                | text.contains("does not contain expected test class")
                | text.contains("llm output truncated"),
                fixed.LLM_OUTPUT_INVALID,
            ),
            (
                text.contains("llm api failed") | text.contains("llm http error") | text.startswith("api failed:"),
                fixed.API_FAILED,
            ),
            (text.startswith("generation failed:"), fixed.GENERATION_FAILED),
            (text.contains("task crashed:"), fixed.TASK_CRASHED),
            (repaired, fixed.COMPILE_FAILED_AFTER_REPAIR),
            (text != "", fixed.COMPILE_FAILED_AFTER_GENERATION),
        ],
        fixed.NOT_EXECUTED,
    )


def executed_status(status: Column | str, reason: Column | str) -> Column:
    """Runner status in the vocabulary of target statuses."""
    text = safe(status)
    upper = F.upper(text)
    timeout = F.lower(text).contains("timeout") | F.lower(F.coalesce(col(reason), F.lit(""))).contains("timeout")
    return first_match(
        [
            (text == "", fixed.TASK_CRASHED),
            (timeout, fixed.TIMEOUT),
            (upper == "LIVE", fixed.SURVIVED),
            (upper == "ERROR", fixed.TASK_CRASHED),
            (upper.isin(fixed.KILLED, fixed.ORIGINAL_FAILED), upper),
        ],
        text,
    )


def phase(status, killed, compiled, original_passed, timed_out, equivalence_suspicion) -> Column:
    """Phase of a run; flags that are absent count as false."""
    s = F.upper(safe(status))
    k, c, p, t, e = (is_true(x) for x in (killed, compiled, original_passed, timed_out, equivalence_suspicion))
    return first_match(
        [
            (e & c & p & ~k, "EQUIVALENT_SUSPECTED"),
            (k | (s == fixed.KILLED), "TARGET_KILLED"),
            (t | (s == fixed.TIMEOUT), "TIMEOUT"),
            (s.isin(fixed.API_FAILED, fixed.GENERATION_FAILED, fixed.TASK_CRASHED), "CRASHED"),
            (~c, "COMPILE_FAILED"),
            ((s == fixed.ORIGINAL_FAILED) | ~p, "ORIGINAL_FAILED"),
        ],
        "TARGET_LIVE",
    )


def allowed_actions(phase_name: Column | str) -> Column:
    table = F.create_map(
        *[x for name, actions in fixed.ALLOWED_ACTIONS.items() for x in (F.lit(name), F.array(*map(F.lit, actions)))]
    )
    start = F.array(F.lit("INITIAL_GENERATION"), F.lit("TERMINATE"))
    return F.coalesce(F.try_element_at(table, F.coalesce(col(phase_name), F.lit(""))), start)


def action_allowed(phase_name: Column | str, action: Column | str) -> Column:
    return F.array_contains(allowed_actions(phase_name), F.coalesce(col(action), F.lit("")))


def symptom(status, killed, compiled, original_passed, timed_out) -> Column:
    s = F.upper(safe(status))
    return first_match(
        [
            (is_true(timed_out), "timeout"),
            (s == fixed.API_FAILED, "api_failed"),
            (s.isin(fixed.GENERATION_FAILED, fixed.LLM_OUTPUT_INVALID, fixed.LLM_NO_VISIBLE_CODE), "generation_failed"),
            (s == fixed.TASK_CRASHED, "task_crashed"),
            (~is_true(compiled), "compile_failed"),
            (~is_true(original_passed), "original_failed"),
            (~is_true(killed), "survived"),
        ],
        "killed",
    )


def equivalent_flag(text: Column | str, fallback: Column | str) -> Column:
    t = F.lower(safe(text))
    return first_match(
        [(t.isin("1", "true", "yes"), "1"), (t.isin("0", "false", "no"), "0"), (is_true(fallback), "1")], "0"
    )


def attempt_rank(status, killed, compiled, original_passed, timed_out) -> Column:
    """How far an attempt came: 5 killed, 4 live, 3 original failed, 2 not compiled, 1 infrastructure."""
    s = F.upper(safe(status))
    broken = is_true(timed_out) | s.isin(
        fixed.API_FAILED, fixed.GENERATION_FAILED, fixed.TASK_CRASHED, fixed.TIMEOUT
    )
    return first_match(
        [
            (is_true(killed) | (s == fixed.KILLED), 5),
            (is_true(compiled) & is_true(original_passed), 4),
            (is_true(compiled), 3),
            (broken, 1),
        ],
        2,
    )
