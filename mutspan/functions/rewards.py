"""Reward breakdowns as structs of arithmetic columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed
from .status import is_true
from .text import col, safe

COMPONENTS = [
    "compile_reward",
    "original_pass_reward",
    "kill_reward",
    "survived_penalty",
    "repair_penalty",
    "prompt_penalty",
    "time_penalty",
    "timeout_penalty",
    "compile_failure_penalty",
    "original_failure_penalty",
]


def _if(condition: Column, amount: float) -> Column:
    return F.when(condition, F.lit(amount)).otherwise(F.lit(0.0))


def _count(value: Column | str) -> Column:
    return F.greatest(F.lit(0), F.coalesce(col(value), F.lit(0)))


def _costs(repair_rounds, prompt_chars, elapsed_ms) -> dict[str, Column]:
    w = fixed.REWARD
    return {
        "repair_penalty": F.lit(w["per_repair"]) * _count(repair_rounds),
        "prompt_penalty": F.lit(w["per_prompt_char"]) * _count(prompt_chars),
        "time_penalty": F.lit(w["per_second"]) * _count(elapsed_ms) / F.lit(1000.0),
    }


def _breakdown(parts: dict[str, Column], extra: Column | None = None) -> Column:
    total = reduce(lambda a, b: a + b, [parts[name] for name in COMPONENTS])
    if extra is not None:
        total = extra + total
    return F.struct(*[parts[name].alias(name) for name in COMPONENTS], total.alias("total"))


def reward_breakdown(
    compiled, original_passed, killed, repair_rounds, prompt_chars, elapsed_ms, timed_out, original_failed
) -> Column:
    """Ten components and their sum for one finished run."""
    w = fixed.REWARD
    c, p, k, t, f = (is_true(x) for x in (compiled, original_passed, killed, timed_out, original_failed))
    return _breakdown(
        {
            "compile_reward": _if(c, w["compile"]),
            "original_pass_reward": _if(p, w["original_pass"]),
            "kill_reward": _if(k, w["kill"]),
            "survived_penalty": _if(c & p & ~k & ~t, w["survived"]),
            **_costs(repair_rounds, prompt_chars, elapsed_ms),
            "timeout_penalty": _if(t, w["timeout"]),
            "compile_failure_penalty": _if(~c, w["compile_failure"]),
            "original_failure_penalty": _if(f, w["original_failure"]),
        }
    )


def phase_progress(phase: Column | str) -> Column:
    table = F.create_map(*[F.lit(x) for pair in fixed.PHASE_PROGRESS.items() for x in pair])
    return F.coalesce(F.try_element_at(table, F.coalesce(col(phase), F.lit(""))), F.lit(0))


def transition_reward(
    before_phase, after_phase, after_status, compiled, original_passed, killed, timed_out,
    repair_rounds, prompt_chars, elapsed_ms,
) -> Column:
    """Step reward between two states of a mutant.

    Provider and generation failures say nothing about the evidence: all zero.
    """
    w = fixed.TRANSITION_REWARD
    before, after = phase_progress(before_phase), phase_progress(after_phase)
    gain = (after - before).cast("double")
    c, p, k, t = (is_true(x) for x in (compiled, original_passed, killed, timed_out))
    phase = col(after_phase)
    counted = ~F.upper(safe(after_status)).isin(fixed.API_FAILED, fixed.GENERATION_FAILED)
    parts = {
        "compile_reward": F.when(
            c & (gain > 0), F.least(F.lit(w["compile_cap"]), gain * F.lit(w["compile_share"]))
        ).otherwise(0.0),
        "original_pass_reward": _if(p & (after >= 3) & (before < 3), w["original_pass"]),
        "kill_reward": _if(k, w["kill"]),
        "survived_penalty": _if((phase == "TARGET_LIVE") & ~k, w["survived"]),
        **_costs(repair_rounds, prompt_chars, elapsed_ms),
        "timeout_penalty": _if(t, w["timeout"]),
        "compile_failure_penalty": _if(~c, w["not_compiled"]),
        "original_failure_penalty": _if(phase == "ORIGINAL_FAILED", w["original_failure"])
        + _if(gain < 0, w["regression"]),
    }
    neutral = {name: F.when(counted, value).otherwise(F.lit(0.0)) for name, value in parts.items()}
    return _breakdown(neutral, F.when(counted, gain).otherwise(F.lit(0.0)))
