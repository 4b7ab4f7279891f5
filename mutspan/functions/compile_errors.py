"""Compile-error kinds, categories and summaries; reasons for skipped rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed
from .text import col, collapse, contains_all, first_match, safe


def _any_alternative(text: Column, alternatives: list[list[str]]) -> Column:
    return reduce(lambda a, b: a | b, [contains_all(text, words) for words in alternatives])


def compile_error_kind(text: Column | str) -> Column:
    t = F.lower(F.coalesce(col(text), F.lit("")))
    rules = []
    for label, alternatives in fixed.COMPILE_ERROR_KINDS:
        if isinstance(alternatives, str):
            condition = t.contains("cannot find symbol") & t.rlike(fixed.VARIABLE_SYMBOL_PATTERN)
        else:
            condition = _any_alternative(t, alternatives)
        rules.append((condition, label))
    return first_match(rules, "OTHER")


def compile_error_summary(text: Column | str) -> Column:
    """Text behind the first compiler-output marker, on one line."""
    t = safe(text)
    marker = "[javac output]"
    at = F.instr(t, marker)
    return collapse(F.when(at > 0, F.substring(t, at + len(marker), F.length(t))).otherwise(t))


def coarse_compile_category(summary: Column | str) -> Column:
    t = F.lower(safe(summary))
    rules = [(_any_alternative(t, alts), label) for label, alts in fixed.COARSE_COMPILE_CATEGORIES]
    rules.append((t == "", fixed.COARSE_COMPILE_NO_TEXT))
    return first_match(rules, fixed.COARSE_COMPILE_OTHER)


def skip_category(exists: Column, parse_ok: Column, skipped: Column, reason: Column | str) -> Column:
    """Why evidence said to skip a row: label prefix first, then keywords."""
    text = safe(reason)
    prefix = F.regexp_extract(text, r"^([A-Z0-9_]+)\s*(:|$)", 1)
    return first_match(
        [
            (~exists, "MISSING_OUTPUT_JSON"),
            (~parse_ok, "INVALID_OUTPUT_JSON"),
            (~skipped, "NOT_SKIPPED_BY_PROMPT_EVIDENCE"),
            (text == "", "SKIP_WITH_EMPTY_REASON"),
            (prefix != "", prefix),
            (
                text.contains("NO_PUBLIC_OBSERVABLE_FOR_CONSTRUCTOR_STATE_MUTATION"),
                "NO_PUBLIC_OBSERVABLE_FOR_CONSTRUCTOR_STATE_MUTATION",
            ),
            (text.contains("NO_PUBLIC_OBSERVABLE"), "NO_PUBLIC_OBSERVABLE"),
            (
                text.contains("constructor mutates internal/inherited state"),
                "CONSTRUCTOR_STATE_MUTATION_NO_PUBLIC_OBSERVABLE",
            ),
            (text.contains("reflection"), "REFLECTION_RELATED_SKIP"),
        ],
        "OTHER_SKIP_REASON",
    )
