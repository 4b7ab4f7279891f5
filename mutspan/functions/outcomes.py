"""Execution outcome texts: normal forms, classes and the two kill rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import fixed
from .text import col, contains_any, first_match, safe

# fixed values: (pattern, replacement) of the failure-text normal form, in order
FAILURE_TEXT_MASKS = [
    (r"\bline[:= ]+\d+\b", "line=N"),
    (r"\b:[ ]*\d+\b", ":N"),
    (r"@[0-9a-fA-F]+", "@HEX"),
    (r"more than \d+ milliseconds", "more than N milliseconds"),
    (r"timeout[: ]+\d+", "timeout N"),
    (r"\$Lambda\$\d+/0x[0-9a-fA-F]+", "Lambda/0xHEX"),
]


def normalize_failure_text(text: Column | str) -> Column:
    """Failure text without the parts that change from run to run."""
    out = F.btrim(F.regexp_replace(safe(text), r"\s+", " "), F.lit(" "))
    for pattern, replacement in FAILURE_TEXT_MASKS:
        out = F.regexp_replace(out, pattern, replacement)
    return F.lower(out)


def is_timeout_text(text: Column | str) -> Column:
    t = F.lower(safe(text))
    return contains_any(t, fixed.TIMEOUT_WORDS) | (t.contains("more than ") & t.contains(" milliseconds"))


def is_infrastructure_text(text: Column | str) -> Column:
    return contains_any(F.lower(safe(text)), fixed.INFRASTRUCTURE_WORDS)


def outcome_class(text: Column | str) -> Column:
    t = safe(text)
    return first_match(
        [
            ((t == "") | (F.lower(t) == "pass"), "PASS"),
            (is_timeout_text(t), "TIMEOUT"),
            (is_infrastructure_text(t), "INFRA_ERROR"),
        ],
        "EXCEPTION",
    )


def with_kill_decision(df: DataFrame, original: str, mutant: str, prefix: str = "") -> DataFrame:
    """Add ``killed`` and ``reason`` by the symmetric rules.

    Class and normal form of each text are columns of their own, so each text is
    scanned once per row however often the rules refer to it.
    """
    staged = df.withColumns(
        {
            "_oc": outcome_class(original),
            "_mc": outcome_class(mutant),
            "_on": normalize_failure_text(original),
            "_mn": normalize_failure_text(mutant),
        }
    )
    o, m = F.col("_oc"), F.col("_mc")
    same = (o == m) & ((o == "TIMEOUT") | (F.col("_on") == F.col("_mn")))

    def either(kind: str) -> Column:
        return (o == kind) | (m == kind)

    reason = first_match(
        [
            (same, "SAME_RESULT"),
            (either("TIMEOUT"), "TIMEOUT_ASYMMETRY"),
            (either("INFRA_ERROR"), "INFRA_UNCERTAIN"),
            (either("EXCEPTION"), "EXCEPTION_MISMATCH"),
        ],
        "OUTPUT_DIFFERENT",
    )
    name = f"{prefix}reason"
    return (
        staged.withColumn(name, reason)
        .withColumn(f"{prefix}killed", ~F.col(name).isin("SAME_RESULT", "INFRA_UNCERTAIN"))
        .drop("_oc", "_mc", "_on", "_mn")
    )


def _one_line(text: Column | str) -> Column:
    return safe(F.translate(F.coalesce(col(text), F.lit("")), "\r\n", "  "))


def _runner_normal_form(text: Column | str, loader_pattern: str | None) -> Column:
    out = F.regexp_replace(_one_line(text), r"^[^;]+;\s*", "")
    if loader_pattern:
        out = F.regexp_replace(out, loader_pattern, "USERLOADER")
    out = F.regexp_replace(out, r"instance of [A-Za-z0-9_/$.]+", "instance of CLASSLOADER")
    return F.lower(F.btrim(F.regexp_replace(out, r"\s+", " "), F.lit(" ")))


def with_runner_kill(
    df: DataFrame, original: str, current: str, name: str = "kills", loader_pattern: str | None = None
) -> DataFrame:
    """Add the kill flag of the runner's asymmetric rules.

    A timeout or a resource failure kills only when the original run had none.
    ``loader_pattern`` masks class-loader names that differ between the two runs.
    The flags of each text are staged as columns, so texts are scanned once.
    """
    words = {
        "infra": fixed.RUNNER_INFRASTRUCTURE_WORDS,
        "timeout": fixed.RUNNER_TIMEOUT_WORDS,
        "resource": fixed.RUNNER_RESOURCE_WORDS,
        "strict": fixed.RUNNER_STRICT_INFRASTRUCTURE_WORDS,
    }
    sides = {"o": original, "c": current}
    # equal texts never kill: their flags are not worth scanning for
    differs = ~F.col(original).eqNullSafe(F.col(current))
    staged = df.withColumns({f"_{s}_low": F.when(differs, F.lower(_one_line(text))) for s, text in sides.items()})
    staged = staged.withColumns(
        {f"_{s}_{kind}": contains_any(F.col(f"_{s}_low"), list_) for s in sides for kind, list_ in words.items()}
    )

    def flag(side: str, kind: str) -> Column:
        return F.col(f"_{side}_{kind}")

    same_infra = (
        flag("o", "infra")
        & flag("c", "infra")
        & (_runner_normal_form(original, loader_pattern) == _runner_normal_form(current, loader_pattern))
    )
    rules = [(F.col(original).eqNullSafe(F.col(current)) | same_infra, False)]
    for kind in ("timeout", "resource"):
        rules.append((flag("o", kind) | flag("c", kind), ~flag("o", kind) & flag("c", kind)))
    rules.append((flag("o", "strict") | flag("c", "strict"), False))
    return staged.withColumn(name, first_match(rules, True)).select(*df.columns, name)


def worker_failure_text(timed_out: Column, message: Column | str, timeout_millis: Column | int) -> Column:
    """Text that stands for every test of a run that gave no results."""
    note = safe(message)
    limit = F.lit(timeout_millis) if isinstance(timeout_millis, int) else timeout_millis
    return first_match(
        [
            (timed_out & (note != ""), note),
            (timed_out, F.concat(F.lit("time_out: more than "), limit.cast("string"), F.lit(" milliseconds"))),
            (note != "", F.concat(F.lit("worker_error: "), note)),
        ],
        "worker_error",
    )
