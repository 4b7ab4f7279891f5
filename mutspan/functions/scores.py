"""Scores and budgets: visibility, reference similarity, prompt sizes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed
from .keys import operator_family
from .text import col, contains_any, first_match, safe


def visibility_score(visibility: Column | str, scale: dict[str, float]) -> Column:
    """Score on one of the three scales in ``fixed``; '' holds the default."""
    v = F.lower(safe(visibility))
    return first_match([(v == name, score) for name, score in scale.items() if name], scale[""])


def relation(same_site: Column, same_method: Column) -> Column:
    return first_match([(same_site, "SAME_SITE"), (same_method, "SAME_METHOD")], "SAME_CLASS")


def similarity_score(
    relation_name: Column | str, operator, ref_operator, observable, ref_observable,
    entry, ref_entry, invocation, ref_invocation, ref_reward,
) -> Column:
    """How close an earlier success is to a target."""

    def same(a, b, points: float) -> Column:
        return F.when(safe(a) == safe(b), F.lit(points)).otherwise(F.lit(0.0))

    base = first_match([(col(relation_name) == "SAME_SITE", 100.0), (col(relation_name) == "SAME_METHOD", 50.0)], 10.0)
    return (
        base
        + same(operator_family(operator), operator_family(ref_operator), 8.0)
        + same(operator, ref_operator, 4.0)
        + same(observable, ref_observable, 5.0)
        + same(entry, ref_entry, 2.0)
        + same(invocation, ref_invocation, 2.0)
        + reward_points(ref_reward)
    )


def reward_points(reward: Column | str) -> Column:
    return F.least(F.lit(5.0), F.greatest(F.lit(0.0), F.coalesce(col(reward), F.lit(0.0))))


def estimated_tokens(text: Column | str) -> Column:
    return F.ceil(F.length(F.coalesce(col(text), F.lit(""))) / F.lit(3.0)).cast("int")


def prompt_budget(attempt: Column | str, compile_error: Column | str, reasoning_only: Column | str) -> Column:
    """Input and output limits: base x stage x error factors, under a hard ceiling."""
    b = fixed.BUDGET
    n = col(attempt)
    error = F.lower(F.coalesce(col(compile_error), F.lit("")))
    repairing = n > 0
    long_text = (F.length(error) > 6000) | contains_any(error, fixed.BUDGET_LONG_WORDS)
    factors = [
        (contains_any(error, fixed.BUDGET_CONSTRUCTOR_WORDS), "constructor"),
        (contains_any(error, fixed.BUDGET_METHOD_WORDS), "method"),
        (contains_any(error, fixed.BUDGET_STUB_WORDS), "stub"),
        (long_text, "long"),
    ]

    def scale(side: str) -> Column:
        out = first_match([(n <= 0, 1.0), (n == 1, b[f"repair1_{side}"])], b[f"repair2_{side}"])
        for condition, name in factors:
            out = out * F.when(repairing & condition, F.lit(b[f"{name}_{side}"])).otherwise(F.lit(1.0))
        return out

    input_scale = scale("input")
    output_scale = scale("output") * F.when(
        repairing & F.coalesce(col(reasoning_only), F.lit(False)), F.lit(b["reasoning_output"])
    ).otherwise(F.lit(1.0))

    def limit(base: int, factor: Column) -> Column:
        hard = F.lit(int(base * b["hard_ratio"]))
        return F.least(hard, F.greatest(F.lit(1), F.ceil(F.lit(float(base)) * factor).cast("int")))

    return F.struct(
        limit(b["input_tokens"], input_scale).alias("input_tokens"),
        limit(b["input_chars"], input_scale).alias("input_chars"),
        limit(b["output_tokens"], output_scale).alias("output_tokens"),
        input_scale.alias("input_scale"),
        output_scale.alias("output_scale"),
    )


def response_code(response: Column | str) -> Column:
    """Code text of a chat response: message content, else plain text, fences off.

    A message that holds only reasoning gives ''; a text that is no response
    object is taken as the code itself.
    """
    raw = F.coalesce(col(response), F.lit(""))
    content = F.get_json_object(raw, "$.choices[0].message.content")
    reasoning = F.get_json_object(raw, "$.choices[0].message.reasoning_content")
    plain = F.get_json_object(raw, "$.choices[0].text")
    chosen = first_match(
        [
            (safe(raw) == "", ""),
            (safe(content) != "", content),
            (reasoning.isNotNull(), ""),
            (safe(plain) != "", plain),
        ],
        raw,
    )
    return strip_fence(chosen)


def strip_fence(text: Column) -> Column:
    fenced = F.regexp_extract(text, r"(?s)```[a-zA-Z]*[ \t]*\r?\n(.*?)```", 1)
    return F.btrim(F.when(text.rlike(r"(?s)```[a-zA-Z]*[ \t]*\r?\n.*?```"), fenced).otherwise(text), F.lit(" \t\n\r"))
