"""Small text expressions used by every other module."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

WHITESPACE = " \t\n\r\f\x0b"


def col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def safe(value: Column | str) -> Column:
    """Null becomes '' and surrounding whitespace goes: the key form of a text."""
    return F.btrim(F.coalesce(col(value).cast("string"), F.lit("")), F.lit(WHITESPACE))


def blank(value: Column | str) -> Column:
    return safe(value) == F.lit("")


def or_default(value: Column | str, default: str) -> Column:
    text = safe(value)
    return F.when(text == "", F.lit(default)).otherwise(text)


def first_non_blank(*values: Column | str) -> Column:
    """First text that is not blank, else ''."""
    return F.coalesce(*[F.nullif(safe(v), F.lit("")) for v in values], F.lit(""))


def lower(value: Column | str) -> Column:
    return F.lower(safe(value))


def contains_any(text: Column, words: list[str]) -> Column:
    """True when the text holds one of the words.

    Long lists go through a literal array: unrolled, they would make the stage's
    generated method too long for the JIT; one alternation pattern would try
    every word at every character.
    """
    if len(words) > 3:
        return F.exists(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(text, w))
    return reduce(lambda a, b: a | b, [text.contains(w) for w in words])


def contains_all(text: Column, words: list[str]) -> Column:
    return reduce(lambda a, b: a & b, [text.contains(w) for w in words])


def let(value: Column, body) -> Column:
    """Bind an expression once for a body that refers to it several times.

    Optimizer rules copy expressions into filters and join keys; a bound value
    keeps such copies small however often the body uses it.
    """
    return F.get(F.transform(F.array(value), body), 0)


def first_match(rules: list[tuple[Column, object]], default: object) -> Column:
    """Ordered rule table as one CASE expression; a null condition never matches."""
    expr = None
    for condition, result in rules:
        value = result if isinstance(result, Column) else F.lit(result)
        expr = F.when(condition, value) if expr is None else expr.when(condition, value)
    last = default if isinstance(default, Column) else F.lit(default)
    return last if expr is None else expr.otherwise(last)


def collapse(value: Column | str) -> Column:
    return F.btrim(F.regexp_replace(safe(value), r"\s+", " "), F.lit(" "))


def clip(value: Column | str, limit: int, marker: str) -> Column:
    """Cut a text after ``limit`` characters and say so with ``marker``."""
    text = F.coalesce(col(value), F.lit(""))
    return F.when(F.length(text) > limit, F.concat(F.substring(text, 1, limit), F.lit(marker))).otherwise(text)


def clip_with_count(value: Column | str, limit: int) -> Column:
    """Cut a text and name the number of characters left out."""
    text = F.coalesce(col(value), F.lit(""))
    marker = F.concat(
        F.lit("\n\n...[TRUNCATED "), (F.length(text) - limit).cast("string"), F.lit(" CHARS]...")
    )
    return F.when(F.length(text) > limit, F.concat(F.substring(text, 1, limit), marker)).otherwise(text)


def join_reasons(reasons: Column) -> Column:
    """Join reason texts in order, without blanks and repeats."""
    return F.array_join(F.array_distinct(F.filter(reasons, lambda r: safe(r) != "")), "; ")


def to_json_list(values: Column) -> Column:
    return F.to_json(values)


def from_json_list(text: Column) -> Column:
    return F.from_json(text, "array<string>")


def ratio(part: Column, whole: Column, scale: float = 1.0) -> Column:
    """Zero-safe share; the denominator decides, never an error."""
    return F.when(whole > 0, part * F.lit(float(scale)) / whole).otherwise(F.lit(0.0))
