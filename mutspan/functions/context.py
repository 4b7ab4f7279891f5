"""Feature encodings of a mutant's context: buckets, one-hot, feature vector."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed
from .status import is_true
from .text import col, contains_any, first_match, or_default, safe

SIX_CLASS = "SIX_CLASS"
ONE_HOT = "ONE_HOT"
BASE_DIMENSION = 54


def labels(encoding: str = SIX_CLASS) -> list[str]:
    return fixed.ONE_HOT_OPERATORS if encoding == ONE_HOT else fixed.SIX_CLASSES


def dimension(encoding: str = SIX_CLASS) -> int:
    return BASE_DIMENSION + len(labels(encoding))


def schema_version(encoding: str = SIX_CLASS) -> int:
    """Changes whenever order or length of the vector changes."""
    return 7 if encoding == ONE_HOT else 6


def _class_of(family: Column | str, members: dict[str, list[str]]) -> Column:
    f = F.upper(safe(family))
    return first_match([(f.isin(names), label) for label, names in members.items()], fixed.DEFAULT_CLASS)


def feature_class(family: Column | str) -> Column:
    return _class_of(family, fixed.FEATURE_CLASS_MEMBERS)


def bucket_class(family: Column | str) -> Column:
    return _class_of(family, fixed.BUCKET_CLASS_MEMBERS)


def one_hot(family: Column | str, encoding: str = SIX_CLASS) -> Column:
    """Array of 0/1 over the labels; the last one-hot label takes unknown families."""
    if encoding == ONE_HOT:
        f = F.upper(safe(family))
        known = fixed.ONE_HOT_OPERATORS[:-1]
        wanted = F.when(f.isin(known), f).otherwise(F.lit("OTHER"))
    else:
        wanted = feature_class(family)
    return F.transform(F.array(*map(F.lit, labels(encoding))), lambda x: (x == wanted).cast("double"))


def prompt_size_bucket(size: Column | str) -> Column:
    return first_match([(col(size) <= 8000, "SMALL"), (col(size) <= 20000, "MEDIUM")], "LARGE")


def semantic_bucket(kind: Column | str, forced_branch: Column | str) -> Column:
    k = F.upper(safe(kind))
    return first_match(
        [
            (is_true(forced_branch), "FORCED_BRANCH"),
            (k == "", "UNKNOWN_SEMANTIC"),
            (k.contains("BRANCH_FORCED"), "FORCED_BRANCH"),
            (contains_any(k, ["BOUNDARY", "COMPARISON"]), "BOUNDARY_COMPARISON"),
            (k.contains("RETURN"), "RETURN_ORACLE"),
            (contains_any(k, ["STATE", "FIELD"]), "STATE_OR_FIELD"),
        ],
        "OTHER_SEMANTIC",
    )


def constraint_bucket(status: Column | str) -> Column:
    s = F.upper(safe(status))
    return first_match(
        [
            (s.contains("UNSAT"), "CONSTRAINT_UNSAT"),
            ((s == "") | s.contains("UNKNOWN"), "CONSTRAINT_UNKNOWN"),
            (s.contains("SAT"), "CONSTRAINT_SAT"),
        ],
        "CONSTRAINT_OTHER",
    )


def _bucket_operator(family: Column | str, encoding: str) -> Column:
    return F.upper(or_default(family, "OTHER")) if encoding == ONE_HOT else bucket_class(family)


def _bucket_key(*parts: Column | str) -> Column:
    return F.concat_ws("|", *[or_default(p, "UNKNOWN") for p in parts])


def exact_bucket_key(
    family, receiver, observable, semantic_kind, forced_branch, constraint_status, branch_kind, prompt_size,
    encoding: str = SIX_CLASS,
) -> Column:
    return _bucket_key(
        _bucket_operator(family, encoding),
        receiver,
        observable,
        semantic_bucket(semantic_kind, forced_branch),
        constraint_bucket(constraint_status),
        branch_kind,
        prompt_size_bucket(prompt_size),
    )


def coarse_bucket_key(
    family, observable, semantic_kind, forced_branch, constraint_status, encoding: str = SIX_CLASS
) -> Column:
    return _bucket_key(
        _bucket_operator(family, encoding),
        observable,
        semantic_bucket(semantic_kind, forced_branch),
        constraint_bucket(constraint_status),
    )


def log_share(count: Column | str, maximum: int) -> Column:
    """Count on a log scale where ``maximum`` gives 1."""
    c = F.greatest(F.lit(0), F.coalesce(col(count), F.lit(0)))
    return F.log1p(c.cast("double")) / F.log1p(F.lit(float(maximum)))


def unit(value: Column | str) -> Column:
    """Clamp to [0, 1]; not-a-number and infinities become 0."""
    v = F.coalesce(col(value).cast("double"), F.lit(0.0))
    unusable = F.isnan(v) | (F.abs(v) == F.lit(float("inf")))
    return F.when(unusable, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), v)))


def share(part: Column | str, whole: Column | str) -> Column:
    p, w = F.coalesce(col(part), F.lit(0)), F.coalesce(col(whole), F.lit(0))
    return F.when(w > 0, unit(p / w)).otherwise(F.lit(0.0))


def observable_directness(text: Column | str) -> Column:
    t = F.upper(safe(text))
    return first_match(
        [
            (t.contains("DIRECT_RETURN"), 1.0),
            (t.contains("DIRECT_EXCEPTION"), 0.90),
            (t.contains("DIRECT_FIELD"), 0.85),
            (t.contains("SIMPLE_STATE"), 0.65),
            (contains_any(t, ["MULTI_FIELD", "AGGREGATE"]), 0.35),
            (t.contains("INDIRECT"), 0.15),
        ],
        0.0,
    )


def sample_weight(function_mutants: Column | str) -> Column:
    return F.lit(1.0) / F.sqrt(F.greatest(F.lit(1), F.coalesce(col(function_mutants), F.lit(0))).cast("double"))


# fixed values: order of the feature vector as (kind, source column, scale)
HEAD_FEATURES = [
    ("flag", "use_reflection_fallback", None),
    ("flag", "skip_test_generation", None),
    ("flag", "need_entry_lifted_evidence", None),
    ("flag", "has_successful_reference", None),
    ("flag", "has_kb_context", None),
    ("count", "kb_entry_count", 20),
    ("count", "kb_method_call_count", 100),
    ("count", "kb_field_access_count", 100),
    ("count", "estimated_prompt_size", 60000),
    ("count", "function_mutant_count", 500),
    ("count", "site_mutant_count", 100),
    ("share", "function_processed_count", "function_mutant_count"),
    ("share", "site_processed_count", "site_mutant_count"),
]
TAIL_FEATURES = [
    ("words", "observable_plan_kind", ["EXCEPTION"]),
    ("words", "observable_plan_kind", ["RETURN"]),
    ("words", "observable_plan_kind", ["FIELD", "STATE"]),
    ("words", "test_receiver_strategy", ["CONSTRUCTOR", "NEW"]),
    ("words", "test_receiver_strategy", ["REFLECTION"]),
    ("flag", "kb_owner_instantiable", None),
    ("public", "kb_owner_visibility", None),
    ("flag", "kb_has_accessible_constructor", None),
    ("flag", "kb_has_static_factory", None),
    ("flag", "kb_has_static_method", None),
    ("flag", "kb_has_instance_method", None),
    ("flag", "kb_has_only_factory_construction", None),
    ("count", "kb_exact_callable_signature_count", 40),
    ("count", "kb_forbidden_call_count", 20),
    ("flag", "forced_branch_mutation", None),
    ("flag", "has_canonical_observable", None),
    ("flag", "has_mandatory_infection_constraints", None),
    ("flag", "has_required_non_null_subjects", None),
    ("flag", "has_expected_original_executable", None),
    ("unit", "entry_independent_coverage", 1),
    ("words", "entry_constraint_status", ["UNKNOWN", "UNSAT"]),
    ("count", "mandatory_guard_count", 12),
    ("flag", "has_false_polarity_guard", None),
    ("positive", "mandatory_cofactor_count", None),
    ("count", "mandatory_cofactor_count", 8),
    ("directness", "observable_directness", None),
    ("unit", "entry_controllability_coverage", 1),
    ("flag", "has_previous_result", None),
    ("flag", "previous_compile_success", None),
    ("flag", "previous_original_passed", None),
    ("flag", "previous_killed", None),
    ("count", "previous_repair_rounds", 4),
    ("count", "successful_reference_count", 4),
    ("count", "same_site_successful_count", 20),
    ("count", "same_method_successful_count", 60),
    ("unit", "same_site_compile_success_rate", 1),
    ("unit", "same_site_kill_rate", 1),
    ("unit", "same_method_compile_success_rate", 1),
    ("unit", "same_method_kill_rate", 1),
    ("unit", "best_reference_similarity", 130),
]
CONTEXT_COLUMNS = sorted({name for _, name, _ in HEAD_FEATURES + TAIL_FEATURES} | {"operator_family"})


def _feature(kind: str, source: Column, scale, columns: dict[str, Column]) -> Column:
    if kind == "flag":
        return is_true(source).cast("double")
    if kind == "count":
        return log_share(source, scale)
    if kind == "share":
        return share(source, columns[scale])
    if kind == "words":
        return contains_any(F.upper(safe(source)), scale).cast("double")
    if kind == "public":
        return F.upper(safe(source)).isin("PUBLIC", "").cast("double")
    if kind == "positive":
        return (F.coalesce(source, F.lit(0)) > 0).cast("double")
    if kind == "directness":
        return observable_directness(source)
    return unit(source.cast("double") / F.lit(float(scale)))


def context_vector(available: list[str], encoding: str = SIX_CLASS) -> Column:
    """Feature vector in the fixed order; columns that are absent count as null."""
    present = set(available)
    columns = {name: (F.col(name) if name in present else F.lit(None)) for name in CONTEXT_COLUMNS}

    def block(features):
        return F.array(*[_feature(kind, columns[name], scale, columns) for kind, name, scale in features])

    return F.concat(
        F.array(F.lit(1.0)),
        block(HEAD_FEATURES),
        one_hot(columns["operator_family"], encoding),
        block(TAIL_FEATURES),
    )
