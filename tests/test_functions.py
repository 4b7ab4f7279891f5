"""Hand-computed values of scalar functions."""

import pytest
from pyspark.sql import functions as F

from mutspan.functions import attribution, compile_errors, context, fixed, keys, outcomes, rewards, scores, signatures, status, text


def one(spark, **columns):
    row = spark.range(1).select(*[c.alias(n) for n, c in columns.items()]).collect()[0]
    return row.asDict()


def value(spark, column):
    return one(spark, v=column)["v"]


def test_reward_of_a_kill(spark):
    b = rewards.reward_breakdown(*map(F.lit, (True, True, True, 1, 100, 2000, False, False)))
    got = value(spark, b).asDict()
    assert got["compile_reward"] == 0.5 and got["original_pass_reward"] == 0.5 and got["kill_reward"] == 7.0
    assert got["total"] == pytest.approx(8.0 - 0.2 - 0.01 - 0.002)


def test_reward_of_a_compile_failure_with_timeout(spark):
    b = rewards.reward_breakdown(*map(F.lit, (False, False, False, 2, 0, 0, True, True)))
    assert value(spark, b)["total"] == pytest.approx(-0.4 - 3.0 - 4.0 - 4.0)


def test_transition_is_neutral_for_provider_failures(spark):
    def step(status_text, phase):
        return value(
            spark,
            rewards.transition_reward(*map(F.lit, ("COMPILED", phase, status_text, True, True, False, False, 0, 0, 0))),
        )["total"]

    assert step("API_FAILED", "CRASHED") == 0.0
    assert step("SURVIVED", "TARGET_LIVE") == pytest.approx(-2.5)


def test_bucket_keys_have_seven_and_four_parts(spark):
    exact = context.exact_bucket_key(*map(F.lit, ("ROR", "NEW", "RETURN", "boundary", False, "UNSAT", None, 9000)))
    coarse = context.coarse_bucket_key(*map(F.lit, ("ROR", "RETURN", "boundary", False, "UNSAT")))
    assert value(spark, exact) == "RELATIONAL_BRANCH|NEW|RETURN|BOUNDARY_COMPARISON|CONSTRAINT_UNSAT|UNKNOWN|MEDIUM"
    assert value(spark, coarse) == "RELATIONAL_BRANCH|RETURN|BOUNDARY_COMPARISON|CONSTRAINT_UNSAT"


@pytest.mark.parametrize("encoding,size", [(context.SIX_CLASS, 60), (context.ONE_HOT, 74)])
def test_vector_dimension(spark, encoding, size):
    assert context.dimension(encoding) == size
    x = value(spark, context.context_vector([], encoding))
    # constant one, one label, public-like owner
    assert len(x) == size and sum(x) == 3.0


def test_unit_takes_no_infinity(spark):
    got = one(spark, a=context.unit(F.lit(float("inf"))), b=context.unit(F.lit(float("nan"))), c=context.unit(F.lit(2.0)), d=context.unit(F.lit(-1.0)))
    assert list(got.values()) == [0.0, 0.0, 1.0, 0.0]


def test_phase_and_actions(spark):
    phase = status.phase(*map(F.lit, ("survived", False, True, True, False, False)))
    assert value(spark, phase) == "TARGET_LIVE"
    assert value(spark, status.allowed_actions(F.lit(None))) == ["INITIAL_GENERATION", "TERMINATE"]
    assert value(spark, status.action_allowed(F.lit("TARGET_KILLED"), F.lit("INPUT_STRENGTHEN"))) is False
    assert set(fixed.ALLOWED_ACTIONS) >= set(fixed.PHASE_PROGRESS)


@pytest.mark.parametrize(
    "raw,canonical,legacy",
    [
        (" p :: C::m()::AOIS_1 ", "p::C::m()::AOIS_1", "AOIS_1"),
        ("/a/b/p/##C##m##X_1", "p::C::m::X_1", "X_1"),
        ("a::b::c", "a::b::c", "a::b::c"),
        ("a:: ::c::d", "", "d"),
        ("x\\traditional_mutants\\m()\\ROR_2\\A.java", "x\\traditional_mutants\\m()\\ROR_2\\A.java", "ROR_2"),
        ("x/traditional_mutants/m", "x/traditional_mutants/m", "m"),
        (None, "", ""),
    ],
)
def test_ids(spark, raw, canonical, legacy):
    got = one(spark, a=keys.normalize_id(F.lit(raw)), b=keys.legacy_mutant_name(F.lit(raw)))
    assert (got["a"], got["b"]) == (canonical, legacy)


def test_mutant_numbers_and_families(spark):
    got = one(spark, a=keys.mutant_number(F.lit("AOIS_12")), b=keys.mutant_number(F.lit("AOIS")), c=keys.operator_family(F.lit("_1")), d=keys.row_number_of_task(F.lit("row-7")), e=keys.row_number_of_task(F.lit("row-x")))
    assert list(got.values()) == [12, fixed.INT_MAX, "_1", 7, None]


@pytest.mark.parametrize(
    "raw,want",
    [
        ("public java.util.Map<String, List<Integer>> Owner#find(java.util.List<java.util.Map<A, B>>, int...)", "find(List,int[])"),
        ("a.b.Outer$Inner.run(final a.b.C$D)", "run(D)"),
        ("noparens", ""),
        ("f()", "f()"),
    ],
)
def test_signatures(spark, raw, want):
    assert value(spark, signatures.canonical_signature(F.lit(raw))) == want


def test_wildcard_arity(spark):
    got = one(
        spark,
        a=signatures.wildcard_constructor_arity(F.lit("a.Box"), F.lit(""), F.lit("Box()")),
        b=signatures.wildcard_constructor_arity(F.lit("a.Box"), F.lit("Box"), F.lit("Box(*, *)")),
        c=signatures.wildcard_constructor_arity(F.lit("a.Box"), F.lit("run"), F.lit("Box(*)")),
        d=signatures.wildcard_constructor_arity(F.lit("a.Box"), F.lit("super"), F.lit("Box(int)")),
        e=signatures.wildcard_constructor_arity(F.lit(None), F.lit("super"), F.lit("Box(*)")),
    )
    assert list(got.values()) == [0, 2, -1, -1, -1]


@pytest.mark.parametrize(
    "original,current,kills,reason",
    [
        ("pass", "pass", False, "SAME_RESULT"),
        ("pass", "boom", True, "EXCEPTION_MISMATCH"),
        ("pass", "time_out: more than 5 milliseconds", True, "TIMEOUT_ASYMMETRY"),
        ("time_out: more than 5 milliseconds", "boom", False, "TIMEOUT_ASYMMETRY"),
        ("pass", "java.lang.StackOverflowError", True, "EXCEPTION_MISMATCH"),
        ("java.lang.StackOverflowError", "boom", False, "EXCEPTION_MISMATCH"),
        ("pass", "worker_error: NoClassDefFoundError", False, "INFRA_UNCERTAIN"),
        ("x; LinkageError instance of a.B", "y; LinkageError instance of a.C", False, "INFRA_UNCERTAIN"),
        ("", "pass", True, "OUTPUT_DIFFERENT"),
        (None, None, False, "SAME_RESULT"),
        (None, "boom", True, "EXCEPTION_MISMATCH"),
        ("boom at line 3", "boom at line 9", True, "SAME_RESULT"),
    ],
)
def test_kill_rules(spark, original, current, kills, reason):
    df = spark.createDataFrame([(original, current)], "o string, c string")
    row = outcomes.with_kill_decision(outcomes.with_runner_kill(df, "o", "c"), "o", "c").collect()[0]
    assert (row["kills"], row["reason"]) == (kills, reason)


def test_compile_error_precedence(spark):
    got = one(
        spark,
        a=compile_errors.compile_error_kind(F.lit("cannot find symbol\n  symbol:   variable x\n method")),
        b=compile_errors.compile_error_kind(F.lit("cannot find symbol symbol: method run()")),
        c=compile_errors.compile_error_kind(F.lit(None)),
        d=compile_errors.coarse_compile_category(F.lit(" ")),
        e=compile_errors.compile_error_summary(F.lit("x [javac output]\n a\t b ")),
    )
    assert list(got.values()) == ["UNDEFINED_VARIABLE_OR_SETUP_MISMATCH", "METHOD_NOT_FOUND", "OTHER", fixed.COARSE_COMPILE_NO_TEXT, "a b"]


def test_response_code(spark):
    fenced = '{"choices":[{"message":{"content":"t\\n```java\\nclass A {}\\n```"}}]}'
    silent = '{"choices":[{"message":{"content":"","reasoning_content":"x"}}]}'
    got = one(spark, a=scores.response_code(F.lit(fenced)), b=scores.response_code(F.lit(silent)), c=scores.response_code(F.lit("class B {}")), d=scores.response_code(F.lit(None)))
    assert list(got.values()) == ["class A {}", "", "class B {}", ""]


def test_text_helpers(spark):
    got = one(
        spark,
        a=text.join_reasons(F.array(F.lit("x"), F.lit(""), F.lit("y"), F.lit("x"))),
        b=text.clip(F.lit("abcdef"), 3, "!"),
        c=text.first_non_blank(F.lit(None), F.lit(" "), F.lit(" z ")),
        d=text.contains_any(F.lit("abc"), ["q", "w", "e", "bc"]),
    )
    assert list(got.values()) == ["x; y", "abc!", "z", True]


def test_root_cause_labels_are_parameters(spark):
    df = spark.createDataFrame(
        [(False, "", "error: cannot find symbol", False, False, False, False, 0)],
        "killed boolean, target_status string, failure_reason string, timed_out boolean, compiled boolean, original_passed boolean, equivalence_suspicion boolean, regeneration_round int",
    )
    got = df.select(attribution.root_cause(df.columns, attribution.Targets(knowledge="KB")).alias("c")).collect()[0]["c"]
    assert got["cause"] == "MISSING_IMPORT_KNOWLEDGE" and got["primary_fix"] == "KB" and got["auto_repairable"]
