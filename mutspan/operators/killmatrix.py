"""Kill matrix: which test kills which mutant, scores, merges of run results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import fixed
from ..functions.outcomes import with_runner_kill, worker_failure_text
from ..functions.status import is_true
from ..functions.text import first_match, ratio, safe
from ..session import cut_lineage
from .ordering import best_per_key, first_by


def complete_results(originals: DataFrame, results: DataFrame, runs: DataFrame, timeout_millis: int) -> DataFrame:
    """Outcome counts of all runs (class_name, mutant, original_result, mutant_result, tests), missing results included.

    ``originals`` (class_name, test, original_result), ``results`` (class_name,
    mutant, test, mutant_result), ``runs`` (class_name, mutant, succeeded,
    timed_out, message). A test that a successful run does not report counts as
    "pass". A run that failed, or reported nothing, stands for all tests of its
    class with one text. Defaults are counted per original result, so no grid of
    mutants and tests is built; tests without an original result get none.
    """
    keys = ["class_name", "mutant"]
    recorded = results.join(originals, ["class_name", "test"], "left").groupBy(*keys, "original_result", "mutant_result")
    recorded = cut_lineage(recorded.agg(F.count(F.lit(1)).alias("tests")))  # read by four parts of the result
    reported = recorded.groupBy(*keys, "original_result").agg(F.sum("tests").alias("_reported"))
    any_result = reported.select(*keys).distinct().withColumn("_any", F.lit(True))
    judged = runs.join(any_result, keys, "left").withColumn("_good", is_true("succeeded") & is_true("_any"))
    good, failed = judged.filter("_good"), judged.filter(~F.col("_good"))
    known = originals.filter(F.col("original_result").isNotNull()).groupBy("class_name", "original_result")
    known = known.agg(F.count(F.lit(1)).alias("_all"))
    columns = [*keys, "original_result", "mutant_result", "tests"]
    missing = good.select(*keys).join(known, "class_name").join(reported, [*keys, "original_result"], "left").select(
        *keys, "original_result", F.lit("pass").alias("mutant_result"), (F.col("_all") - F.coalesce("_reported", F.lit(0))).alias("tests")
    )
    text = worker_failure_text(is_true("timed_out"), "message", timeout_millis).alias("mutant_result")
    stood_for = failed.select(*keys, text).join(known.withColumnRenamed("_all", "tests"), "class_name")
    seen = recorded.join(good.select(*keys), keys, "left_semi")
    return seen.select(*columns).unionByName(missing.filter("tests > 0")).unionByName(stood_for.select(*columns))


def with_kills(outcomes: DataFrame) -> DataFrame:
    """Adds kills, the runner's verdict on (original_result, mutant_result).

    Texts are scanned once per distinct pair that differs, not once per row; an
    equal pair never kills. The pairs join back by their texts, as a broadcast
    where the optimizer finds them small.
    """
    texts = ["original_result", "mutant_result"]
    differing = outcomes.select(*texts).filter(~F.col(texts[0]).eqNullSafe(F.col(texts[1]))).distinct()
    judged = with_runner_kill(differing, *texts).withColumnsRenamed({t: f"_{t}" for t in texts})
    met = outcomes.join(judged, [F.col(t).eqNullSafe(F.col(f"_{t}")) for t in texts], "left")
    return met.withColumn("kills", F.coalesce("kills", F.lit(False))).select(*outcomes.columns, "kills")


def mutant_verdicts(kills: DataFrame, keys: list[str], mutants: DataFrame | None = None) -> DataFrame:
    """Killed or live per mutant, with its killing tests.

    With ``mutants``, a mutant whose run left no row is live with no tests.
    """
    # one row per mutant and test first, so that the second aggregate counts and lists without distinct sets
    pairs = kills.groupBy(*keys, "test").agg(F.bool_or("kills").alias("_k"))
    verdicts = pairs.groupBy(*keys).agg(
        F.coalesce(F.bool_or("_k"), F.lit(False)).alias("killed"),
        F.array_sort(F.collect_list(F.when(F.col("_k"), F.col("test")))).alias("killing_tests"),
        F.count("test").alias("tests_run"),
    )
    if mutants is None:
        return verdicts
    every = mutants.select(*keys).distinct().join(verdicts, keys, "left")
    none = F.array().cast(verdicts.schema["killing_tests"].dataType)
    return every.select(
        *keys,
        F.coalesce("killed", F.lit(False)).alias("killed"),
        F.coalesce("killing_tests", none).alias("killing_tests"),
        F.coalesce("tests_run", F.lit(0)).alias("tests_run"),
    )


def mutant_flags(kills: DataFrame, keys: list[str]) -> DataFrame:
    """Whether any test killed a mutant; one flag per mutant leaves each map task."""
    return kills.groupBy(*keys).agg(F.coalesce(F.bool_or("kills"), F.lit(False)).alias("killed"))


def killing_tests(kills: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, test) of every kill, each once: the long form of the lists in `mutant_verdicts`."""
    return kills.groupBy(*keys, "test").agg(F.bool_or("kills").alias("_k")).filter("_k").drop("_k")


def mutants_per_test(kills: DataFrame, keys: list[str]) -> DataFrame:
    """One row (keys, killed_mutants, mutant) per test and mutant that it kills.

    One test may kill a large share of all mutants, so the list stays in its
    long form at every size.
    """
    # filtered after the aggregate: pushed below it, the flag's expression would be repeated in the filter
    pairs = kills.groupBy(*keys, "mutant").agg(F.bool_or("kills").alias("_k")).filter("_k").drop("_k")
    sizes = pairs.groupBy(*keys).agg(F.count(F.lit(1)).alias("killed_mutants"))
    return pairs.join(sizes, keys).select(*keys, "killed_mutants", "mutant")


def kills_per_test(kills: DataFrame) -> DataFrame:
    return kills.filter("kills").groupBy("test").agg(F.count_distinct("mutant").alias("killed_mutants"))


def unpivot_matrix(matrix: DataFrame, id_column: str = "Mutant", other: tuple[str, ...] = ("Total", "Equiv?")) -> DataFrame:
    """Wide result matrix to (mutant, test, kills, equivalent) rows."""
    tests = [c for c in matrix.columns if c != id_column and c not in other]
    mark = F.lower(safe(F.col("`Equiv?`"))) if "Equiv?" in matrix.columns else F.lit("")
    wide = matrix.select(F.col(id_column).alias("mutant"), mark.alias("mark"), *[safe(F.col(f"`{t}`")).alias(t) for t in tests])
    long = wide.unpivot(["mutant", "mark"], tests, "test", "value")
    return long.select("mutant", "test", (F.col("value") == "1").alias("kills"), (F.col("mark") == "y").alias("equivalent"), "mark")


def suite_scores(verdicts: DataFrame, key: str) -> DataFrame:
    """killed / (killed + live) x 100; a mutant that is in both lists is killed."""
    counts = verdicts.groupBy(key).agg(F.count_if("killed").alias("killed"), F.count_if(~F.col("killed")).alias("live"))
    return counts.withColumn("score", ratio(F.col("killed"), F.col("killed") + F.col("live"), 100.0))


def live_minus_killed(live: DataFrame, killed: DataFrame, keys: list[str]) -> DataFrame:
    return live.select(*keys).distinct().join(killed.select(*keys), keys, "left_anti")


def history_scores(states: DataFrame, key: str) -> DataFrame:
    """killed / (killed + live + equivalent), four digits."""
    counts = states.groupBy(key).agg(
        *[F.count_if(F.col("state") == s.upper()).alias(s) for s in ("killed", "live", "equivalent")]
    )
    total = F.col("killed") + F.col("live") + F.col("equivalent")
    return counts.withColumn("total", total).withColumn("score", F.round(ratio(F.col("killed"), total), 4))


def merge_history(history: DataFrame, run: DataFrame, keys: list[str], rerun_equivalents: bool) -> DataFrame:
    """State per mutant after a run: killed beats live; equivalents move only when rerun."""
    old = history.select(*keys, F.col("state").alias("old"))
    new = run.select(*keys, F.col("state").alias("new"))
    state = first_match(
        [
            (F.col("old").eqNullSafe("KILLED"), "KILLED"),
            (F.col("old").eqNullSafe("EQUIVALENT"), F.when(F.col("new").eqNullSafe("KILLED") & F.lit(rerun_equivalents), "KILLED").otherwise("EQUIVALENT")),
            (F.col("new").eqNullSafe("KILLED"), "KILLED"),
        ],
        F.coalesce("old", "new"),
    )
    return old.join(new, keys, "full_outer").select(*keys, state.alias("state"))


def mark_equivalent(history: DataFrame, marks: DataFrame, keys: list[str]) -> DataFrame:
    """Live mutants that a tester marked become equivalent; others stay."""
    marked = marks.select(*keys).distinct().withColumn("_marked", F.lit(True))
    state = F.when(is_true("_marked") & (F.col("state") == "LIVE"), F.lit("EQUIVALENT")).otherwise(F.col("state"))
    return history.join(marked, keys, "left").select(*keys, state.alias("state"))


def mark_equivalent_rows(matrix: DataFrame, marks: DataFrame, keys: list[str]) -> DataFrame:
    """Matrix rows (keys, total, equivalent): a marked mutant becomes equivalent if no test kills it."""
    marked = marks.select(*keys).distinct().withColumn("_marked", F.lit(True))
    flag = (is_true("_marked") & (F.col("total") == 0)) | is_true("equivalent")
    return matrix.join(marked, keys, "left").select(*keys, "total", F.coalesce(flag, F.lit(False)).alias("equivalent"))


def test_set_scores(kills: DataFrame, mutants: DataFrame, sets: DataFrame) -> DataFrame:
    """killed / (all - equivalent) per test set.

    ``kills`` (mutant, test), ``mutants`` (mutant, equivalent), ``sets`` (set_id, test).
    """
    countable = mutants.agg(F.count_if(~is_true("equivalent"))).scalar()
    killed = sets.join(kills, "test").groupBy("set_id").agg(F.count_distinct("mutant").alias("killed"))
    every = sets.select("set_id").distinct().join(killed, "set_id", "left").withColumn("countable", countable)
    return every.select(
        "set_id",
        F.coalesce("killed", F.lit(0)).alias("killed"),
        "countable",
        ratio(F.coalesce("killed", F.lit(0)), F.col("countable")).alias("score"),
    )


def average_score(scores: DataFrame) -> DataFrame:
    return scores.agg(F.count(F.lit(1)).alias("sets"), F.avg("score").alias("average_score"))


def mapped_candidates(
    mutants: DataFrame, tests: DataFrame, order: str = "test_no", fallback: int = fixed.FALLBACK_TESTS_PER_MUTANT
) -> DataFrame:
    """Tests to run per mutant: its own first, then tests of the same method.

    ``fallback`` is the feature's limit. A method's list is cut to one more than
    that before it meets the mutants, so no method emits all pairs. A test that
    is listed twice for one mutant counts once.
    """
    tests = tests.groupBy("class_name", "method", "mutant", "test_set_name").agg(F.min(order).alias(order))
    window = W.partitionBy("class_name", "method", "mutant").orderBy(order)
    primary = first_by(tests, ["class_name", "mutant"], [F.col(order)])
    own = mutants.join(primary, ["class_name", "method", "mutant"], "inner").select(
        "class_name", "method", "mutant", "test_set_name", order, F.lit(0).alias("source")
    )
    head = best_per_key(
        tests.select("class_name", "method", F.col("mutant").alias("test_mutant"), "test_set_name", order),
        ["class_name", "method"],
        [F.col(order)],
        fallback + 1,
        "_head",
    )
    mine = own.select("class_name", "method", "mutant", F.col("test_set_name").alias("own_test"))
    others = (
        mutants.join(head, ["class_name", "method"], "inner")
        .join(mine, ["class_name", "method", "mutant"], "left")
        .filter(~((F.col("test_set_name") == F.col("own_test")) & (F.col("test_mutant") == F.col("mutant"))) | F.col("own_test").isNull())
    )
    limited = others.withColumn("_rn", F.row_number().over(window)).filter(F.col("_rn") <= fallback)
    every = own.unionByName(limited.select("class_name", "method", "mutant", "test_set_name", order, F.lit(1).alias("source")))
    return every.withColumn(
        "candidate_no", F.row_number().over(W.partitionBy("class_name", "method", "mutant").orderBy("source", order))
    )


def mapped_run_counts(mutants: DataFrame, runs: DataFrame, keys: list[str]) -> DataFrame:
    """Run counts per mutant when runs stop at the first kill.

    ``runs`` holds one row per candidate (``run_no``, kills, timed_out). The stop
    is the smallest killing run number, found by an aggregate before the counts.
    """
    first = runs.groupBy(*keys).agg(F.min(F.when(is_true("kills"), F.col("run_no"))).alias("_stop"))
    done = runs.join(first, keys).filter(F.col("_stop").isNull() | (F.col("run_no") <= F.col("_stop")))
    counts = done.groupBy(*keys).agg(
        F.count_if(F.col("run_no") == 1).alias("primary_runs"),
        F.count_if(F.col("run_no") > 1).alias("fallback_runs"),
        F.count_if(is_true("timed_out")).alias("timeout_runs"),
        F.bool_or(is_true("kills")).alias("killed"),
        F.lit(1).alias("_ran"),
    )
    out = mutants.join(counts, keys, "left")
    return out.select(
        *keys,
        *[F.coalesce(c, F.lit(0)).alias(c) for c in ("primary_runs", "fallback_runs", "timeout_runs")],
        F.coalesce("killed", F.lit(False)).alias("killed"),
        (F.coalesce("timeout_runs", F.lit(0)) > 0).alias("had_timeout"),
        F.col("_ran").isNull().alias("without_test"),
    )


def with_targets(rows: DataFrame, name: str, targets: list[str]) -> DataFrame:
    """Rows whose mutant name holds one of the operator names."""
    wanted = F.array(*[F.lit(t) for t in targets])
    return rows.filter(F.exists(wanted, lambda t: F.col(name).contains(t)))
