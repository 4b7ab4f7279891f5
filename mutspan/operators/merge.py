"""Merging execution reports, artifacts and logs with the mutant index."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import fixed
from ..functions.keys import mentions_test
from ..functions.status import is_true
from ..functions.text import first_match, or_default, ratio, safe
from .ordering import best_per_key, first_by, latest_by, match_in_tiers

KEY = ["project", "class_name", "method", "mutant"]
RUN_SUMS = [
    "primary_runs", "fallback_runs", "original_successes", "original_failures", "mutants_without_test", "timeout_runs",
    "timeout_mutants", "elapsed_ms",
]


# --- index ------------------------------------------------------------------
def collapse_index(index: DataFrame, order: str = "row_no") -> DataFrame:
    """One row per key: first row kept, compiled if any row is, duplicates counted."""
    rest = [c for c in index.columns if c not in KEY and c != "compiled"]
    grouped = index.groupBy(*KEY).agg(
        F.min_by(F.struct(*rest), order).alias("_first"),
        F.bool_or(is_true("compiled")).alias("compiled"),
        F.count(F.lit(1)).alias("index_rows"),
    )
    return grouped.select(*KEY, "_first.*", "compiled", "index_rows")


# --- suite reports ------------------------------------------------------------
def suite_rows(reports: DataFrame) -> DataFrame:
    """One row per (report, mutant) from reports that hold lists and a result map."""
    names = F.array_distinct(
        F.concat(
            F.coalesce("killed_mutants", F.array().cast("array<string>")),
            F.coalesce("live_mutants", F.array().cast("array<string>")),
            F.coalesce(F.map_keys("mutant_results"), F.array().cast("array<string>")),
        )
    )
    return (
        reports.withColumn("mutant", F.explode(names))
        .filter(safe("mutant") != "")
        .withColumns(
            {
                "killed": F.coalesce(F.array_contains("killed_mutants", F.col("mutant")), F.lit(False)),
                "live": F.coalesce(F.array_contains("live_mutants", F.col("mutant")), F.lit(False)),
                "tests": safe(F.try_element_at("mutant_results", F.col("mutant"))),
            }
        )
        .drop("killed_mutants", "live_mutants", "mutant_results")
    )


def match_reports(rows: DataFrame, index: DataFrame) -> DataFrame:
    """Attach index keys: reported project first, then the project read from the path.

    ``tier`` 0 marks rows that the index does not know; callers count them.
    """
    keyed = index.select(*[F.col(c).alias(f"index_{c}") for c in KEY])
    right = [safe(f"index_{c}") for c in KEY]
    tail = [safe(c) for c in KEY[1:]]
    return match_in_tiers(
        rows,
        keyed,
        [([safe("project"), *tail], right), ([safe("scanned_project"), *tail], right)],
        [f"index_{c}" for c in KEY],
    )


def _sorted_set(value: Column) -> Column:
    return F.array_sort(F.collect_set(F.nullif(safe(value), F.lit(""))))


def kill_details(entries: DataFrame, suites: DataFrame) -> DataFrame:
    """One wide row per mutant from target entries and suite rows.

    Both inputs carry the four key columns. They are stacked and reduced in one
    aggregation, so each map task sends one partial row per mutant. A killed run
    counts as primary when its test list names one of the mutant's own tests.
    """
    sums = [c for c in RUN_SUMS if c in suites.columns]
    entry = entries.select(
        *KEY,
        F.lit(1).alias("is_entry"),
        F.lit(0).alias("is_suite"),
        "test_set_name",
        is_true("compiled").alias("compiled"),
        F.upper(or_default("mapping_status", "UNKNOWN")).alias("mapping_status"),
        is_true("original_passed").alias("original_passed"),
        is_true("mutant_executed").alias("mutant_executed"),
        is_true("target_killed").alias("target_killed"),
        "target_status",
        "failure_reason",
    )
    suite = suites.select(
        *KEY,
        F.lit(0).alias("is_entry"),
        F.lit(1).alias("is_suite"),
        is_true("killed").alias("killed"),
        is_true("live").alias("live"),
        safe("tests").alias("tests"),
        is_true("same_method_fallback").alias("same_method_fallback"),
        or_default("suite_status", "UNKNOWN").alias("suite_status"),
        *[F.coalesce(F.col(c), F.lit(0)).alias(c) for c in sums],
    )
    rows = entry.unionByName(suite, allowMissingColumns=True)
    is_entry = F.col("is_entry") == 1

    def ever(name: str) -> Column:
        return F.coalesce(F.bool_or(name), F.lit(False)).alias(f"{name}_ever")

    tests = F.filter(F.transform(F.split(F.col("tests"), ","), safe), lambda t: t != "")
    merged = rows.groupBy(*KEY).agg(
        F.sum("is_suite").alias("report_count"),
        F.sum("is_entry").alias("entry_count"),
        ever("compiled"),
        F.count_if(is_entry & F.col("compiled")).alias("compiled_count"),
        F.count_if(is_entry & ~F.col("compiled")).alias("not_compiled_count"),
        _sorted_set(F.col("mapping_status")).alias("mapping_statuses"),
        ever("original_passed"),
        ever("mutant_executed"),
        ever("target_killed"),
        _sorted_set(F.col("target_status")).alias("target_statuses"),
        _sorted_set(F.col("failure_reason")).alias("failure_reasons"),
        _sorted_set(F.col("test_set_name")).alias("test_set_names"),
        ever("killed"),
        F.count_if("killed").alias("killed_runs"),
        ever("live"),
        F.count_if("live").alias("live_runs"),
        ever("same_method_fallback"),
        _sorted_set(F.col("suite_status")).alias("suite_statuses"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set(tests)))).alias("killing_tests"),
        F.collect_set(F.when(F.col("killed") & (F.col("tests") != ""), F.col("tests"))).alias("_killed_by"),
        F.coalesce(F.bool_or(F.lower("tests").contains("timeout")), F.lit(False)).alias("timeout_related"),
        *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in sums],
    )

    def by_primary(text: Column) -> Column:
        return F.exists("test_set_names", lambda name: mentions_test(text, name))

    return merged.withColumns(
        {
            "killed_by_primary": F.exists("_killed_by", by_primary),
            "killed_by_fallback": F.exists("_killed_by", lambda t: ~by_primary(t)),
            "final_mapping": first_match(
                [
                    (F.array_contains("mapping_statuses", "OK"), "OK"),
                    (F.size("mapping_statuses") == 0, "UNKNOWN"),
                ],
                F.array_join("mapping_statuses", ", "),
            ),
            "final_kill": first_match([(F.col("killed_ever"), "KILLED"), (F.col("live_ever"), "LIVE")], "NOT_REPORTED"),
        }
    ).drop("_killed_by")


def kill_items(entries: DataFrame, suites: DataFrame) -> DataFrame:
    """Distinct names and statuses of each mutant as rows (key, kind, item); blank ones go.

    The long form of the sets in `kill_details`: a mutant may have any number of
    reports, tests and reasons without any row growing.
    """
    entry = {
        "mapping_status": F.upper(or_default("mapping_status", "UNKNOWN")), "target_status": safe("target_status"),
        "failure_reason": safe("failure_reason"), "test_set_name": safe("test_set_name"),
    }
    suite = {"suite_status": F.array(or_default("suite_status", "UNKNOWN")), "killing_test": F.transform(F.split(safe("tests"), ","), safe)}
    kinds = lambda values: F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), x.alias("item")) for k, x in values.items()])).alias("_i")
    rows = entries.select(*KEY, kinds(entry)).select(*KEY, "_i.*")
    lists = suites.select(*KEY, kinds(suite)).select(*KEY, "_i.kind", F.explode("_i.item").alias("item"))
    return rows.unionByName(lists).filter("item <> ''").distinct()


def kill_facts(entries: DataFrame, suites: DataFrame) -> DataFrame:
    """Counts and flags of `kill_details` for mutants in either input, without its sets.

    Whether an own test killed a mutant comes from joins of test names: every
    name that a killing run lists meets the mutant's own names, so names of one
    mutant never meet in one row.
    """
    entry = entries.groupBy(*KEY).agg(
        F.count(F.lit(1)).alias("entry_count"), F.count_if(is_true("compiled")).alias("compiled_count"), F.count_if(~is_true("compiled")).alias("not_compiled_count"),
        *[F.bool_or(is_true(c)).alias(f"{c}_ever") for c in ("compiled", "original_passed", "mutant_executed", "target_killed")],
    )
    sums = [c for c in RUN_SUMS if c in suites.columns]
    suite = suites.groupBy(*KEY).agg(
        F.count(F.lit(1)).alias("report_count"), F.count_if(is_true("killed")).alias("killed_runs"), F.count_if(is_true("live")).alias("live_runs"),
        *[F.bool_or(is_true(c)).alias(f"{c}_ever") for c in ("killed", "live", "same_method_fallback")],
        F.bool_or(F.lower(safe("tests")).contains("timeout")).alias("timeout_related"), *[F.sum(F.coalesce(F.col(c), F.lit(0))).alias(c) for c in sums],
    )
    lists = suites.filter(is_true("killed") & (safe("tests") != "")).select(*KEY, safe("tests").alias("_list")).distinct()
    parts = lists.select(*KEY, "_list", F.explode(F.split("_list", ",")).alias("_t")).withColumn("_p", F.split(safe("_t"), "#"))
    # a name fits a listed test that equals it or goes on behind a '#'
    heads = F.transform(F.sequence(F.lit(1), F.size("_p")), lambda i: F.array_join(F.slice("_p", F.lit(1), i), "#"))
    named = parts.select(*KEY, "_list", F.explode(heads).alias("_name"))
    own = entries.select(*KEY, safe("test_set_name").alias("_name")).filter("_name <> ''").distinct()
    primary = named.join(own, [*KEY, "_name"], "left_semi").select(*KEY, "_list").distinct().withColumn("_own", F.lit(True))
    killers = lists.join(primary, [*KEY, "_list"], "left").groupBy(*KEY).agg(
        F.bool_or(is_true("_own")).alias("killed_by_primary"), F.bool_or(~is_true("_own")).alias("killed_by_fallback")
    )
    met = entry.join(suite, KEY, "full").join(killers, KEY, "left")
    flags = [c for c, kind in met.dtypes if kind == "boolean"]
    filled = met.fillna(False, flags).fillna(0, [c for c in met.columns if c not in flags and c not in KEY])
    return filled.withColumn("final_kill", first_match([(F.col("killed_ever"), "KILLED"), (F.col("live_ever"), "LIVE")], "NOT_REPORTED"))


def not_killed_scopes(details: DataFrame) -> DataFrame:
    """Mutants that the target test, or the whole suite, did not kill; one row per scope."""
    scopes = F.array_compact(
        F.array(
            F.when(~F.col("target_killed_ever"), F.lit("TARGET_NOT_KILLED")),
            F.when(~F.col("killed_ever"), F.lit("SUITE_NOT_KILLED")),
        )
    )
    return details.select(*KEY, F.explode(scopes).alias("scope"), "final_mapping", "final_kill")


# --- baseline reports -----------------------------------------------------------
def match_baseline(reported: DataFrame, index: DataFrame) -> DataFrame:
    """Index keys of baseline report rows; the first tier with a match counts.

    Tiers: (project, class, mutant); statistic file and mutant; (class, mutant).
    A report row that meets several keys keeps them all and is flagged. A blank
    key part matches nothing; only rows without a match go on to the next tier.
    """
    keys = index.select(*[F.col(c).alias(f"index_{c}") for c in KEY], F.col("statistic_file").alias("index_file"))

    class_and_mutant = [("class_name", "index_class_name"), ("mutant", "index_mutant")]
    tiers = [
        [("project", "index_project"), *class_and_mutant],
        [("statistic_file", "index_file"), ("mutant", "index_mutant")],
        class_and_mutant,
    ]
    hits, rest = [], reported
    for number, pairs in enumerate(tiers, start=1):
        usable = keys.filter(reduce(lambda a, b: a & b, [safe(c) != "" for _, c in pairs]))
        condition = [safe(a) == safe(b) for a, b in pairs]
        hits.append(rest.join(usable, condition).withColumn("tier", F.lit(number)))
        rest = rest.join(usable, condition, "left_anti")
    row = W.partitionBy("report_id", "mutant")
    every = reduce(DataFrame.unionByName, hits)
    return every.withColumn("ambiguous", F.count(F.lit(1)).over(row) > 1).drop("index_file")


def baseline_kill_details(matched: DataFrame) -> DataFrame:
    """Baseline outcome per index key: recorded, or inferred from killing tests.

    A run that lists the mutant nowhere still killed it when some test names it.
    """
    named = F.size("killing_tests") > 0
    inferred = ~is_true("killed") & ~is_true("live") & named
    keys = [f"index_{c}" for c in KEY]
    grouped = matched.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("report_count"),
        F.bool_or(is_true("killed") | inferred).alias("killed_ever"),
        F.count_if(is_true("killed") | inferred).alias("killed_runs"),
        F.bool_or(is_true("live")).alias("live_ever"),
        F.count_if(is_true("live")).alias("live_runs"),
        F.count_if(inferred).alias("inferred_runs"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("killing_tests")))).alias("killing_tests"),
        F.bool_or("ambiguous").alias("ambiguous"),
    )
    return grouped.withColumns(
        {
            "final_kill": first_match([(F.col("killed_ever"), "KILLED"), (F.col("live_ever"), "LIVE")], "NOT_REPORTED"),
            "timeout_related": F.exists("killing_tests", lambda t: F.lower(t).contains("timeout")),
        }
    )


def match_unique_triple(reports: DataFrame, index: DataFrame) -> DataFrame:
    """Index row by the full key, else by class, method and mutant when only one row has them."""
    unique = (
        index.groupBy(*[safe(c).alias(f"_t_{c}") for c in KEY[1:]])
        .agg(F.count(F.lit(1)).alias("_n"), F.min(F.struct("project", "index_row")).alias("_triple"))
        .filter(F.col("_n") == 1)
        .drop("_n")
    )
    full = index.groupBy(*[safe(c).alias(f"_f_{c}") for c in KEY]).agg(F.min("index_row").alias("_full"))
    out = reports.join(full, [safe(c) == F.col(f"_f_{c}") for c in KEY], "left").join(
        unique, [safe(c) == F.col(f"_t_{c}") for c in KEY[1:]], "left"
    )
    return out.select(
        *reports.columns,
        F.coalesce("_full", "_triple.index_row").alias("index_row"),
        first_match([(F.col("_full").isNotNull(), "FULL"), (F.col("_triple").isNotNull(), "TRIPLE")], "NONE").alias("matched_by"),
    )


# --- generation logs and artifacts ---------------------------------------------
def join_log_artifacts(log: DataFrame, artifacts: DataFrame) -> DataFrame:
    """Log rows with every artifact of the same method, operator and class."""
    return log.join(artifacts, ["method", "operator", "class_f"], "inner")


def first_artifact_per_method(methods: DataFrame, artifacts: DataFrame, order: str) -> DataFrame:
    return methods.join(first_by(artifacts, ["method"], [F.col(order)]), "method", "inner")


def flag_killed(artifacts: DataFrame, killed: DataFrame, keys: list[str]) -> DataFrame:
    marks = killed.select(*keys).distinct().withColumn("_killed", F.lit(1))
    return artifacts.join(marks, keys, "left").withColumn("is_killed", F.coalesce("_killed", F.lit(0))).drop("_killed")


def complete_pairs(rows: DataFrame, originals: DataFrame, mutants: DataFrame) -> DataFrame:
    """Rows whose original artifact and mutant artifact both exist."""
    return rows.join(originals.select("original_path").distinct(), "original_path", "left_semi").join(
        mutants.select("mutant_path").distinct(), "mutant_path", "left_semi"
    )


def pair_counts(pairs: DataFrame) -> DataFrame:
    return pairs.agg(
        F.count(F.lit(1)).alias("pairs"),
        F.count_distinct("original_path").alias("original_artifacts"),
        F.count_distinct("mutant_path").alias("mutant_artifacts"),
    )


def distinct_counts(rows: DataFrame) -> DataFrame:
    return rows.agg(
        F.count_distinct("class_name").alias("classes"),
        F.count_distinct("method").alias("methods"),
        F.count(F.lit(1)).alias("mutants"),
    )


def missing_artifacts(expected: DataFrame, existing: DataFrame, key: str) -> DataFrame:
    return expected.join(existing.select(key), key, "left_anti")


def missing_counts(expected: DataFrame, existing: DataFrame, key: str, by: str) -> DataFrame:
    """Expected, missing and present artifacts per group."""
    marks = existing.select(key).distinct().withColumn("_there", F.lit(True))
    joined = expected.join(marks, key, "left").withColumn("_there", is_true("_there"))
    return joined.groupBy(by).agg(
        F.count(F.lit(1)).alias("expected"),
        F.count_if("_there").alias("present"),
        F.count_if(~F.col("_there")).alias("missing"),
    )


def artifact_table(rows: DataFrame, kinds: list[str]) -> DataFrame:
    """Artifact counts, missing counts and missing shares per project, with a total row.

    ``rows`` has a project and one boolean column per artifact kind. The total
    row has project null.
    """
    counted = rows.rollup("project").agg(
        F.count(F.lit(1)).alias("mutants"), *[F.count_if(is_true(k)).alias(f"{k}_count") for k in kinds]
    )
    missing = {f"{k}_missing": F.greatest(F.lit(0), F.col("mutants") - F.col(f"{k}_count")) for k in kinds}
    return counted.withColumns(missing).withColumns(
        {f"{k}_missing_pct": ratio(F.col(f"{k}_missing"), F.col("mutants"), 100.0) for k in kinds}
    )


def restore_plan(requests: DataFrame, successes: DataFrame) -> DataFrame:
    """One restore task per test: request with the latest compiled success."""
    latest = latest_successes(successes)
    joined = requests.join(latest, ["module_home", "test_set_name"], "inner")
    return first_by(joined, ["module_home", "test_set_name"], [F.col("request_no")])


def latest_successes(log: DataFrame) -> DataFrame:
    done = log.filter(is_true("compiled") & (safe("test_set_name") != "")).drop("compiled")
    return latest_by(done, ["module_home", "test_set_name"], [F.col("line_no")])


def compile_error_file(files: DataFrame, wanted: int) -> DataFrame:
    """One error file per test: the wanted index, else the lowest order, then path."""
    index = F.regexp_extract("file_name", r"__compile_error_([0-9]+)\.txt$", 1).try_cast("int")
    order = first_match(
        [
            (~F.col("file_name").contains("__compile_error_"), fixed.INT_MAX - 1),
            (index.isNull(), fixed.INT_MAX - 2),
        ],
        index,
    )
    ranked = files.withColumn("error_order", order)
    return first_by(ranked, ["test_name"], [F.col("error_order") != wanted, F.col("error_order"), F.col("file_name")])


def response_file(files: DataFrame, requests: DataFrame) -> DataFrame:
    """Response of the attempt that compiled, else of the highest attempt."""
    attempts = files.withColumn(
        "attempt", F.regexp_extract("file_name", r"__response_([0-9]+)\.json$", 1).try_cast("int")
    ).filter(F.col("attempt").isNotNull())
    joined = requests.join(attempts, "test_name", "inner")
    exact = (F.col("compile_rounds") > 0) & (F.col("attempt") == F.col("compile_rounds") - 1)
    return latest_by(joined, ["test_name"], [exact, F.col("attempt"), F.col("file_name")])


def mapping_statuses(rows: DataFrame, known: DataFrame, order: str = "row_no") -> DataFrame:
    """Mapping status of every request row, first fault first.

    A row that repeats a (method, mutant) pair is not entered as a seen test, so
    test repeats are judged among the remaining rows only. First rows are found
    by aggregates: a row is first when no smaller row number shares its key.
    """
    pair, test = ["class_name", "method", "mutant"], ["class_name", "test_set_name"]
    first_pair = rows.groupBy(*pair).agg(F.min(order).alias("_first_pair"))
    paired = rows.join(first_pair, pair)
    fresh = paired.filter(F.col(order) == F.col("_first_pair"))
    first_test = fresh.groupBy(*test).agg(F.min(order).alias("_first_test"))
    methods = known.select("class_name", "method").distinct().withColumn("_method", F.lit(True))
    mutants = known.select(*pair).distinct().withColumn("_mutant", F.lit(True))
    out = paired.join(first_test, test, "left").join(methods, ["class_name", "method"], "left").join(mutants, pair, "left")
    return out.withColumn(
        "mapping_status",
        first_match(
            [
                (F.col(order) != F.col("_first_pair"), "DUPLICATE_METHOD_MUTANT"),
                (F.col(order) != F.col("_first_test"), "DUPLICATE_TEST_CLASS"),
                (F.col("_method").isNull(), "METHOD_NOT_FOUND"),
                (F.col("_mutant").isNull(), "MUTANT_NOT_FOUND_UNDER_METHOD"),
                (~is_true("compiled"), "TEST_NOT_COMPILED"),
            ],
            "OK",
        ),
    ).select(*rows.columns, "mapping_status")


# --- execution summaries ---------------------------------------------------------
def method_summary(details: DataFrame) -> DataFrame:
    """Execution summary per project, class and method.

    ``details`` has one row per mutant with the flags generated, compiled,
    executed, target_killed, suite_killed, suite_live.
    """
    counts = details.groupBy("project", "class_name", "method").agg(
        F.count(F.lit(1)).alias("mutants"),
        F.count_if(is_true("generated")).alias("generated_tests"),
        F.count_if(is_true("compiled")).alias("compiled_tests"),
        F.count_if(is_true("executed")).alias("executed_tests"),
        F.count_if(is_true("executed") & is_true("target_killed")).alias("target_killed"),
        F.count_if(is_true("suite_killed")).alias("suite_killed"),
        F.count_if(is_true("suite_live")).alias("suite_live"),
        first_match([(F.bool_and(is_true("reported")), "OK")], "MISSING").alias("suite_status"),
    )
    return _with_scores(counts)


def class_summary(methods: DataFrame) -> DataFrame:
    """Roll-up of the method summaries; PARTIAL when a method is not OK."""
    sums = ["mutants", "generated_tests", "compiled_tests", "executed_tests", "target_killed", "suite_killed", "suite_live"]
    counts = methods.groupBy("project", "class_name").agg(
        F.count(F.lit(1)).alias("methods"),
        *[F.sum(c).alias(c) for c in sums],
        F.when(F.bool_and(F.col("suite_status") == "OK"), F.lit("OK")).otherwise(F.lit("PARTIAL")).alias("suite_status"),
    )
    return _with_scores(counts)


def _with_scores(counts: DataFrame) -> DataFrame:
    return counts.withColumns(
        {
            "compile_rate": ratio(F.col("compiled_tests"), F.col("generated_tests"), 100.0),
            "target_score": ratio(F.col("target_killed"), F.col("executed_tests"), 100.0),
            "suite_score": ratio(F.col("suite_killed"), F.col("suite_killed") + F.col("suite_live"), 100.0),
        }
    )


def failure_groups(rows: DataFrame, keep: int, by: list[str] | None = None) -> DataFrame:
    """Missing-evidence groups: counts, representative, first ``keep`` members.

    The representative is the first row with source and error text, else the
    first row. Members are cut to ``keep`` before they meet in one row.
    """
    keys = by or ["project", "class_name", "method"]
    preferred = is_true("java_exists") & is_true("error_exists")
    counts = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("mutants"),
        F.count_if(is_true("java_exists")).alias("java_exists"),
        F.count_if(is_true("class_exists")).alias("class_exists"),
        F.count_if(is_true("error_exists")).alias("error_exists"),
        F.count_if(is_true("graph_exists")).alias("graph_exists"),
        F.count_if(~is_true("graph_exists")).alias("graph_missing"),
        F.min_by("mutant", F.struct(~preferred, "row_no")).alias("representative"),
    )
    members = first_members(rows, keys, keep).select(*keys, F.transform("_members", lambda m: m["mutant"]).alias("members"))
    return counts.join(members, keys).withColumn("omitted", F.col("mutants") - F.size("members"))


def first_members(rows: DataFrame, keys: list[str], keep: int) -> DataFrame:
    """First ``keep`` (row_no, mutant) of each group, cut before they meet in one row."""
    first = best_per_key(rows.select(*keys, "row_no", "mutant"), keys, [F.col("row_no")], keep)
    return first.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("row_no", "mutant"))).alias("_members"))


def nested_failures(rows: DataFrame, keep: int, by: list[str] | None = None) -> DataFrame:
    """Failure groups in the nested form of the grouped file: statistics, representative, first members."""
    keys = by or ["project", "class_name", "method"]
    groups = failure_groups(rows, keep, keys).join(first_members(rows, keys, keep), keys)
    stats = {
        "mutantCount": "mutants", "javaExistsCount": "java_exists", "classExistsCount": "class_exists",
        "selectedCompileErrorExistsCount": "error_exists", "graphExistsCount": "graph_exists", "graphMissingCount": "graph_missing",
    }
    return groups.select(
        F.concat_ws("::", *keys).alias("groupKey"), F.col("class_name").alias("className"),
        F.struct(*[F.col(c).alias(n) for n, c in stats.items()]).alias("stats"),
        F.struct(F.col("representative").alias("operator")).alias("representative"),
        F.transform("_members", lambda m: F.struct(m["row_no"].alias("rowIndex"), m["mutant"].alias("operator"))).alias("mutants"),
        F.col("omitted").cast("long").alias("omittedMutantCount"),
    )


def write_back_suite(log: DataFrame, suites: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Result log with suite fields replaced where a suite row exists."""
    fresh = suites.select(*keys, F.struct(*columns).alias("_suite"))
    joined = log.join(fresh, keys, "left")
    updated = [
        F.coalesce(F.col("_suite")[c], F.col(c)).alias(c) if c in columns else F.col(c) for c in log.columns
    ]
    return joined.select(*updated)


def skip_existing(tasks: DataFrame, outputs: DataFrame, key: str, first: int | None, last: int | None) -> DataFrame:
    """Tasks in a row range whose output is not there yet."""
    chosen = tasks
    if first is not None:
        chosen = chosen.filter(F.col("row_no") >= first)
    if last is not None:
        chosen = chosen.filter(F.col("row_no") <= last)
    return chosen.join(outputs.select(key), key, "left_anti")
