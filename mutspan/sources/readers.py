"""Readers: each returns a DataFrame with an explicit schema."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.keys import clean_path
from ..functions.text import blank, first_non_blank, safe
from ..operators.trajectory import repaired, resolve_paths
from . import schemas

# fixed values: header names that the index file may use for a column
INDEX_HEADERS = {
    "operator": ["operator"],
    "line": ["line", "line_number"],
    "method": ["method"],
    "class_name": ["class"],
    "class_f": ["class_f"],
    "mutation_statement": ["mutation_statement"],
    "package": ["package"],
    "project": ["project"],
    "file_path": ["file_path"],
    "original_graph_path": ["original_graph_path"],
    "mutant_graph_path": ["mutant_graph_path"],
    "is_killed": ["is_killed", "is_kille"],
    "equivalent": ["equivalent"],
}


def _csv(spark: SparkSession, path, **options):
    reader = spark.read.option("header", True).option("quote", '"').option("escape", '"').option("multiLine", True)
    for key, value in options.items():
        reader = reader.option(key, value)
    return reader.csv(path)


def mutant_index(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Index rows by header name; blank rows go, an unreadable line number is -1."""
    raw = _csv(spark, path)
    given = {c.strip().lower(): c for c in raw.columns}

    def pick(names: list[str]) -> Column:
        found = [F.col(f"`{given[n]}`") for n in names if n in given]
        return first_non_blank(*found) if found else F.lit("")

    columns = {name: pick(names) for name, names in INDEX_HEADERS.items()}
    rows = raw.select(*[c.alias(n) for n, c in columns.items()])
    filled = reduce(lambda a, b: a | b, [~blank(c) for c in INDEX_HEADERS])
    number = F.regexp_extract("line", r"^(-?[0-9]+)(?:\.0+)?$", 1).try_cast("int")
    return rows.filter(filled).withColumn("line", F.coalesce(number, F.lit(-1)))


def positional_index(spark: SparkSession, path: str | list[str], projects: list[str] | None = None) -> DataFrame:
    """Index rows by column position; rows without a full key go, projects may be limited."""
    names = list(INDEX_HEADERS)
    schema = ", ".join(f"{n} string" for n in names)
    rows = spark.read.schema(schema).option("header", True).option("quote", '"').option("escape", '"').option(
        "enforceSchema", True
    ).csv(path)
    complete = reduce(lambda a, b: a & b, [~blank(c) for c in ("operator", "method", "class_name", "project")])
    rows = rows.filter(complete)
    return rows.filter(safe("project").isin(projects)) if projects else rows


def trajectory(spark: SparkSession, path, strict: bool = False) -> DataFrame:
    """Run log in one layout. Strict reading fails on a broken line; else it is skipped."""
    return repaired(resolve_paths(raw_trajectory(spark, path, strict), schemas.TRAJECTORY_PATHS))


def raw_trajectory(spark: SparkSession, path, strict: bool = False) -> DataFrame:
    if strict:
        return spark.read.schema(schemas.TRAJECTORY).option("mode", "FAILFAST").json(path)
    return split_broken(permissive_json(spark, path, schemas.TRAJECTORY))[0]


def permissive_json(spark: SparkSession, path, schema: str) -> DataFrame:
    """JSON lines with the text of broken lines kept in ``_broken``; blank lines go."""
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_broken"}
    lines = spark.read.text(path).filter(~blank("value"))
    return lines.select(F.from_json("value", f"{schema}, _broken string", options).alias("r")).select("r.*")


def split_broken(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(good rows, broken lines); count the second to report how many were skipped."""
    return df.filter(F.col("_broken").isNull()).drop("_broken"), df.filter(F.col("_broken").isNotNull()).select("_broken")


def with_file_order(df: DataFrame) -> DataFrame:
    """Line numbers for logs that carry none: file name, then place inside the file.

    Rows of one file keep their order in ``_metadata`` block start and reading
    order, which grow along the file.
    """
    return df.select(
        "*", F.col("_metadata.file_path").alias("file_path"), F.col("_metadata.file_block_start").alias("block_start"),
        F.monotonically_increasing_id().alias("read_order"),
    )


def feedback(spark: SparkSession, path) -> DataFrame:
    """Failure feedback, flat; ``analysed`` is false where no analysis was stored."""
    raw = split_broken(permissive_json(spark, path, schemas.FEEDBACK))[0]
    a = "failureAnalysis"
    return raw.select(
        F.col("generatedAt").alias("generated_at"), F.col("taskId").alias("task_id"), F.col("mutantId").alias("mutant_id"),
        "project", "action", "compiled", F.col("originalPassed").alias("original_passed"), "killed",
        F.col("targetStatus").alias("target_status"), F.col("failureReason").alias("failure_reason"),
        F.col("failureSymptom").alias("symptom"), F.col("semanticPlanExhausted").alias("plan_exhausted"),
        F.col(a).isNotNull().alias("analysed"), F.col(f"{a}.failureStage").alias("failure_stage"),
        F.col(f"{a}.rootCauseType").alias("root_cause"), F.col(f"{a}.primaryFixTarget").alias("primary_fix"),
        F.col(f"{a}.secondaryFixTarget").alias("secondary_fix"), F.col(f"{a}.why").alias("why"),
        F.col(f"{a}.confidence").alias("confidence"), F.col(f"{a}.autoRepairable").alias("auto_repairable"),
        F.col(f"{a}.suspectedMissingImports").alias("suspected_imports"),
    )


def generation_results(spark: SparkSession, path) -> DataFrame:
    """Generation results with every key seen; preferred columns come first."""
    raw = spark.read.option("primitivesAsString", True).json(path)
    head = [c for c in fixed.GENERATION_COLUMNS if c in raw.columns]
    return raw.select(*head, *sorted(c for c in raw.columns if c not in head))


def failed_compilations(results: DataFrame) -> DataFrame:
    """Rows whose compiled field is false, as a boolean or as text."""
    return results.filter(F.lower(safe(F.col("compiled").cast("string"))) == "false")


def suite_reports(spark: SparkSession, path) -> DataFrame:
    """One row per report file; older key names are accepted."""
    return shape_suite_reports(spark.read.schema(schemas.SUITE_REPORT).option("multiLine", True).json(path))


def shape_suite_reports(raw: DataFrame) -> DataFrame:
    """Report fields under one name each; class and method have three names in the files."""
    counts = {
        "primary_runs": "suitePrimaryRuns",
        "fallback_runs": "suiteFallbackRuns",
        "original_successes": "suiteOriginalSuccessCount",
        "original_failures": "suiteOriginalFailureCount",
        "mutants_without_test": "suiteMutantsWithoutMappedTest",
        "timeout_runs": "suiteTimeoutRuns",
        "timeout_mutants": "suiteTimeoutMutants",
        "elapsed_ms": "suiteElapsedMillis",
    }
    return raw.select(
        F.col("_metadata.file_path").alias("report_id"),
        first_non_blank("targetClassName", "className", "target").alias("class_name"),
        first_non_blank("methodSignatureFilter", "methodSignature", "method").alias("method"),
        F.col("resultModuleHome").alias("module_home"),
        F.col("suiteStatus").alias("suite_status"),
        F.col("suiteFailureReason").alias("suite_failure_reason"),
        F.col("suiteMutantScore").alias("suite_score"),
        F.coalesce("sameMethodFallback", F.lit(False)).alias("same_method_fallback"),
        *[F.coalesce(source, F.lit(0)).alias(name) for name, source in counts.items()],
        F.col("suiteKilledMutants").alias("killed_mutants"),
        F.col("suiteLiveMutants").alias("live_mutants"),
        F.col("suiteMutantResults").alias("mutant_results"),
    )


# fixed values: names under which a target-entry file may keep its array
ENTRY_ARRAYS = ["targetLevelEntries", "testEntries", "entries"]


def target_entries(spark: SparkSession, json_path: str | None, csv_path: str | None) -> DataFrame:
    """Target entries from JSON arrays, and from CSV where a folder has no JSON.

    The array may stand alone or under one of three names.
    """
    item = f"array<struct<{schemas.TARGET_ENTRY.replace(' string', ':string')}>>"
    parts = []
    folder = F.regexp_replace("_metadata.file_path", "/[^/]*$", "")
    if json_path:
        text = spark.read.text(json_path, wholetext=True).select(folder.alias("folder"), "value")
        bare = safe("value").startswith("[")
        listed = F.coalesce(*[F.get_json_object("value", f"$.{name}") for name in ENTRY_ARRAYS])
        items = F.from_json(F.when(bare, F.col("value")).otherwise(listed), item)
        parts.append(text.select("folder", F.explode(items).alias("e")).select("folder", "e.*"))
    if csv_path:
        rows = _csv(spark, csv_path).select(folder.alias("folder"), "*")
        wanted = [c.split()[0] for c in schemas.TARGET_ENTRY.split(", ")]
        rows = rows.select("folder", *[F.col(c) if c in rows.columns else F.lit(None).cast("string").alias(c) for c in wanted])
        if parts:
            rows = rows.join(parts[0].select("folder").distinct(), "folder", "left_anti")
        parts.append(rows)
    return reduce(DataFrame.unionByName, parts)


def quoted_csv(spark: SparkSession, path) -> DataFrame:
    return _csv(spark, path)


def delimited_log(spark: SparkSession, path, columns: list[str], delimiter: str = "####") -> DataFrame:
    """Log lines split at a literal delimiter; missing fields at the end become ''."""
    return split_log_lines(spark.read.text(path), columns, delimiter)


def split_log_lines(lines: DataFrame, columns: list[str], delimiter: str = "####") -> DataFrame:
    parts = F.split(safe("value"), f"\\Q{delimiter}\\E", -1)
    return lines.select(*[F.coalesce(F.get(parts, i), F.lit("")).alias(c) for i, c in enumerate(columns)])


def kill_statistics(spark: SparkSession, path) -> DataFrame:
    """Kill-statistic texts, one row per file, parsed by ``parse_kill_statistics``."""
    raw = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("source_file"), "value")
    return parse_kill_statistics(raw)


# fixed values: section heads of a kill-statistic text, and what starts a map entry
SECTION = r"(?s)(?:^|[;\s]){name}\s*=\s*({body})\s*;"
TEST_KEY = r"[A-Za-z_$][A-Za-z0-9_$.]*#[A-Za-z_$][A-Za-z0-9_$]*"
MUTANT_KEY = r"[A-Z]+_[0-9]+"


def _section(name: str, body: str) -> Column:
    return F.regexp_extract("value", SECTION.replace("{name}", name).replace("{body}", body), 1)


def _items(text: Column) -> Column:
    return F.array_distinct(F.filter(F.transform(F.split(text, ","), safe), lambda x: x != ""))


def _list_section(name: str) -> Column:
    return _items(F.regexp_replace(_section(name, r"\[[^\]]*\]"), r"^\[|\]$", ""))


def _map_section(name: str, key: str) -> Column:
    """``{k=a, b, k2=c}`` to a map: a value runs up to the next key."""
    body = F.regexp_replace(_section(name, r"\{[^}]*\}"), r"^\{|\}$", "")
    marked = F.regexp_replace(body, f"(^|[ ,])({key})\\s*=", "\x01$2\x02")
    entries = F.filter(F.split(marked, "\x01"), lambda e: e.contains("\x02"))
    pairs = F.transform(
        entries,
        lambda e: F.struct(
            safe(F.substring_index(e, "\x02", 1)).alias("key"), _items(F.substring_index(e, "\x02", -1)).alias("value")
        ),
    )
    return F.map_from_entries(F.filter(pairs, lambda p: p["key"] != ""))


def parse_kill_statistics(texts: DataFrame) -> DataFrame:
    """Maps, lists and score of each text; when both lists are empty they follow from the map."""
    sections = texts.select(
        *[c for c in texts.columns if c != "value"],
        _map_section("test_results", TEST_KEY).alias("test_results"),
        _map_section("mutant_results", MUTANT_KEY).alias("mutant_results"),
        _list_section("killed_mutants").alias("_killed"),
        _list_section("live_mutants").alias("_live"),
        F.coalesce(_section("mutant_score", r"[-+0-9.eE]+").try_cast("double"), F.lit(0.0)).alias("mutant_score"),
    )
    inferred = (F.size("_killed") == 0) & (F.size("_live") == 0) & (F.size("mutant_results") > 0)

    def from_map(empty: bool) -> Column:
        return F.map_keys(F.map_filter("mutant_results", lambda k, v: (F.size(v) == 0) == F.lit(empty)))

    return sections.withColumns(
        {
            "killed_mutants": F.when(inferred, from_map(False)).otherwise(F.col("_killed")),
            "live_mutants": F.when(inferred, from_map(True)).otherwise(F.col("_live")),
        }
    ).drop("_killed", "_live")


def killed_list(text: Column) -> Column:
    """Killed mutants of a statistic text; a bare first line without '=' also counts."""
    listed = F.regexp_extract(text, r"(?s)killed_mutants\s*=\s*\[(.*?)\]\s*;?", 1)
    lines = F.filter(F.transform(F.split(text, r"\R"), safe), lambda x: (x != "") & ~x.contains("="))
    bare = F.regexp_replace(F.coalesce(F.get(lines, 0), F.lit("")), r"[\];]", "")
    return _items(F.when(text.rlike(r"killed_mutants\s*=\s*\["), listed).otherwise(bare))


def result_matrix(spark: SparkSession, path) -> DataFrame:
    """Wide mutant x test matrix as read; see ``unpivot_matrix`` for the long form."""
    return spark.read.option("header", True).option("ignoreLeadingWhiteSpace", True).option(
        "ignoreTrailingWhiteSpace", True
    ).csv(path)


def artifacts(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """Files under a root as (path, file_name, length); contents are never read."""
    files = (
        spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root)
    )
    return files.select(clean_path("path").alias("path"), F.substring_index(clean_path("path"), "/", -1).alias("file_name"), "length")


def source_files(spark: SparkSession, root: str, suffix: str = ".java") -> DataFrame:
    """Source files outside of test and generated folders."""
    files = artifacts(spark, root, f"*{suffix}")
    return without_excluded(files, root)


def without_excluded(files: DataFrame, root: str) -> DataFrame:
    base = root.rstrip("/").split("://")[-1].removeprefix("file:")
    inner = F.regexp_replace("path", f"^.*?\\Q{base}\\E/", "")
    excluded = F.exists(F.split(inner, "/"), lambda part: F.lower(part).isin(fixed.EXCLUDED_DIRECTORIES))
    return files.filter(~excluded)


def grouped_failures(spark: SparkSession, path) -> DataFrame:
    """Failure groups of a grouped file, with the file that holds each."""
    return spark.read.schema(schemas.FAILURE_GROUPS).json(path).select("*", F.col("_metadata.file_path").alias("file_path"))


def timing_lines(spark: SparkSession, path) -> DataFrame:
    return parse_timing_lines(spark.read.text(path))


def parse_timing_lines(lines: DataFrame) -> DataFrame:
    """``phase=… elapsedMs=… detail`` lines; others are dropped."""
    rows = lines.select(
        F.regexp_extract("value", r"phase=(\S+)", 1).alias("phase"),
        F.regexp_extract("value", r"elapsedMs=([0-9]+)", 1).try_cast("long").alias("elapsed_ms"),
        safe(F.regexp_extract("value", r"elapsedMs=[0-9]+\s*(.*)$", 1)).alias("detail"),
    )
    return rows.filter((F.col("phase") != "") & F.col("elapsed_ms").isNotNull())


def phase_times(timings: DataFrame) -> DataFrame:
    return timings.groupBy("phase").agg(
        F.count(F.lit(1)).alias("events"), F.sum("elapsed_ms").alias("total_ms"), F.avg("elapsed_ms").alias("mean_ms")
    )


def run_summary(spark: SparkSession, path) -> DataFrame:
    return spark.read.schema(schemas.RUN_SUMMARY).option("header", True).option("sep", "\t").csv(path)


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{root.rstrip('/')}/{name}.parquet")
