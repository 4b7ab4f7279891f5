"""Report merging, artifacts, mapping and execution summaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import safe
from ..operators import merge as mg
from ..operators.summaries import experiment_metrics
from . import views as v
from .registry import query
from .views import table

SEP = "; "


def _joined(df):
    """Array columns as texts."""
    return df.select(*[F.array_join(c, SEP).alias(c) if t.startswith("array") else F.col(c) for c, t in df.dtypes])


@query(
    "S1_S2_index_rows",
    """
SELECT row_no, operator, line, CASE WHEN project IN ('proj1', 'proj2') THEN project ELSE 'rest' END AS whitelisted
FROM (SELECT row_no, operator, project, CASE WHEN row_no % 4 = 0 THEN -1 ELSE CAST(row_no AS INT) END AS line FROM v_index)""",
    ("v_traj", "v_index"),
)
def index_rows(spark, sf):
    index = v.v_index(v.v_traj(spark, sf))
    text = F.when(F.col("row_no") % 4 == 0, F.lit("n/a")).otherwise(F.col("row_no").cast("string"))
    number = F.regexp_extract(text, r"^(-?[0-9]+)(?:\.0+)?$", 1).try_cast("int")
    listed = safe("project").isin(["proj1", "proj2"])
    return index.select(
        "row_no", "operator", F.coalesce(number, F.lit(-1)).alias("line"),
        F.when(listed, F.col("project")).otherwise(F.lit("rest")).alias("whitelisted"),
    )


@query(
    "S3_pending_tasks",
    "SELECT o_orderkey AS row_no, 'M' || o_custkey AS mutant FROM orders WHERE o_orderkey >= 100 AND 'M' || o_custkey NOT IN (SELECT mutant FROM v_customers)",
    ("v_customers",),
)
def pending_tasks(spark, sf):
    tasks = v.v_entries(spark, sf).select("row_no", "mutant")
    return mg.skip_existing(tasks, v.v_customers(spark, sf), "mutant", 100, None)


@query(
    "J18_match_reports",
    """
SELECT report_id, index_row, tier FROM (SELECT s.report_id, coalesce(a.index_row, b.index_row) AS index_row,
  CASE WHEN a.index_row IS NOT NULL THEN 1 WHEN b.index_row IS NOT NULL THEN 2 ELSE 0 END AS tier
FROM (SELECT *, CASE WHEN report_id % 3 = 0 THEN 'other' ELSE project END AS p FROM v_suites) s
LEFT JOIN v_customers a ON a.project = s.p AND a.mutant = s.mutant
LEFT JOIN v_customers b ON b.project = s.project AND b.mutant = s.mutant)""",
    ("v_suites", "v_customers"),
)
def match_reports(spark, sf):
    rows = v.v_suites(spark, sf).withColumn("scanned_project", F.col("project")).withColumn(
        "project", F.when(F.col("report_id") % 3 == 0, F.lit("other")).otherwise(F.col("project"))
    )
    matched = mg.match_reports(rows, v.v_customers(spark, sf))
    return matched.select("report_id", F.substring("index_mutant", 2, 20).cast("long").alias("index_row"), "tier")


def _details(spark, sf):
    return mg.kill_details(v.v_entries(spark, sf), v.v_suites(spark, sf))


@query(
    "A1_A2_kill_details",
    """
SELECT e.project, e.class_name, e.method, e.mutant, s.report_count, e.entry_count, e.compiled_ever, e.compiled_count, e.not_compiled_count,
  array_to_string(e.ms, '; ') AS mapping_statuses, e.original_passed_ever, e.mutant_executed_ever, e.target_killed_ever,
  array_to_string(e.ts, '; ') AS target_statuses, coalesce(array_to_string(e.fr, '; '), '') AS failure_reasons,
  array_to_string(e.tn, '; ') AS test_set_names, s.killed_ever, s.killed_runs, s.live_ever, s.live_runs, s.same_method_fallback_ever,
  array_to_string(s.ss, '; ') AS suite_statuses, coalesce(array_to_string(s.kt, '; '), '') AS killing_tests, s.timeout_related,
  s.primary_runs, s.fallback_runs, s.timeout_runs, s.elapsed_ms,
  len(list_filter(s.kb, lambda x: list_contains(e.tn, split_part(x, '#', 1)))) > 0 AS killed_by_primary,
  len(list_filter(s.kb, lambda x: NOT list_contains(e.tn, split_part(x, '#', 1)))) > 0 AS killed_by_fallback,
  CASE WHEN list_contains(e.ms, 'OK') THEN 'OK' ELSE array_to_string(e.ms, ', ') END AS final_mapping,
  CASE WHEN s.killed_ever THEN 'KILLED' WHEN s.live_ever THEN 'LIVE' ELSE 'NOT_REPORTED' END AS final_kill
FROM (SELECT project, class_name, method, mutant, count(*) AS entry_count, bool_or(compiled) AS compiled_ever, count_if(compiled) AS compiled_count,
    count_if(NOT compiled) AS not_compiled_count, list_sort(list(DISTINCT CASE WHEN mapping_status = '' THEN 'UNKNOWN' ELSE mapping_status END)) AS ms,
    bool_or(original_passed) AS original_passed_ever, bool_or(mutant_executed) AS mutant_executed_ever, bool_or(target_killed) AS target_killed_ever,
    list_sort(list(DISTINCT target_status)) AS ts, list_sort(list(DISTINCT failure_reason) FILTER (failure_reason <> '')) AS fr,
    list_sort(list(DISTINCT test_set_name)) AS tn FROM v_entries GROUP BY ALL) e
JOIN (SELECT project, class_name, method, mutant, count(*) AS report_count, bool_or(killed) AS killed_ever, count_if(killed) AS killed_runs,
    bool_or(live) AS live_ever, count_if(live) AS live_runs, bool_or(same_method_fallback) AS same_method_fallback_ever,
    list_sort(list(DISTINCT CASE WHEN suite_status = '' THEN 'UNKNOWN' ELSE suite_status END)) AS ss,
    list_sort(list_distinct(flatten(list(string_split(tests, ', ')) FILTER (tests <> '')))) AS kt, coalesce(list(DISTINCT tests) FILTER (killed), []) AS kb,
    bool_or(contains(tests, 'timeout')) AS timeout_related, sum(primary_runs) AS primary_runs, sum(fallback_runs) AS fallback_runs,
    sum(timeout_runs) AS timeout_runs, sum(elapsed_ms) AS elapsed_ms FROM v_suites GROUP BY ALL) s
  USING (project, class_name, method, mutant)""",
    ("v_entries", "v_suites"),
)
def kill_details(spark, sf):
    return _joined(_details(spark, sf))


@query(
    "A1_kill_items",
    """
SELECT DISTINCT * FROM (
  SELECT mutant, unnest([{'kind': 'mapping_status', 'item': CASE WHEN mapping_status = '' THEN 'UNKNOWN' ELSE mapping_status END}, {'kind': 'target_status', 'item': target_status},
    {'kind': 'failure_reason', 'item': failure_reason}, {'kind': 'test_set_name', 'item': test_set_name}], recursive := true) FROM v_entries
  UNION ALL SELECT mutant, 'suite_status', CASE WHEN suite_status = '' THEN 'UNKNOWN' ELSE suite_status END FROM v_suites
  UNION ALL SELECT mutant, 'killing_test', unnest(string_split(tests, ', ')) FROM v_suites) WHERE item <> ''""",
    ("v_entries", "v_suites"),
)
def kill_items(spark, sf):
    return mg.kill_items(v.v_entries(spark, sf), v.v_suites(spark, sf)).select("mutant", "kind", "item")


@query(
    "A1_A2_kill_facts",
    """
SELECT e.mutant, entry_count, compiled_count, not_compiled_count, compiled_ever, original_passed_ever, mutant_executed_ever, target_killed_ever, report_count, killed_runs, live_runs, killed_ever, live_ever,
  same_method_fallback_ever, timeout_related, CAST(primary_runs AS BIGINT) AS primary_runs, CAST(elapsed_ms AS BIGINT) AS elapsed_ms,
  len(list_filter(kb, lambda x: list_contains(tn, split_part(x, '#', 1)))) > 0 AS killed_by_primary, len(list_filter(kb, lambda x: NOT list_contains(tn, split_part(x, '#', 1)))) > 0 AS killed_by_fallback,
  CASE WHEN killed_ever THEN 'KILLED' WHEN live_ever THEN 'LIVE' ELSE 'NOT_REPORTED' END AS final_kill
FROM (SELECT mutant, count(*) AS entry_count, count_if(compiled) AS compiled_count, count_if(NOT compiled) AS not_compiled_count, bool_or(compiled) AS compiled_ever, bool_or(original_passed) AS original_passed_ever,
    bool_or(mutant_executed) AS mutant_executed_ever, bool_or(target_killed) AS target_killed_ever, list(DISTINCT test_set_name) AS tn FROM v_entries GROUP BY 1) e
JOIN (SELECT mutant, count(*) AS report_count, count_if(killed) AS killed_runs, count_if(live) AS live_runs, bool_or(killed) AS killed_ever, bool_or(live) AS live_ever, bool_or(same_method_fallback) AS same_method_fallback_ever,
    bool_or(contains(tests, 'timeout')) AS timeout_related, sum(primary_runs) AS primary_runs, sum(elapsed_ms) AS elapsed_ms, coalesce(list(DISTINCT tests) FILTER (killed), []) AS kb FROM v_suites GROUP BY 1) s USING (mutant)""",
    ("v_entries", "v_suites"),
)
def kill_facts(spark, sf):
    f = mg.kill_facts(v.v_entries(spark, sf), v.v_suites(spark, sf))
    columns = ["entry_count", "compiled_count", "not_compiled_count", "report_count", "killed_runs", "live_runs", "primary_runs", "elapsed_ms"]
    rest = [
        "compiled_ever", "original_passed_ever", "mutant_executed_ever", "target_killed_ever", "killed_ever", "live_ever", "same_method_fallback_ever", "timeout_related",
        "killed_by_primary", "killed_by_fallback", "final_kill",
    ]
    return f.select("mutant", *[F.col(c).cast("long").alias(c) for c in columns], *rest)


@query(
    "P8_not_killed_scopes",
    """
SELECT mutant, unnest(list_filter([CASE WHEN NOT t THEN 'TARGET_NOT_KILLED' END, CASE WHEN NOT k THEN 'SUITE_NOT_KILLED' END], lambda x: x IS NOT NULL)) AS scope
FROM (SELECT mutant, bool_or(target_killed) AS t FROM v_entries GROUP BY 1) JOIN (SELECT mutant, bool_or(killed) AS k FROM v_suites GROUP BY 1) USING (mutant)""",
    ("v_entries", "v_suites"),
)
def not_killed_scopes(spark, sf):
    return mg.not_killed_scopes(_details(spark, sf)).select("mutant", "scope")


def _baseline(spark, sf):
    """Baseline reports: some name a wrong project, some only their file."""
    s = v.v_suites(spark, sf)
    r = F.col("report_id") % 4
    c = F.substring("mutant", 2, 20).cast("long")
    return s.select(
        "report_id",
        F.when(r == 0, F.col("project")).otherwise(F.lit("elsewhere")).alias("project"),
        F.when(r == 1, F.lit("C?")).otherwise(F.col("class_name")).alias("class_name"),
        "mutant",
        F.when(r == 1, F.concat(F.lit("stat/"), (c % 100).cast("string"), F.lit(".txt"))).otherwise(F.lit("")).alias("statistic_file"),
        (F.col("killed") & (r != 2)).alias("killed"),
        "live",
        F.filter(F.transform(F.split("tests", ","), safe), lambda t: t != "").alias("killing_tests"),
    )


@query(
    "J19_match_baseline",
    """
SELECT report_id, c.index_row, CASE report_id % 4 WHEN 0 THEN 1 WHEN 1 THEN 2 ELSE 3 END AS tier, false AS ambiguous
FROM v_suites s JOIN v_customers c ON c.mutant = s.mutant WHERE report_id % 4 <> 1 OR c.index_row % 10 <> 0""",
    ("v_suites", "v_customers"),
)
def match_baseline(spark, sf):
    index = v.v_customers(spark, sf)
    file = F.when(F.col("index_row") % 10 != 0, F.col("statistic_file")).otherwise("")  # blank on both sides for some
    m = mg.match_baseline(_baseline(spark, sf), index.withColumn("statistic_file", file))
    return m.select("report_id", F.substring("index_mutant", 2, 20).cast("long").alias("index_row"), "tier", "ambiguous")


@query(
    "A3_baseline_details",
    """
SELECT mutant, count(*) AS report_count, bool_or(k) AS killed_ever, count_if(k) AS killed_runs, bool_or(live) AS live_ever,
  count_if(live) AS live_runs, count_if(inferred) AS inferred_runs, bool_or(contains(tests, 'timeout')) AS timeout_related,
  CASE WHEN bool_or(k) THEN 'KILLED' WHEN bool_or(live) THEN 'LIVE' ELSE 'NOT_REPORTED' END AS final_kill,
  coalesce(array_to_string(list_sort(list_distinct(flatten(list(string_split(tests, ', ')) FILTER (tests <> '')))), '; '), '') AS killing_tests
FROM (SELECT s.mutant, s.tests, s.live, s.killed AND s.report_id % 4 = 2 AS inferred, s.killed AS k
  FROM v_suites s JOIN v_customers c ON c.mutant = s.mutant) GROUP BY 1""",
    ("v_suites", "v_customers"),
)
def baseline_details(spark, sf):
    m = mg.match_baseline(_baseline(spark, sf), v.v_customers(spark, sf))
    d = mg.baseline_kill_details(m)
    return _joined(d.select(F.col("index_mutant").alias("mutant"), "report_count", "killed_ever", "killed_runs", "live_ever", "live_runs",
                            "inferred_runs", "timeout_related", "final_kill", "killing_tests"))


@query(
    "J21_unique_triple",
    """
SELECT report_id, coalesce(a.index_row, b.index_row) AS index_row, CASE WHEN a.index_row IS NOT NULL THEN 'FULL' WHEN b.index_row IS NOT NULL THEN 'TRIPLE' ELSE 'NONE' END AS matched_by
FROM (SELECT *, CASE WHEN report_id % 2 = 0 THEN project ELSE '?' END AS p FROM v_suites) s
LEFT JOIN v_customers a ON a.project = s.p AND a.mutant = s.mutant LEFT JOIN v_customers b ON b.mutant = s.mutant""",
    ("v_suites", "v_customers"),
)
def unique_triple(spark, sf):
    s = v.v_suites(spark, sf).withColumn("project", F.when(F.col("report_id") % 2 == 0, F.col("project")).otherwise(F.lit("?")))
    return mg.match_unique_triple(s, v.v_customers(spark, sf)).select("report_id", "index_row", "matched_by")


@query(
    "A4_collapsed_index",
    """
SELECT mutant, min(row_no) AS row_no, arg_min(test_set_name, row_no) AS test_set_name, bool_or(compiled) AS compiled, count(*) AS index_rows FROM v_entries GROUP BY 1""",
    ("v_entries",),
)
def collapsed_index(spark, sf):
    e = v.v_entries(spark, sf).select(*mg.KEY, "row_no", "test_set_name", "compiled")
    return mg.collapse_index(e).select("mutant", "row_no", "test_set_name", "compiled", "index_rows")


@query(
    "J22_log_artifacts",
    """
SELECT l.l_orderkey * 10 + l.l_linenumber AS log_id, count(*) AS matches, min(p.p_name) AS first_name FROM lineitem l
JOIN part p ON p.p_size = l.l_quantity AND p.p_brand = 'Brand#' || (l.l_suppkey % 25) AND p.p_type = CASE WHEN l.l_returnflag = 'R' THEN 'ECONOMY' ELSE 'STANDARD' END
GROUP BY 1""",
)
def log_artifacts(spark, sf):
    li = table(spark, sf, "lineitem")
    log = li.select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("log_id"),
        F.col("l_quantity").cast("int").alias("method"),
        F.concat(F.lit("Brand#"), (F.col("l_suppkey") % 25).cast("string")).alias("operator"),
        F.when(F.col("l_returnflag") == "R", F.lit("ECONOMY")).otherwise(F.lit("STANDARD")).alias("class_f"),
    )
    artifacts = table(spark, sf, "part").select(
        F.col("p_size").alias("method"), F.col("p_brand").alias("operator"), F.col("p_type").alias("class_f"), "p_name"
    )
    # artifacts of one key are counted before they meet its log rows, which would each take them all
    counted = artifacts.groupBy("method", "operator", "class_f").agg(F.count(F.lit(1)).alias("_n"), F.min("p_name").alias("p_name"))
    return mg.join_log_artifacts(log, counted).groupBy("log_id").agg(F.sum("_n").alias("matches"), F.min("p_name").alias("first_name"))


@query(
    "J23_first_artifact_per_method",
    """
SELECT method_id, a.first_part FROM v_methods m JOIN (SELECT name, min(method_id) AS first_part FROM v_methods GROUP BY 1) a USING (name)""",
    ("v_methods",),
)
def first_artifact(spark, sf):
    m = v.v_methods(spark, sf)
    artifacts = m.select(F.col("name").alias("method"), F.col("method_id").alias("first_part"))
    methods = m.select("method_id", F.col("name").alias("method"))
    return mg.first_artifact_per_method(methods, artifacts, "first_part").select("method_id", "first_part")


@query(
    "J24_killed_flags",
    """
SELECT o_orderkey AS mutant, CASE WHEN o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R') THEN 1 ELSE 0 END AS is_killed FROM orders""",
)
def killed_flags(spark, sf):
    killed = v.v_matrix(spark, sf).filter("kills").select("mutant")
    return mg.flag_killed(v.v_mutants(spark, sf).select("mutant"), killed, ["mutant"])


@query(
    "J25_complete_pairs",
    """
SELECT count(*) AS pairs, count(DISTINCT c_nationkey) AS original_artifacts, count(DISTINCT c_custkey) AS mutant_artifacts FROM customer
WHERE c_nationkey IN (SELECT s_nationkey FROM supplier) AND c_custkey IN (SELECT o_custkey FROM orders)""",
)
def complete_pairs(spark, sf):
    rows = table(spark, sf, "customer").select(F.col("c_nationkey").alias("original_path"), F.col("c_custkey").alias("mutant_path"))
    originals = table(spark, sf, "supplier").select(F.col("s_nationkey").alias("original_path"))
    mutants = table(spark, sf, "orders").select(F.col("o_custkey").alias("mutant_path"))
    return mg.pair_counts(mg.complete_pairs(rows, originals, mutants))


@query("J26_missing_artifacts", "SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def missing_artifacts(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "source")
    return mg.missing_artifacts(d, table(spark, sf, "labels"), "doc_id")


@query(
    "A6_missing_counts",
    """
SELECT source, count(*) AS expected, count(l.doc_id) AS present, count(*) - count(l.doc_id) AS missing FROM documents d
LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l USING (doc_id) GROUP BY 1""",
)
def missing_counts(spark, sf):
    return mg.missing_counts(table(spark, sf, "documents").select("doc_id", "source"), table(spark, sf, "labels"), "doc_id", "source")


@query(
    "A5_artifact_table",
    """
SELECT lang AS project, count(*) AS mutants, count_if(j) AS java_count, count_if(c) AS class_count, count(*) - count_if(j) AS java_missing,
  count(*) - count_if(c) AS class_missing, round((count(*) - count_if(j)) * 100.0::DOUBLE / count(*), 6) AS java_missing_pct,
  round((count(*) - count_if(c)) * 100.0::DOUBLE / count(*), 6) AS class_missing_pct
FROM (SELECT lang, l.doc_id IS NOT NULL AS j, coalesce(l.quality, 0) = 1 AS c FROM documents d LEFT JOIN labels l USING (doc_id)) GROUP BY ROLLUP (lang)""",
)
def artifact_table(spark, sf):
    rows = table(spark, sf, "documents").select("doc_id", F.col("lang").alias("project")).join(table(spark, sf, "labels"), "doc_id", "left")
    rows = rows.select("project", F.col("quality").isNotNull().alias("java"), (F.coalesce("quality", F.lit(0)) == 1).alias("class"))
    t = mg.artifact_table(rows, ["java", "class"])
    return t.withColumns({c: F.round(c, 6) for c in ("java_missing_pct", "class_missing_pct")})


@query(
    "A16_distinct_counts",
    "SELECT count(DISTINCT class_name) AS classes, count(DISTINCT method) AS methods, count(*) AS mutants FROM v_outcomes",
    ("v_outcomes",),
)
def distinct_counts(spark, sf):
    return mg.distinct_counts(v.v_outcomes(spark, sf).select("class_name", "method"))


def _successes(spark, sf):
    e = v.v_entries(spark, sf)
    return e.select(F.col("project").alias("module_home"), "test_set_name", F.col("row_no").alias("line_no"), "compiled", "failure_reason")


@query(
    "W19_latest_success",
    "SELECT project AS module_home, test_set_name, max(row_no) AS line_no FROM v_entries WHERE compiled GROUP BY ALL",
    ("v_entries",),
)
def latest_success(spark, sf):
    return mg.latest_successes(_successes(spark, sf)).select("module_home", "test_set_name", "line_no")


@query(
    "J27_restore_plan",
    """
SELECT project AS module_home, test_set_name, min(r.row_no) AS request_no, max(s.line_no) AS line_no FROM (SELECT project, test_set_name, row_no FROM v_entries) r
JOIN (SELECT project, test_set_name, max(row_no) AS line_no FROM v_entries WHERE compiled GROUP BY ALL) s USING (project, test_set_name) GROUP BY ALL""",
    ("v_entries",),
)
def restore_plan(spark, sf):
    requests = v.v_entries(spark, sf).select(F.col("project").alias("module_home"), "test_set_name", F.col("row_no").alias("request_no"))
    return mg.restore_plan(requests, _successes(spark, sf)).select("module_home", "test_set_name", "request_no", "line_no")


@query(
    "W17_compile_error_file",
    """
SELECT test_name, error_order, file_name FROM (SELECT *, row_number() OVER (PARTITION BY test_name ORDER BY error_order <> 2, error_order, file_name) AS rn
FROM (SELECT 'T' || o_custkey AS test_name, CASE WHEN o_orderkey % 7 = 0 THEN 2147483646 ELSE CAST(o_orderkey % 5 AS INT) END AS error_order,
  'T' || o_custkey || CASE WHEN o_orderkey % 7 = 0 THEN '__restore_compile_error.txt' ELSE '__compile_error_' || (o_orderkey % 5) || '.txt' END AS file_name FROM orders)) WHERE rn = 1""",
)
def compile_error_file(spark, sf):
    o = F.col("o_orderkey")
    name = F.concat(F.lit("T"), F.col("o_custkey").cast("string"))
    tail = F.when(o % 7 == 0, F.lit("__restore_compile_error.txt")).otherwise(F.concat(F.lit("__compile_error_"), (o % 5).cast("string"), F.lit(".txt")))
    files = table(spark, sf, "orders").select(name.alias("test_name"), F.concat(name, tail).alias("file_name"))
    return mg.compile_error_file(files, 2).select("test_name", "error_order", "file_name")


@query(
    "W18_response_file",
    """
SELECT test_name, attempt FROM (SELECT *, row_number() OVER (PARTITION BY test_name ORDER BY attempt = c_nationkey % 4 AND c_nationkey > 0 DESC, attempt DESC) AS rn
FROM (SELECT 'T' || o_custkey AS test_name, CAST(o_orderkey % 5 AS INT) AS attempt, c_nationkey FROM orders JOIN customer ON c_custkey = o_custkey)) WHERE rn = 1""",
)
def response_file(spark, sf):
    name = F.concat(F.lit("T"), F.col("o_custkey").cast("string"))
    files = table(spark, sf, "orders").select(
        name.alias("test_name"), F.concat(name, F.lit("__response_"), (F.col("o_orderkey") % 5).cast("string"), F.lit(".json")).alias("file_name")
    )
    requests = table(spark, sf, "customer").select(
        F.concat(F.lit("T"), F.col("c_custkey").cast("string")).alias("test_name"),
        F.when(F.col("c_nationkey") > 0, F.col("c_nationkey") % 4 + 1).otherwise(F.lit(0)).alias("compile_rounds"),
    )
    return mg.response_file(files, requests).select("test_name", "attempt")


@query(
    "W20_mapping_statuses",
    """
SELECT mapping_status, count(*) AS n FROM (SELECT CASE WHEN pair_no > 1 THEN 'DUPLICATE_METHOD_MUTANT' WHEN test_no > 1 THEN 'DUPLICATE_TEST_CLASS'
  WHEN NOT known_method THEN 'METHOD_NOT_FOUND' WHEN NOT known_mutant THEN 'MUTANT_NOT_FOUND_UNDER_METHOD' WHEN NOT compiled THEN 'TEST_NOT_COMPILED' ELSE 'OK' END AS mapping_status
FROM (SELECT *, row_number() OVER (PARTITION BY class_name, tname, pair_no > 1 ORDER BY row_no) AS test_no,
  method IN (SELECT method FROM v_customers) AS known_method, mutant IN (SELECT mutant FROM v_customers) AS known_mutant
FROM (SELECT *, 'T' || (row_no % 4000) AS tname, row_number() OVER (PARTITION BY class_name, method, mutant ORDER BY row_no) AS pair_no FROM v_entries))) GROUP BY 1""",
    ("v_entries", "v_customers"),
)
def mapping_statuses(spark, sf):
    e = v.v_entries(spark, sf).withColumn("test_set_name", F.concat(F.lit("T"), (F.col("row_no") % 4000).cast("string")))
    rows = e.select("row_no", "class_name", "method", "mutant", "test_set_name", "compiled")
    return mg.mapping_statuses(rows, v.v_customers(spark, sf)).groupBy("mapping_status").agg(F.count(F.lit(1)).alias("n"))


def _summary_rows(spark, sf):
    d = _details(spark, sf)
    return d.select(
        "project", "class_name", "method", "mutant",
        F.lit(True).alias("generated"),
        F.col("compiled_ever").alias("compiled"),
        (F.col("final_mapping") == "OK").alias("executed"),
        F.col("target_killed_ever").alias("target_killed"),
        (F.col("final_kill") == "KILLED").alias("suite_killed"),
        (F.col("final_kill") == "LIVE").alias("suite_live"),
        (F.col("final_kill") != "NOT_REPORTED").alias("reported"),
    )


_SUMMARY_SQL = """SELECT project, class_name, method, count(*) AS mutants, count(*) AS generated_tests, count_if(compiled) AS compiled_tests, count_if(ok) AS executed_tests,
  count_if(ok AND tk) AS target_killed, count_if(sk) AS suite_killed, count_if(NOT sk AND sl) AS suite_live,
  CASE WHEN bool_and(sk OR sl) THEN 'OK' ELSE 'MISSING' END AS suite_status
FROM (SELECT project, class_name, method, mutant, bool_or(compiled) AS compiled, bool_or(mapping_status = 'OK') AS ok, bool_or(target_killed) AS tk FROM v_entries GROUP BY ALL)
JOIN (SELECT mutant, bool_or(killed) AS sk, bool_or(live) AS sl FROM v_suites GROUP BY ALL) USING (mutant) GROUP BY ALL"""
_SCORES_SQL = """round(compiled_tests * 100.0::DOUBLE / generated_tests, 6) AS compile_rate,
  round(coalesce(target_killed * 100.0::DOUBLE / nullif(executed_tests, 0), 0), 6) AS target_score,
  round(coalesce(suite_killed * 100.0::DOUBLE / nullif(suite_killed + suite_live, 0), 0), 6) AS suite_score"""


def _scores(df):
    return df.withColumns({c: F.round(c, 6) for c in ("compile_rate", "target_score", "suite_score")})


@query("A17_method_summary", f"SELECT *, {_SCORES_SQL} FROM ({_SUMMARY_SQL})", ("v_entries", "v_suites"))
def method_summary(spark, sf):
    return _scores(mg.method_summary(_summary_rows(spark, sf)))


@query(
    "A18_class_summary",
    f"""
SELECT *, {_SCORES_SQL} FROM (SELECT project, class_name, count(*) AS methods, CAST(sum(mutants) AS BIGINT) AS mutants, CAST(sum(generated_tests) AS BIGINT) AS generated_tests,
  CAST(sum(compiled_tests) AS BIGINT) AS compiled_tests, CAST(sum(executed_tests) AS BIGINT) AS executed_tests, CAST(sum(target_killed) AS BIGINT) AS target_killed,
  CAST(sum(suite_killed) AS BIGINT) AS suite_killed, CAST(sum(suite_live) AS BIGINT) AS suite_live,
  CASE WHEN bool_and(suite_status = 'OK') THEN 'OK' ELSE 'PARTIAL' END AS suite_status FROM ({_SUMMARY_SQL}) GROUP BY ALL)""",
    ("v_entries", "v_suites"),
)
def class_summary(spark, sf):
    return _scores(mg.class_summary(mg.method_summary(_summary_rows(spark, sf))))


@query(
    "A32_S21_failure_groups",
    """
SELECT class_name, count(*) AS mutants, count_if(compiled) AS java_exists, count_if(NOT compiled) AS error_exists, count_if(mutant_executed) AS graph_exists,
  count_if(NOT mutant_executed) AS graph_missing, arg_min(mutant, CASE WHEN compiled AND original_passed THEN 0 ELSE 1000000000 END + row_no) AS representative,
  array_to_string(list_slice(list(mutant ORDER BY row_no), 1, 5), ', ') AS members, count(*) - least(5, count(*)) AS omitted FROM v_entries GROUP BY 1""",
    ("v_entries",),
)
def failure_groups(spark, sf):
    e = v.v_entries(spark, sf)
    rows = e.select(
        "class_name", "mutant", "row_no", F.col("compiled").alias("java_exists"), F.col("compiled").alias("class_exists"),
        F.col("original_passed").alias("error_exists"), F.col("mutant_executed").alias("graph_exists"), (~F.col("compiled")).alias("_err"),
    )
    g = mg.failure_groups(rows, 5, ["class_name"])
    errors = rows.groupBy("class_name").agg(F.count_if(F.col("_err")).alias("error_exists"))
    return (
        g.drop("class_exists", "error_exists")
        .join(errors, "class_name")
        .withColumn("members", F.array_join("members", ", "))
    )


@query(
    "M13_write_back_suite",
    """
SELECT e.row_no, coalesce(s.p, -1) AS suite_runs, coalesce(s.st, 'old') AS suite_status FROM v_entries e
LEFT JOIN (SELECT mutant, sum(primary_runs) AS p, max(suite_status) AS st FROM v_suites WHERE killed GROUP BY 1) s USING (mutant)""",
    ("v_entries", "v_suites"),
)
def write_back_suite(spark, sf):
    log = v.v_entries(spark, sf).select("row_no", "mutant", F.lit(-1).cast("long").alias("suite_runs"), F.lit("old").alias("suite_status"))
    suites = (
        v.v_suites(spark, sf).filter("killed").groupBy("mutant")
        .agg(F.sum("primary_runs").alias("suite_runs"), F.max("suite_status").alias("suite_status"))
    )
    return mg.write_back_suite(log, suites, ["mutant"], ["suite_runs", "suite_status"]).drop("mutant")


@query(
    "A35_experiment_metrics",
    """
SELECT project, count(*) AS mutants, count_if(c) AS compiled, count_if(x) AS executed, count_if(tk) AS target_killed, count_if(sk) AS suite_killed,
  round(avg(elapsed % 100), 6) AS mean_evidence_ms, round(avg(elapsed % 200), 6) AS mean_generation_ms, round(avg(elapsed % 300), 6) AS mean_compile_ms,
  round(avg(elapsed), 6) AS mean_total_ms, round(avg(n), 6) AS mean_repair_rounds, round(count_if(c) * 100.0::DOUBLE / count(*), 6) AS compile_rate,
  round(count_if(x) * 100.0::DOUBLE / count(*), 6) AS execution_rate, round(count_if(tk) * 100.0::DOUBLE / count(*), 6) AS target_kill_rate,
  round(count_if(sk) * 100.0::DOUBLE / count(*), 6) AS mutation_score
FROM (SELECT project, mutant, bool_or(compiled) AS c, bool_or(mapping_status = 'OK') AS x, bool_or(target_killed) AS tk, count(*) AS n FROM v_entries GROUP BY ALL)
JOIN (SELECT mutant, bool_or(killed) AS sk, CAST(sum(elapsed_ms) AS BIGINT) AS elapsed FROM v_suites GROUP BY ALL) USING (mutant) GROUP BY ROLLUP (project)""",
    ("v_entries", "v_suites"),
)
def metrics(spark, sf):
    d = _details(spark, sf).select(
        "project",
        F.col("compiled_ever").alias("compiled"),
        (F.col("final_mapping") == "OK").alias("executed"),
        F.col("target_killed_ever").alias("target_killed"),
        F.col("killed_ever").alias("suite_killed"),
        (F.col("elapsed_ms") % 100).alias("evidence_ms"),
        (F.col("elapsed_ms") % 200).alias("generation_ms"),
        (F.col("elapsed_ms") % 300).alias("compile_ms"),
        F.col("elapsed_ms").alias("total_ms"),
        F.col("entry_count").alias("repair_rounds"),
    )
    out = experiment_metrics(d)
    return out.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in out.dtypes])
