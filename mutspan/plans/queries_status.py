"""Run log: latest state, attempts, status report."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import fixed, keys
from ..operators import status_report as sr
from ..operators import trajectory as tj
from ..operators.ordering import block_of
from . import views as v
from .registry import query

BLOCK_LINES = 1000  # small blocks, so that test data spans several


def _block():
    return block_of("line_no", BLOCK_LINES)


def _rows(spark, sf):
    return sr.mutant_status(v.v_traj(spark, sf))


@query(
    "F48_P5_repaired_log",
    """
SELECT line_no, mutant_id, CASE WHEN k % 7 = 0 THEN CASE WHEN killed THEN 'KILLED' WHEN compile_success THEN 'SURVIVED'
  ELSE 'COMPILE_FAILED_AFTER_REPAIR' END ELSE target_status END AS target_status FROM v_traj""",
    ("v_traj",),
)
def repaired_log(spark, sf):
    k = F.col("k")
    layered = v.v_traj(spark, sf).select(
        "line_no",
        F.when(k % 3 != 0, F.col("mutant_id")).alias("mutant_id"),
        F.struct(F.when(k % 3 == 0, F.col("mutant_id")).alias("mutantId"), F.when(k % 7 != 0, F.col("target_status")).alias("targetStatus")).alias("state_after"),
        "project", "class_name", "method", "operator", "killed", "compile_success",
    )
    same = {c: ("string", [c]) for c in ("project", "class_name", "method", "operator")}
    paths = {
        "line_no": ("long", ["line_no"]),
        "mutant_id": ("string", ["mutant_id", "state_after.mutantId"]),
        "target_status": ("string", ["state_after.targetStatus"]),
        "killed": ("boolean", ["killed"]),
        "compile_success": ("boolean", ["compile_success"]),
        **same,
    }
    return tj.repaired(tj.resolve_paths(layered, paths)).select("line_no", "mutant_id", "target_status")


@query(
    "W1_latest_record",
    "SELECT mutant_id, line_no, target_status, reward FROM (SELECT *, row_number() OVER (PARTITION BY mutant_id ORDER BY line_no DESC) AS rn FROM v_traj) WHERE rn = 1",
    ("v_traj",),
)
def latest_record(spark, sf):
    return tj.latest_records(v.v_traj(spark, sf).select("mutant_id", "line_no", "target_status", "reward"))


@query(
    "W2_display_round",
    """
SELECT line_no, occurrence, CASE WHEN outer_loop_round > 0 THEN outer_loop_round ELSE occurrence END AS display_round
FROM (SELECT *, row_number() OVER (PARTITION BY mutant_id ORDER BY line_no) AS occurrence FROM v_traj)""",
    ("v_traj",),
)
def display_round(spark, sf):
    t = v.v_traj(spark, sf).select("line_no", "mutant_id", "outer_loop_round")
    return tj.with_display_round(t, _block()).select("line_no", "occurrence", "display_round")


@query(
    "W3_first_non_executed",
    """
SELECT mutant_id, min(line_no) AS line_no, arg_min(target_status, line_no) AS target_status FROM v_traj
WHERE target_status IN ('COMPILE_FAILED_AFTER_REPAIR', 'SKIPPED_BY_EVIDENCE') GROUP BY 1""",
    ("v_traj",),
)
def first_non_executed(spark, sf):
    return tj.first_non_executed(v.v_traj(spark, sf).select("mutant_id", "line_no", "target_status"))


@query(
    "W4_P7_latest_survivor",
    """
SELECT mutant_id, line_no, reward FROM (SELECT *, row_number() OVER (PARTITION BY mutant_id ORDER BY date_trunc('hour', generated_at) DESC, line_no DESC) AS rn
  FROM v_traj WHERE NOT killed AND target_status = 'SURVIVED') WHERE rn = 1""",
    ("v_traj",),
)
def latest_survivor(spark, sf):
    t = v.v_traj(spark, sf).withColumn("generated_at", F.date_trunc("hour", "generated_at"))
    return tj.latest_survivors(t.select("mutant_id", "line_no", "reward", "killed", "target_status", "generated_at")).select(
        "mutant_id", "line_no", "reward"
    )


@query(
    "W5_A31_batch_statistics",
    """
SELECT line_no, count(*) OVER (PARTITION BY project, class_name, method) AS function_total,
  count(*) OVER (PARTITION BY project, class_name, method, split_part(operator, '_', 1)) AS site_total,
  row_number() OVER (PARTITION BY project, class_name, method ORDER BY line_no) - 1 AS function_processed,
  row_number() OVER (PARTITION BY project, class_name, method, split_part(operator, '_', 1) ORDER BY line_no) - 1 AS site_processed
FROM v_traj""",
    ("v_traj",),
)
def batch_statistics(spark, sf):
    t = v.v_traj(spark, sf).select("line_no", "project", "class_name", "method", "operator")
    return tj.with_batch_statistics(t, "line_no", _block()).select(
        "line_no", "function_total", "site_total", "function_processed", "site_processed"
    )


@query(
    "W6_killed_ever",
    """
SELECT mutant_id, arg_max(target_status, line_no) AS last_status, max(line_no) AS last_line_no, bool_or(killed) AS killed_ever,
  CASE WHEN bool_or(killed) THEN 'KILLED' ELSE 'NOT_KILLED' END AS bucket FROM v_traj GROUP BY 1""",
    ("v_traj",),
)
def killed_ever(spark, sf):
    return tj.killed_ever(v.v_traj(spark, sf))


_RANK = """CASE WHEN killed THEN 5 WHEN compile_success AND original_pass THEN 4 WHEN compile_success THEN 3
  WHEN timed_out THEN 1 ELSE 2 END"""
_BEST = f"""{_RANK} DESC, killed DESC, compile_success DESC, original_pass DESC, timed_out ASC, repair_rounds ASC, elapsed_ms ASC, line_no ASC"""


@query(
    "W7_best_attempt",
    f"""
SELECT mutant_id, line_no, attempt_rank, repair_rounds, elapsed_ms FROM (SELECT *, {_RANK} AS attempt_rank,
  row_number() OVER (PARTITION BY mutant_id ORDER BY {_BEST}) AS rn FROM v_traj) WHERE rn = 1""",
    ("v_traj",),
)
def best_attempt(spark, sf):
    return tj.best_attempts(v.v_traj(spark, sf)).select("mutant_id", "line_no", "attempt_rank", "repair_rounds", "elapsed_ms")


@query(
    "W8_episodes",
    f"""
SELECT f.mutant_id, f.target_status AS initial_status, f.action AS initial_action, round(f.reward, 6) AS initial_reward,
  b.target_status AS best_status, round(b.reward, 6) AS best_reward, b.line_no AS best_line_no, l.target_status AS last_status,
  round(l.reward, 6) AS last_reward, a.target_killed, a.attempts, a.total_llm_calls, a.total_compile_calls, a.total_ms
FROM (SELECT *, row_number() OVER (PARTITION BY mutant_id ORDER BY line_no) AS rn FROM v_traj) f
JOIN (SELECT *, row_number() OVER (PARTITION BY mutant_id ORDER BY line_no DESC) AS rn FROM v_traj) l ON l.mutant_id = f.mutant_id AND l.rn = 1
JOIN (SELECT *, row_number() OVER (PARTITION BY mutant_id ORDER BY {_BEST}) AS rn FROM v_traj) b ON b.mutant_id = f.mutant_id AND b.rn = 1
JOIN (SELECT mutant_id, bool_or(killed) AS target_killed, count(*) AS attempts, sum(llm_calls) AS total_llm_calls,
  sum(compile_calls) AS total_compile_calls, sum(elapsed_ms) AS total_ms FROM v_traj GROUP BY 1) a ON a.mutant_id = f.mutant_id
WHERE f.rn = 1""",
    ("v_traj",),
)
def episodes(spark, sf):
    e = tj.episodes(v.v_traj(spark, sf))
    return e.withColumns({c: F.round(c, 6) for c in ("initial_reward", "best_reward", "last_reward")})


@query(
    "A7_operator_rates",
    """
SELECT operator_family, count(*) AS total, count_if(category = 'KILLED') AS killed, count_if(category = 'SURVIVED') AS survived,
  count_if(category = 'COMPILE_FAILED') AS compile_failed, count_if(category = 'OTHER') AS other,
  round(count_if(category IN ('KILLED', 'SURVIVED')) / count(*), 6) AS compile_rate,
  round(count_if(category = 'KILLED') / count(*), 6) AS kill_rate,
  round(coalesce(count_if(category = 'KILLED') / nullif(count_if(category IN ('KILLED', 'SURVIVED')), 0), 0), 6) AS kill_rate_of_compiled
FROM v_last GROUP BY 1""",
    ("v_traj", "v_last"),
)
def operator_rates(spark, sf):
    return _rounded(sr.operator_rates(_rows(spark, sf)), "compile_rate", "kill_rate", "kill_rate_of_compiled")


def _rounded(df, *cols):
    return df.withColumns({c: F.round(c, 6) for c in cols})


@query(
    "A8_class_rates",
    """
SELECT class_name, count(*) AS total, count_if(category = 'KILLED') AS killed, count_if(category = 'SURVIVED') AS survived,
  count_if(category = 'COMPILE_FAILED') AS compile_failed, count_if(category = 'OTHER') AS other,
  round(count_if(category IN ('KILLED', 'SURVIVED')) / count(*), 6) AS compile_rate,
  round(count_if(category = 'KILLED') / count(*), 6) AS kill_rate,
  round(coalesce(count_if(category = 'KILLED') / nullif(count_if(category IN ('KILLED', 'SURVIVED')), 0), 0), 6) AS kill_rate_of_compiled
FROM v_last GROUP BY 1""",
    ("v_traj", "v_last"),
)
def class_rates(spark, sf):
    return _rounded(sr.class_rates(_rows(spark, sf)), "compile_rate", "kill_rate", "kill_rate_of_compiled")


def _coarse_sql():
    from .queries_functions import _sql_rules

    return f"""CASE {_sql_rules(fixed.COARSE_COMPILE_CATEGORIES, 'lower(failure_reason)')}
      WHEN failure_reason = '' THEN '{fixed.COARSE_COMPILE_NO_TEXT}' ELSE '{fixed.COARSE_COMPILE_OTHER}' END"""


@query(
    "A9_compile_error_categories",
    f"""
SELECT error_category, count(*) AS mutants, round(count(*) / (sum(count(*)) OVER ()), 6) AS share,
  arg_min(failure_reason, class_name || chr(1) || method || chr(1) || operator || chr(1) || mutant_id) AS example
FROM (SELECT *, {_coarse_sql()} AS error_category FROM v_last WHERE category = 'COMPILE_FAILED') GROUP BY 1""",
    ("v_traj", "v_last"),
)
def compile_error_categories(spark, sf):
    return _rounded(sr.compile_error_categories(_rows(spark, sf)), "share")


@query(
    "A10_A13_A14_summary",
    """
SELECT metric, round(value, 6) AS value FROM (UNPIVOT (SELECT CAST(sum(records) AS DOUBLE) AS records, CAST(sum(sum_repairs) AS DOUBLE) AS repair_rounds,
  CAST(sum(sum_compile_calls) AS DOUBLE) AS compile_calls, CAST(sum(sum_llm_calls) AS DOUBLE) AS llm_calls, CAST(count(*) AS DOUBLE) AS mutants,
  CAST(count_if(category = 'KILLED') AS DOUBLE) AS killed, CAST(count_if(category = 'SURVIVED') AS DOUBLE) AS survived,
  CAST(count_if(category = 'COMPILE_FAILED') AS DOUBLE) AS compile_failed, CAST(sum(non_executed_records) AS DOUBLE) AS non_executed_records,
  CAST(count_if(non_executed_records > 0) AS DOUBLE) AS non_executed_mutants, CAST(count_if(compile_success) AS DOUBLE) AS compiled,
  CAST(count_if(ever_compile_failed) AS DOUBLE) AS ever_compile_failed, CAST(count_if(ever_compile_failed AND compile_success) AS DOUBLE) AS recovered,
  CAST(count_if(compile_success) / count(*) AS DOUBLE) AS compile_rate, CAST(count_if(category = 'KILLED') / count(*) AS DOUBLE) AS kill_rate,
  CAST(count_if(category = 'KILLED') / count_if(compile_success) AS DOUBLE) AS kill_rate_of_compiled,
  CAST(count_if(ever_compile_failed AND compile_success) / count_if(ever_compile_failed) AS DOUBLE) AS recovery_rate
  FROM v_last) ON COLUMNS(*) INTO NAME metric VALUE value)""",
    ("v_traj", "v_last"),
)
def summary(spark, sf):
    return _rounded(sr.summary(_rows(spark, sf)), "value")


@query(
    "A11_kill_rounds",
    "SELECT CAST(final_round AS BIGINT) AS final_round, count(*) AS mutants FROM v_last WHERE category = 'KILLED' GROUP BY 1",
    ("v_traj", "v_last"),
)
def kill_rounds(spark, sf):
    return sr.kill_rounds(_rows(spark, sf))


@query(
    "A12_status_patterns",
    """
SELECT pattern, count(*) AS mutants FROM (SELECT mutant_id, string_agg(target_status, ' → ' ORDER BY line_no) AS pattern FROM v_traj GROUP BY 1) GROUP BY 1""",
    ("v_traj",),
)
def status_patterns(spark, sf):
    return sr.status_patterns(v.v_traj(spark, sf), _block())


@query(
    "A12_status_trie",
    """
WITH prefixes AS (
  SELECT mutant_id, target_status AS status, row_number() OVER w AS depth, count(*) OVER (PARTITION BY mutant_id) AS records, string_agg(target_status, ' → ') OVER w AS path
  FROM v_traj WINDOW w AS (PARTITION BY mutant_id ORDER BY line_no ROWS UNBOUNDED PRECEDING)
), nodes AS (
  SELECT path, depth, status, count(*) AS mutants, count_if(depth = records) AS ending, CASE WHEN depth > 1 THEN path[:length(path) - length(status) - 3] END AS parent FROM prefixes GROUP BY ALL
)
SELECT n.depth, n.status, n.mutants, CAST(n.ending AS BIGINT) AS ending, coalesce(p.status, '') AS parent_status, coalesce(p.mutants, 0) AS parent_mutants, count(*) AS nodes
FROM nodes n LEFT JOIN nodes p ON p.path = n.parent GROUP BY ALL""",
    ("v_traj",),
)
def status_trie(spark, sf):
    """Nodes of the trie beside their parents, counted by what they hold."""
    t = sr.status_trie(v.v_traj(spark, sf), _block(), 16)
    parents = t.select(F.col("node").alias("parent"), F.col("status").alias("parent_status"), F.col("mutants").alias("parent_mutants"))
    met = t.join(parents, "parent", "left").fillna("", ["parent_status"]).fillna(0, ["parent_mutants"])
    keys = ["depth", "status", "mutants", "ending", "parent_status", "parent_mutants"]
    return met.groupBy(*keys).agg(F.count(F.lit(1)).alias("nodes"))


@query(
    "A12_record_histogram",
    "SELECT records, count(*) AS mutants FROM (SELECT count(*) AS records FROM v_traj GROUP BY mutant_id) GROUP BY 1",
    ("v_traj",),
)
def record_histogram(spark, sf):
    return sr.record_histogram(_rows(spark, sf))


@query(
    "J20_match_log_to_index",
    """
WITH t AS (SELECT DISTINCT user_id, CASE WHEN user_id % 7 IN (0, 2) THEN '' ELSE mutant_id END AS mutant_id,
  CASE WHEN user_id % 7 = 1 THEN string_split(mutant_id, '::')[1] WHEN user_id % 7 <> 2 THEN project END AS project,
  CASE WHEN user_id % 7 = 1 THEN string_split(mutant_id, '::')[2] WHEN user_id % 7 <> 2 THEN class_name END AS class_name,
  CASE WHEN user_id % 7 = 1 THEN string_split(mutant_id, '::')[3] WHEN user_id % 7 <> 2 THEN method END AS method,
  CASE WHEN user_id % 7 = 1 THEN string_split(mutant_id, '::')[4] WHEN user_id % 7 <> 2 THEN operator END AS operator FROM v_traj)
SELECT user_id, mutant_id, coalesce(a.row_no, b.row_no) AS index_row, CASE WHEN a.row_no IS NOT NULL THEN 1 WHEN b.row_no IS NOT NULL THEN 2 ELSE 0 END AS tier
FROM t LEFT JOIN (SELECT mutant_id AS aid, min(row_no) AS row_no FROM v_index WHERE mutant_id <> '' GROUP BY 1) a ON a.aid = t.mutant_id
LEFT JOIN (SELECT project, class_name, method, operator, min(row_no) AS row_no FROM v_index GROUP BY ALL) b
  ON b.project = t.project AND b.class_name = t.class_name AND b.method = t.method AND b.operator = t.operator""",
    ("v_traj", "v_index"),
)
def match_log_to_index(spark, sf):
    t = v.v_traj(spark, sf)
    kind = F.col("user_id") % 7  # some records lack their id, some their parts, some both
    records = t.select(
        "user_id",
        F.when(kind.isin(0, 2), "").otherwise(F.col("mutant_id")).alias("mutant_id"),
        *[F.when(~kind.isin(1, 2), F.col(c)).otherwise("").alias(c) for c in ("project", "class_name", "method", "operator")],
        keys.row_number_of_task("task_id").alias("task_row"),
    ).distinct()
    return sr.match_index(records, v.v_index(t)).select("user_id", "mutant_id", "index_row", "tier")


@query(
    "A29_loop_statistics",
    """
SELECT count(*) AS total_mutants, count_if(compile_success) AS compiled, count_if(e) AS executed, count_if(e AND killed) AS killed,
  count_if(e AND NOT killed AND target_status = 'SURVIVED') AS survived, count_if(false) AS equivalent_suspected, count_if(NOT e) AS not_executed
FROM (SELECT *, target_status IN ('KILLED', 'SURVIVED', 'ORIGINAL_FAILED') AS e FROM v_last)""",
    ("v_traj", "v_last"),
)
def loop_statistics(spark, sf):
    return tj.loop_statistics(v.v_traj(spark, sf))


ROUND_SQL = """
SELECT run_id, outer_loop_round, count(*) AS total_mutants, count_if(compile_success) AS compiled, count_if(e) AS executed,
  count_if(e AND killed) AS killed, count_if(e AND NOT killed AND target_status = 'SURVIVED') AS survived,
  count_if(false) AS equivalent_suspected, count_if(NOT e) AS not_executed
FROM (SELECT *, target_status IN ('KILLED', 'SURVIVED', 'ORIGINAL_FAILED') AS e FROM (SELECT *,
  row_number() OVER (PARTITION BY run_id, outer_loop_round, task_id ORDER BY line_no DESC) AS rn FROM v_traj) WHERE rn = 1)
GROUP BY ALL"""


@query("T5_loop_statistics_by_round", ROUND_SQL, ("v_traj",))
def loop_statistics_by_round(spark, sf):
    return tj.loop_statistics(v.v_traj(spark, sf), ["run_id", "outer_loop_round"])


@query(
    "P4_failed_compilations",
    "SELECT mutant_id, count(*) AS failed FROM v_traj WHERE NOT compile_success GROUP BY 1",
    ("v_traj",),
)
def failed_compilations(spark, sf):
    from ..sources.readers import failed_compilations as failed

    k = F.col("k")
    rows = v.v_traj(spark, sf).withColumn("compiled", F.when(k % 2 == 0, F.initcap(F.col("compile_success").cast("string"))).otherwise(F.col("compile_success").cast("string")))
    return failed(rows).groupBy("mutant_id").agg(F.count(F.lit(1)).alias("failed"))


@query(
    "W21_report_order",
    """
SELECT report_row, mutant_id, category FROM (SELECT mutant_id, category, row_number() OVER (ORDER BY
  CASE category WHEN 'KILLED' THEN 0 WHEN 'SURVIVED' THEN 1 WHEN 'COMPILE_FAILED' THEN 2 ELSE 3 END, class_name, method, operator, mutant_id) AS report_row
  FROM v_last)""",
    ("v_traj", "v_last"),
)
def report_order(spark, sf):
    from ..operators.ordering import with_report_rows
    from ..functions.status import category_order

    rows = _rows(spark, sf).select("mutant_id", "category", "class_name", "method", "operator")
    order = [category_order("category"), F.col("class_name"), F.col("method"), F.col("operator"), F.col("mutant_id")]
    return with_report_rows(rows, order, "report_row").select("report_row", "mutant_id", "category")

