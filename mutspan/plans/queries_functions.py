"""Scalar functions over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import attribution, compile_errors, context, fixed, keys, outcomes, rewards, scores, signatures, status
from ..functions import text as tx
from . import views as v
from .registry import query
from .views import ERROR_TEXTS, OUTCOME_TEXTS, sql_list, sql_pick, table


def _count(df, *cols):
    return df.groupBy(*cols).agg(F.count(F.lit(1)).alias("n"))


@query(
    "F1_F4_canonical_ids",
    """
SELECT mutant_id, project AS id_project, class_name AS id_class, method AS id_method, operator AS legacy_name,
  mutant_id AS from_hashes, operator AS legacy_from_path, count(*) AS n FROM v_traj GROUP BY ALL""",
    ("v_traj",),
)
def canonical_ids(spark, sf):
    t = v.v_traj(spark, sf)
    built = keys.canonical_id(F.concat(F.lit(" "), "project"), "class_name", "method", "operator")
    hashed = F.concat_ws("##", F.concat(F.lit("/data\\runs/"), F.col("project"), F.lit("/")), "class_name", "method", "operator")
    path = F.concat(F.lit("C:\\x/traditional_mutants/"), F.col("method"), F.lit("/"), F.col("operator"), F.lit("/A.class"))
    rows = t.select(
        built.alias("mutant_id"),
        keys.id_part(built, 0).alias("id_project"),
        keys.id_part(built, 1).alias("id_class"),
        keys.id_part(built, 2).alias("id_method"),
        keys.legacy_mutant_name(built).alias("legacy_name"),
        keys.normalize_id(hashed).alias("from_hashes"),
        keys.legacy_mutant_name(path).alias("legacy_from_path"),
    )
    return _count(rows, *rows.columns)


@query(
    "F5_F6_F49_operator_parts",
    """
SELECT operator, regexp_extract(operator, '^([^_]*)_', 1) AS family,
  CAST(regexp_extract(operator, '_([0-9]+)$', 1) AS INT) AS mutant_number, CAST(substr(task_id, 5) AS INT) AS task_row,
  count(*) AS n FROM v_traj GROUP BY ALL""",
    ("v_traj",),
)
def operator_parts(spark, sf):
    rows = v.v_traj(spark, sf).select(
        "operator",
        keys.operator_family("operator").alias("family"),
        keys.mutant_number("operator").alias("mutant_number"),
        keys.row_number_of_task("task_id").alias("task_row"),
    )
    return _count(rows, *rows.columns)


_FAMILIES = ["AORB", "AODU", "CDL", "ROR", "COI", "COD", "LOI", "LOD", "SDL", "ODL", "VDL", "XYZ", " sdl ", ""]


@query(
    "F7_F9_operator_encodings",
    f"""
SELECT family, n,
  CASE upper(trim(family)) WHEN 'AORB' THEN 'NUMERIC_EXPR' WHEN 'ROR' THEN 'RELATIONAL_BRANCH' WHEN 'COI' THEN 'BOOLEAN_CONDITION'
    WHEN 'LOI' THEN 'BITWISE_SHIFT' WHEN 'SDL' THEN 'STATE_UPDATE_MISSING' WHEN 'VDL' THEN 'STATE_UPDATE_MISSING'
    ELSE 'MIXED_DELETE_SIMPLIFY' END AS feature_class,
  CASE WHEN upper(trim(family)) IN ('AORB', 'AODU', 'CDL') THEN 'NUMERIC_EXPR' WHEN family = 'ROR' THEN 'RELATIONAL_BRANCH'
    WHEN family IN ('COI', 'COD') THEN 'BOOLEAN_CONDITION' WHEN family IN ('LOI', 'LOD') THEN 'BITWISE_SHIFT'
    WHEN upper(trim(family)) IN ('SDL', 'ODL', 'VDL') THEN 'STATE_UPDATE_MISSING' ELSE 'MIXED_DELETE_SIMPLIFY' END AS bucket_class,
  CASE upper(trim(family)) WHEN 'SDL' THEN 2 WHEN 'ROR' THEN 3 WHEN 'AORB' THEN 4 WHEN 'ODL' THEN 5 WHEN 'LOI' THEN 6
    WHEN 'COI' THEN 8 WHEN 'VDL' THEN 9 WHEN 'CDL' THEN 10 WHEN 'COD' THEN 14 WHEN 'AODU' THEN 16 WHEN 'LOD' THEN 18
    ELSE 20 END AS hot_position
FROM (SELECT {sql_pick(_FAMILIES, f'l_partkey % {len(_FAMILIES)}')} AS family, count(*) AS n FROM lineitem GROUP BY 1)""",
)
def operator_encodings(spark, sf):
    li = table(spark, sf, "lineitem").select(v.pick(_FAMILIES, F.col("l_partkey") % len(_FAMILIES)).alias("family"))
    hot = context.one_hot("family", context.ONE_HOT)
    return _count(li, "family").select(
        "family",
        "n",
        context.feature_class("family").alias("feature_class"),
        context.bucket_class("family").alias("bucket_class"),
        F.array_position(hot, F.lit(1.0)).cast("int").alias("hot_position"),
    )


_SIGNATURES = [
    "void_run(int)",
    "boolean_accept()",
    "org.demo.Box#static java.util.List<String> list(java.util.Map<String, List<int[]>>, final String...)",
    "public int org.demo.Outer$Inner.size(@NonNull java.lang.String[])",
    "demo.Box.area",
    "no signature",
    "Box(*,*)",
    "void put(@Size(min=1, max=2) java.lang.String, A<B<C<D<E<F<G<H<I, J>>>>>>>>, int[])",
]
_CANONICAL = ["void_run(int)", "boolean_accept()", "list(Map,String[])", "size(String[])", "", "", "Box(*,*)", "put(String,A,int[])"]
_SIMPLE = ["run", "accept", "List<String> list", "size", "area", "no signature", "Box", "void put"]
_PARAMETERS = ["1", "0", "2", "1", "0", "0", "2", "3"]


@query(
    "F10_F14_signatures",
    f"""
SELECT sig, n, {sql_pick(_CANONICAL, 'i')} AS canonical, {sql_pick(_SIMPLE, 'i')} AS simple_name,
  CAST({sql_pick(_PARAMETERS, 'i')} AS INT) AS parameters,
  CASE WHEN i = 6 THEN 2 ELSE -1 END AS wildcard_arity, 'Inner' AS simple_class
FROM (SELECT i, n, {sql_pick(_SIGNATURES, 'i')} AS sig
  FROM (SELECT p_partkey % {len(_SIGNATURES)} AS i, count(*) AS n FROM part GROUP BY 1))""",
)
def signature_forms(spark, sf):
    parts = table(spark, sf, "part").select((F.col("p_partkey") % len(_SIGNATURES)).alias("i"))
    rows = _count(parts, "i").select(v.pick(_SIGNATURES, F.col("i")).alias("sig"), "n", "i")
    return rows.select(
        "sig",
        "n",
        signatures.canonical_signature("sig").alias("canonical"),
        signatures.method_simple_name("sig").alias("simple_name"),
        F.size(signatures.parameter_types("sig")).alias("parameters"),
        signatures.wildcard_constructor_arity(F.lit("demo.Box<T>"), F.lit("super"), "sig").alias("wildcard_arity"),
        signatures.simple_class_name(F.lit("org.demo.Outer$Inner")).alias("simple_class"),
    )


_ROW_PARTS = """
SELECT p_partkey AS part, 'B' || p_brand[7:] AS owner, 'm' || p_partkey || replace(p_name, ' ', '') AS name, 'T' || p_size AS t, p_size, p_size % 4 AS k FROM part"""


@query(
    "F10_F14_row_signatures",
    f"""
WITH r AS ({_ROW_PARTS}), s AS (
  SELECT *, list_slice(['Map', t || '[]', 'int'], 1, k) AS short, list_slice(['java.util.Map<String, List<' || t || '[]>>', 'final org.x.' || t || '...', '@Size(min=1, max=' || p_size || ') int'], 1, k) AS long FROM r
)
SELECT part, name || '(' || coalesce(array_to_string(short, ','), '') || ')' AS canonical, name AS simple_name, coalesce(array_to_string(short, ';'), '') AS parameters, coalesce(array_to_string(long, ';'), '') AS written,
  CASE WHEN p_size % 5 = 0 AND k > 0 THEN -1 ELSE CAST(k AS INT) END AS arity, 'In' || p_size AS simple_class FROM s""",
)
def row_signatures(spark, sf):
    """Signature texts from every part's own columns: packages, generics with commas, annotations, varargs, wildcards."""
    size, k = F.col("p_size"), F.col("p_size") % 4
    name = F.concat(F.lit("m"), F.col("p_partkey").cast("string"), F.regexp_replace("p_name", " ", ""))
    owner, t = F.concat(F.lit("B"), F.substring("p_brand", 7, 9)), F.concat(F.lit("T"), size.cast("string"))
    every = F.array(
        F.concat(F.lit("java.util.Map<String, List<"), t, F.lit("[]>>")), F.concat(F.lit("final org.x."), t, F.lit("...")),
        F.concat(F.lit("@Size(min=1, max="), size.cast("string"), F.lit(") int")),
    )
    inside = F.array_join(F.slice(every, 1, k), ", ")
    stars = F.array_join(F.array_repeat(F.when(size % 5 == 0, "String").otherwise("*"), k.cast("int")), ",")
    # a row costs far more than its few bytes, by which a file is cut into tasks
    parts = table(spark, sf, "part").select("p_partkey", "p_name", "p_brand", "p_size").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = parts.select(
        F.col("p_partkey").alias("part"), F.concat(F.lit("org.demo."), owner, F.lit("#static java.util.List<String> "), name, F.lit("("), inside, F.lit(")")).alias("raw"),
        F.concat(F.lit("boolean_"), name, F.lit("("), inside, F.lit(")")).alias("flat"), F.concat(owner, F.lit("("), stars, F.lit(")")).alias("call"),
        F.concat(F.lit("demo."), owner, F.lit("<T>")).alias("owner"), F.concat(F.lit("org.demo."), owner, F.lit("$In"), size.cast("string")).alias("inner"),
    )
    return rows.select(
        "part", signatures.canonical_signature("raw").alias("canonical"), signatures.method_simple_name("flat").alias("simple_name"),
        F.array_join(signatures.parameter_types("raw"), ";").alias("parameters"), F.array_join(signatures.parameter_texts("raw"), ";").alias("written"),
        signatures.wildcard_constructor_arity("owner", F.lit("super"), "call").alias("arity"), signatures.simple_class_name("inner").alias("simple_class"),
    )


@query(
    "F15_F16_F56_paths_and_site_ids",
    """
SELECT '/data/proj' || (user_id % 5) AS module_home, '/data/proj' || (user_id % 5) || '/result/A.java' AS clean_path,
  project || '::' || class_name || '::' || method AS function_id,
  project || '::' || class_name || '::' || method || '::' || line AS site_by_line,
  project || '::' || class_name || '::' || method || '::' || regexp_extract(operator, '^([^_]*)_', 1) AS site_by_family,
  project || '::' || class_name || '::' || method || '::' || line || '::UNKNOWN_OPERATOR' AS cluster_id,
  'UNKNOWN_PROJECT::' || class_name || '::UNKNOWN_METHOD' AS unknown_function, count(*) AS n
FROM v_traj GROUP BY ALL""",
    ("v_traj",),
)
def paths_and_sites(spark, sf):
    t = v.v_traj(spark, sf)
    raw = F.concat(F.lit("\\\\?\\/data\\proj"), (F.col("user_id") % 5).cast("string"), F.lit("\\result/A.java"))
    cleaned = keys.clean_path(raw)
    function = keys.function_id("project", "class_name", "method")
    site = keys.site_id_by_line(function, "line")
    rows = t.select(
        keys.module_home(cleaned).alias("module_home"),
        cleaned.alias("clean_path"),
        function.alias("function_id"),
        site.alias("site_by_line"),
        keys.site_id_by_family(function, "operator").alias("site_by_family"),
        keys.cluster_id(site, F.lit(" ")).alias("cluster_id"),
        keys.function_id(F.lit(None), "class_name", F.lit("")).alias("unknown_function"),
    )
    return _count(rows, *rows.columns)


_MASKED = ["pass", "java.lang.assertionerror: expected 3 at line=n", "time_out: more than n milliseconds",
           "java.lang.noclassdeffounderror: box@hex", "java.lang.outofmemoryerror: java heap space",
           "worker_error: lost connection :42", "java.lang.illegalstateexception: bad state @hex"]


@query(
    "F17_F19_outcome_texts",
    f"""
SELECT {sql_pick(_MASKED, 'i - 1')} AS normal_form, i = 3 AS is_timeout, i = 4 AS is_infrastructure,
  CASE i WHEN 1 THEN 'PASS' WHEN 3 THEN 'TIMEOUT' WHEN 4 THEN 'INFRA_ERROR' ELSE 'EXCEPTION' END AS outcome_class, count(*) AS n
FROM (SELECT list_position({sql_list(OUTCOME_TEXTS)}, mutant_result) AS i FROM v_outcomes) GROUP BY ALL""",
    ("v_outcomes",),
)
def outcome_texts(spark, sf):
    o = v.v_outcomes(spark, sf)
    rows = o.select(
        outcomes.normalize_failure_text("mutant_result").alias("normal_form"),
        outcomes.is_timeout_text("mutant_result").alias("is_timeout"),
        outcomes.is_infrastructure_text("mutant_result").alias("is_infrastructure"),
        outcomes.outcome_class("mutant_result").alias("outcome_class"),
    )
    return _count(rows, *rows.columns)


@query(
    "F20_F21_kill_rules",
    f"""
SELECT symmetric_reason, symmetric_reason NOT IN ('SAME_RESULT', 'INFRA_UNCERTAIN') AS symmetric_killed, kills AS runner_killed, count(*) AS n
FROM (SELECT *, CASE WHEN o = m THEN 'SAME_RESULT' WHEN o = 3 OR m = 3 THEN 'TIMEOUT_ASYMMETRY'
    WHEN o = 4 OR m = 4 THEN 'INFRA_UNCERTAIN' WHEN o > 1 OR m > 1 THEN 'EXCEPTION_MISMATCH'
    ELSE 'OUTPUT_DIFFERENT' END AS symmetric_reason FROM v_kills) GROUP BY ALL""",
    ("v_outcomes", "v_kills"),
)
def kill_rules(spark, sf):
    o = v.v_outcomes(spark, sf)
    rows = outcomes.with_runner_kill(o, "original_result", "mutant_result", "runner_killed")
    rows = outcomes.with_kill_decision(rows, "original_result", "mutant_result", "symmetric_").select(
        "symmetric_reason", "symmetric_killed", "runner_killed"
    )
    return _count(rows, *rows.columns)


def _sql_rules(rules, text):
    out = []
    for label, alternatives in rules:
        if isinstance(alternatives, str):
            cond = f"contains({text}, 'cannot find symbol') AND regexp_matches({text}, 'symbol:\\s+variable\\s')"
        else:
            cond = " OR ".join("(" + " AND ".join(f"contains({text}, '{w}')" for w in alt) + ")" for alt in alternatives)
        out.append(f"WHEN {cond} THEN '{label}'")
    return " ".join(out)


_ERROR_ROWS = f"""SELECT t, count(*) AS n FROM (SELECT {sql_pick(ERROR_TEXTS, f'(l_partkey + l_suppkey) % {len(ERROR_TEXTS)}')} AS t FROM lineitem) GROUP BY 1"""


@query(
    "F22_F24_compile_errors",
    f"""
SELECT t AS error_text, n, CASE {_sql_rules(fixed.COMPILE_ERROR_KINDS, 'lower(t)')} ELSE 'OTHER' END AS kind,
  CASE {_sql_rules(fixed.COARSE_COMPILE_CATEGORIES, 'lower(t)')} WHEN t = '' THEN '{fixed.COARSE_COMPILE_NO_TEXT}'
    ELSE '{fixed.COARSE_COMPILE_OTHER}' END AS category, t AS summary FROM ({_ERROR_ROWS})""",
)
def compile_error_texts(spark, sf):
    li = table(spark, sf, "lineitem")
    texts = li.select(v.pick(ERROR_TEXTS, (F.col("l_partkey") + F.col("l_suppkey")) % len(ERROR_TEXTS)).alias("error_text"))
    noisy = F.concat(F.lit("javac failed\n[javac output]\n"), F.regexp_replace("error_text", " ", "  "), F.lit("\n"))
    return _count(texts, "error_text").select(
        "error_text",
        "n",
        compile_errors.compile_error_kind("error_text").alias("kind"),
        compile_errors.coarse_compile_category("error_text").alias("category"),
        compile_errors.compile_error_summary(noisy).alias("summary"),
    )


_SKIPS = ["NO_CALLABLE: nothing", "UNSAFE_ENTRY", "has NO_PUBLIC_OBSERVABLE here", "the constructor mutates internal/inherited state",
          "needs reflection", "other words", ""]
_SKIP_LABELS = ["NO_CALLABLE", "UNSAFE_ENTRY", "NO_PUBLIC_OBSERVABLE", "CONSTRUCTOR_STATE_MUTATION_NO_PUBLIC_OBSERVABLE",
                "REFLECTION_RELATED_SKIP", "OTHER_SKIP_REASON", "SKIP_WITH_EMPTY_REASON"]


@query(
    "F25_A15_skip_categories",
    f"""
SELECT CASE WHEN c_nationkey = 0 THEN 'MISSING_OUTPUT_JSON' WHEN c_nationkey = 1 THEN 'INVALID_OUTPUT_JSON'
  WHEN c_nationkey = 2 THEN 'NOT_SKIPPED_BY_PROMPT_EVIDENCE' ELSE {sql_pick(_SKIP_LABELS, 'c_custkey % 7')} END AS skip_category,
  count(*) AS rows FROM customer GROUP BY 1""",
)
def skip_categories(spark, sf):
    from ..operators.status_report import skip_categories as counts

    n = F.col("c_nationkey")
    rows = table(spark, sf, "customer").withColumn(
        "skip_category",
        compile_errors.skip_category(n != 0, n != 1, n != 2, v.pick(_SKIPS, F.col("c_custkey") % 7)),
    )
    return counts(rows)


@query(
    "F26_F30_statuses",
    """
SELECT backfilled, category, executed, non_executed, derived, normalized, count(*) AS n FROM (SELECT
  CASE WHEN s <> '' THEN s WHEN killed THEN 'KILLED' WHEN compiled = false THEN 'COMPILE_FAILED_AFTER_REPAIR'
    WHEN compiled THEN 'SURVIVED' ELSE '' END AS backfilled,
  CASE WHEN s = 'KILLED' OR killed THEN 'KILLED'
    WHEN s = 'COMPILE_FAILED_AFTER_REPAIR' OR (compiled = false AND s = '') THEN 'COMPILE_FAILED'
    WHEN s = 'SURVIVED' OR coalesce(compiled, false) THEN 'SURVIVED' ELSE 'OTHER' END AS category,
  s IN ('KILLED', 'SURVIVED', 'ORIGINAL_FAILED') AS executed,
  s IN ('COMPILE_FAILED_AFTER_REPAIR', 'SKIPPED_BY_EVIDENCE') AS non_executed,
  CASE WHEN s <> '' THEN s WHEN lower(failure_reason) LIKE '%reasoning_content only%' THEN 'LLM_NO_VISIBLE_CODE'
    WHEN lower(failure_reason) LIKE '%finish_reason=length%' THEN 'LLM_OUTPUT_INVALID'
    WHEN repair_rounds > 0 THEN 'COMPILE_FAILED_AFTER_REPAIR' WHEN failure_reason <> '' THEN 'COMPILE_FAILED_AFTER_GENERATION'
    ELSE 'NOT_EXECUTED' END AS derived,
  CASE k % 5 WHEN 0 THEN 'TASK_CRASHED' WHEN 1 THEN 'SURVIVED' WHEN 2 THEN 'TIMEOUT' WHEN 3 THEN 'TASK_CRASHED' ELSE 'KILLED' END AS normalized
  FROM (SELECT *, CASE WHEN k % 7 = 0 THEN '' ELSE target_status END AS s,
    CASE WHEN k % 5 = 0 THEN NULL ELSE compile_success END AS compiled FROM v_traj)) GROUP BY ALL""",
    ("v_traj",),
)
def statuses(spark, sf):
    t = v.v_traj(spark, sf)
    k = F.col("k")
    t = t.withColumns(
        {
            "s": F.when(k % 7 == 0, F.lit("")).otherwise(F.col("target_status")),
            "compiled": F.when(k % 5 != 0, F.col("compile_success")),
            "runner": v.pick(["", "live", "Timeout: 3", "ERROR", "KILLED"], k % 5),
        }
    )
    rows = t.select(
        status.backfilled_status("s", "killed", "compiled").alias("backfilled"),
        status.final_category("s", "killed", "compiled").alias("category"),
        status.is_executed("s").alias("executed"),
        status.is_non_executed("s").alias("non_executed"),
        status.non_executed_status("s", "failure_reason", "repair_rounds", F.lit(0)).alias("derived"),
        status.executed_status("runner", F.lit("")).alias("normalized"),
    )
    return _count(rows, *rows.columns)


_PHASE_SQL = """CASE WHEN k % 17 = 0 AND compile_success AND original_pass AND NOT killed THEN 'EQUIVALENT_SUSPECTED'
  WHEN killed THEN 'TARGET_KILLED' WHEN timed_out THEN 'TIMEOUT' WHEN NOT compile_success THEN 'COMPILE_FAILED'
  WHEN NOT original_pass THEN 'ORIGINAL_FAILED' ELSE 'TARGET_LIVE' END"""


def _phase():
    return status.phase("target_status", "killed", "compile_success", "original_pass", "timed_out", F.col("k") % 17 == 0)


@query(
    "F31_F32_F42_phases",
    f"""
SELECT phase, CASE WHEN phase = 'TARGET_LIVE' THEN 6 ELSE 1 END AS allowed_actions, phase = 'TARGET_LIVE' AS may_switch_observable,
  symptom, count(*) AS n FROM (SELECT {_PHASE_SQL} AS phase, CASE WHEN timed_out THEN 'timeout'
    WHEN NOT compile_success THEN 'compile_failed' WHEN NOT original_pass THEN 'original_failed' WHEN NOT killed THEN 'survived'
    ELSE 'killed' END AS symptom FROM v_traj) GROUP BY ALL""",
    ("v_traj",),
)
def phases(spark, sf):
    t = v.v_traj(spark, sf).withColumn("phase", _phase())
    rows = t.select(
        "phase",
        F.size(status.allowed_actions("phase")).alias("allowed_actions"),
        status.action_allowed("phase", F.lit("OBSERVABLE_SWITCH")).alias("may_switch_observable"),
        status.symptom("target_status", "killed", "compile_success", "original_pass", "timed_out").alias("symptom"),
    )
    return _count(rows, *rows.columns)


@query(
    "F33_rewards",
    """
SELECT line_no, round(CASE WHEN killed THEN 7.0 ELSE 0.0 END + CASE WHEN compile_success THEN 0.5 ELSE -4.0 END
  + CASE WHEN original_pass THEN 0.5 ELSE 0.0 END + CASE WHEN compile_success AND original_pass AND NOT killed AND NOT timed_out THEN -2.5 ELSE 0.0 END
  - 0.2 * repair_rounds - 0.0001 * prompt_chars - 0.001 * elapsed_ms / 1000.0 + CASE WHEN timed_out THEN -3.0 ELSE 0.0 END
  + CASE WHEN target_status = 'ORIGINAL_FAILED' THEN -4.0 ELSE 0.0 END, 6) AS total_reward,
  CAST(CASE WHEN compile_success AND original_pass AND NOT killed AND NOT timed_out THEN -2.5 ELSE 0.0 END AS DOUBLE) AS survived_penalty,
  CAST(CASE WHEN timed_out THEN -3.0 ELSE 0.0 END AS DOUBLE) AS timeout_penalty FROM v_traj""",
    ("v_traj",),
)
def reward_totals(spark, sf):
    t = v.v_traj(spark, sf)
    r = rewards.reward_breakdown(
        "compile_success", "original_pass", "killed", "repair_rounds", "prompt_chars", "elapsed_ms", "timed_out",
        F.col("target_status") == fixed.ORIGINAL_FAILED,
    )
    return t.select("line_no", r.alias("r")).select(
        "line_no", F.round("r.total", 6).alias("total_reward"), "r.survived_penalty", "r.timeout_penalty"
    )


_BEFORE = ["NOT_GENERATED", "GENERATED", "COMPILED", "ORIGINAL_PASSED", "TARGET_KILLED", "COMPILE_FAILED"]


@query(
    "F34_transition_rewards",
    f"""
SELECT line_no, round(CASE WHEN target_status = 'API_FAILED' THEN 0.0 ELSE
  g + CASE WHEN compile_success AND g > 0 THEN least(0.5, 0.25 * g) ELSE 0.0 END
  + CASE WHEN original_pass AND a >= 3 AND b < 3 THEN 0.5 ELSE 0.0 END + CASE WHEN killed THEN 7.0 ELSE 0.0 END
  + CASE WHEN phase = 'TARGET_LIVE' AND NOT killed THEN -2.5 ELSE 0.0 END - 0.2 * repair_rounds - 0.0001 * prompt_chars
  - 0.001 * elapsed_ms / 1000.0 + CASE WHEN timed_out THEN -3.0 ELSE 0.0 END + CASE WHEN NOT compile_success THEN -2.0 ELSE 0.0 END
  + CASE WHEN phase = 'ORIGINAL_FAILED' THEN -3.0 ELSE 0.0 END + CASE WHEN g < 0 THEN -1.0 ELSE 0.0 END END, 6) AS total_reward
FROM (SELECT *, CAST(a - b AS DOUBLE) AS g FROM (SELECT *,
  CASE phase WHEN 'TARGET_KILLED' THEN 7 WHEN 'TARGET_LIVE' THEN 2 ELSE 0 END AS a,
  CASE {sql_pick(_BEFORE, 'k % 6')} WHEN 'TARGET_KILLED' THEN 7 WHEN 'ORIGINAL_PASSED' THEN 3 WHEN 'COMPILED' THEN 2
    WHEN 'GENERATED' THEN 1 ELSE 0 END AS b
  FROM (SELECT *, {_PHASE_SQL} AS phase FROM v_traj)))""",
    ("v_traj",),
)
def transition_totals(spark, sf):
    t = v.v_traj(spark, sf).withColumns({"phase": _phase(), "before": v.pick(_BEFORE, F.col("k") % 6)})
    r = rewards.transition_reward(
        "before", "phase", "target_status", "compile_success", "original_pass", "killed", "timed_out", "repair_rounds",
        "prompt_chars", "elapsed_ms",
    )
    return t.select("line_no", r.alias("r")).select("line_no", F.round("r.total", 6).alias("total_reward"))


_KINDS = ["branch_forced_x", "BOUNDARY", "return value", "field write", "other", ""]
_STATES = ["SAT", "UNSAT", "UNKNOWN", "", "MAYBE"]


@query(
    "F35_F37_bucket_keys",
    f"""
SELECT exact_bucket, coarse_bucket, count(*) AS n FROM (SELECT
  cls || '|' || entry_kind || '|' || observable || '|' || sem || '|' || con || '|UNKNOWN|' ||
    CASE WHEN prompt_chars <= 8000 THEN 'SMALL' WHEN prompt_chars <= 20000 THEN 'MEDIUM' ELSE 'LARGE' END AS exact_bucket,
  cls || '|' || observable || '|' || sem || '|' || con AS coarse_bucket
FROM (SELECT *, CASE WHEN user_id % 5 = 0 THEN 'NUMERIC_EXPR' WHEN user_id % 5 = 1 THEN 'RELATIONAL_BRANCH' WHEN user_id % 5 = 2 THEN 'STATE_UPDATE_MISSING'
    WHEN user_id % 5 = 3 THEN 'BOOLEAN_CONDITION' ELSE 'BITWISE_SHIFT' END AS cls,
  CASE WHEN k % 10 = 0 THEN 'FORCED_BRANCH' ELSE {sql_pick(['FORCED_BRANCH', 'BOUNDARY_COMPARISON', 'RETURN_ORACLE', 'STATE_OR_FIELD', 'OTHER_SEMANTIC', 'UNKNOWN_SEMANTIC'], 'k % 6')} END AS sem,
  {sql_pick(['CONSTRAINT_SAT', 'CONSTRAINT_UNSAT', 'CONSTRAINT_UNKNOWN', 'CONSTRAINT_UNKNOWN', 'CONSTRAINT_OTHER'], 'k % 5')} AS con FROM v_traj)) GROUP BY ALL""",
    ("v_traj",),
)
def bucket_keys(spark, sf):
    t = v.v_traj(spark, sf)
    k = F.col("k")
    family, kind, state = keys.operator_family("operator"), v.pick(_KINDS, k % 6), v.pick(_STATES, k % 5)
    forced = k % 10 == 0
    rows = t.select(
        context.exact_bucket_key(family, "entry_kind", "observable", kind, forced, state, F.lit(" "), "prompt_chars").alias("exact_bucket"),
        context.coarse_bucket_key(family, "observable", kind, forced, state).alias("coarse_bucket"),
    )
    return _count(rows, *rows.columns)


def _context(spark, sf):
    """Context columns from the run log; the remaining ones stay absent."""
    k = F.col("k")
    return v.v_traj(spark, sf).select(
        "line_no",
        keys.operator_family("operator").alias("operator_family"),
        (k % 2 == 0).alias("use_reflection_fallback"),
        (k % 3 == 0).alias("has_kb_context"),
        (k % 21).alias("kb_entry_count"),
        F.col("prompt_chars").alias("estimated_prompt_size"),
        (k + 1).alias("function_mutant_count"),
        (k % 20).alias("function_processed_count"),
        F.col("observable").alias("observable_plan_kind"),
        F.col("entry_kind").alias("kb_owner_visibility"),
        (k % 12).alias("mandatory_guard_count"),
        (k / 50.0).alias("entry_independent_coverage"),
        v.pick(["DIRECT_RETURN", "INDIRECT", "SIMPLE_STATE", "NONE"], k % 4).alias("observable_directness"),
        (k % 7 == 0).alias("previous_killed"),
        (k * 1.5).alias("best_reference_similarity"),
    )


@query(
    "F38_F41_context_vector",
    """
SELECT line_no, 60 AS dims, round(1.0 + a + b + c1 + c2 + c3 + sh + 1.0 + obs + pub + g + cov + dir + pk + sim, 6) AS vector_sum,
  round(1.0 / sqrt(k + 1), 6) AS weight FROM (SELECT line_no, k,
  CASE WHEN k % 2 = 0 THEN 1.0 ELSE 0.0 END AS a, CASE WHEN k % 3 = 0 THEN 1.0 ELSE 0.0 END AS b,
  ln(1.0 + k % 21) / ln(21.0) AS c1, ln(1.0 + prompt_chars) / ln(60001.0) AS c2, ln(2.0 + k) / ln(501.0) AS c3,
  least(1.0, (k % 20) / CAST(k + 1 AS DOUBLE)) AS sh,
  CASE observable WHEN 'EXCEPTION' THEN 1.0 WHEN 'RETURN_VALUE' THEN 1.0 WHEN 'FIELD_STATE' THEN 1.0 ELSE 0.0 END AS obs,
  CASE WHEN entry_kind = 'PUBLIC' THEN 1.0 ELSE 0.0 END AS pub, ln(1.0 + k % 12) / ln(13.0) AS g, least(1.0, k / 50.0) AS cov,
  CASE k % 4 WHEN 0 THEN 1.0 WHEN 1 THEN 0.15 WHEN 2 THEN 0.65 ELSE 0.0 END AS dir,
  CASE WHEN k % 7 = 0 THEN 1.0 ELSE 0.0 END AS pk, least(1.0, k * 1.5 / 130.0) AS sim FROM v_traj)""",
    ("v_traj",),
)
def context_vectors(spark, sf):
    c = _context(spark, sf)
    x = c.withColumn("x", context.context_vector(c.columns))
    return x.select(
        "line_no",
        F.size("x").alias("dims"),
        F.round(F.aggregate("x", F.lit(0.0), lambda a, b: a + b), 6).alias("vector_sum"),
        F.round(context.sample_weight("function_mutant_count"), 6).alias("weight"),
    )


@query(
    "F43_root_causes",
    """
SELECT stage, cause, confidence, primary_fix, auto_repairable, count(*) AS n FROM (SELECT r[1] AS stage, r[2] AS cause,
  CAST(r[3] AS DOUBLE) AS confidence, r[4] AS primary_fix, r[2] = 'MISSING_IMPORT_KNOWLEDGE' AS auto_repairable FROM (
SELECT CASE WHEN killed THEN ['UNKNOWN', 'UNCLASSIFIED_FAILURE', '1.0', '']
  WHEN timed_out THEN ['TEST_GENERATOR', 'TIMEOUT_OR_BUDGET_LIMIT', '0.95', 'TEST_GENERATOR']
  WHEN NOT compile_success AND (contains(t, 'symbol') OR contains(t, 'import') OR (contains(t, 'package ') AND contains(t, ' does not exist')))
    THEN CASE WHEN k % 2 <> 0 THEN ['KNOWLEDGE_BASE', 'MISSING_IMPORT_KNOWLEDGE', '0.9', 'KNOWLEDGE_BASE']
      WHEN k % 3 <> 0 THEN ['EVIDENCE_BUILDER', 'IMPORT_ASSEMBLY_BUG', '0.9', 'EVIDENCE_BUILDER']
      ELSE ['TEST_GENERATOR', 'IMPORT_NOT_USED', '0.85', 'TEST_GENERATOR'] END
  WHEN NOT compile_success AND (contains(t, 'private access') OR contains(t, 'has protected access') OR contains(t, 'cannot be accessed')
      OR contains(t, 'non-static method') OR (contains(t, 'method') AND contains(t, 'cannot be applied')))
    THEN CASE WHEN k % 2 <> 0 THEN ['KNOWLEDGE_BASE', 'MISSING_ENTRY_CANDIDATE', '0.88', 'KNOWLEDGE_BASE']
      WHEN k % 3 <> 0 THEN ['EVIDENCE_BUILDER', 'ENTRY_ASSEMBLY_BUG', '0.84', 'EVIDENCE_BUILDER']
      ELSE ['TEST_GENERATOR', 'ENTRY_NOT_USED', '0.84', 'TEST_GENERATOR'] END
  WHEN (NOT compile_success AND (contains(t, 'constructor') OR contains(t, 'cannot be applied to given types'))) OR (compile_success AND NOT original_pass)
    THEN CASE WHEN k % 2 <> 0 THEN ['KNOWLEDGE_BASE', 'MISSING_RECEIVER_CONSTRUCTION', '0.8', 'KNOWLEDGE_BASE']
      WHEN k % 3 <> 0 THEN ['EVIDENCE_BUILDER', 'ENTRY_ASSEMBLY_BUG', '0.74', 'EVIDENCE_BUILDER']
      ELSE ['TEST_GENERATOR', 'RECEIVER_SETUP_WEAK', '0.76', 'TEST_GENERATOR'] END
  WHEN NOT compile_success THEN ['TEST_GENERATOR', 'COMPILE_REPAIR_WEAK', '0.7', 'TEST_GENERATOR']
  WHEN k % 17 = 0 THEN ['CROSS_STAGE', 'LIKELY_EQUIVALENT_MUTANT', '0.82', 'MANUAL_OR_EQ_RULE']
  WHEN k % 5 = 0 THEN ['EVIDENCE_BUILDER', 'OBSERVABLE_PLAN_MISSING', '0.8', 'EVIDENCE_BUILDER']
  WHEN k % 4 = 0 THEN ['TEST_GENERATOR', 'ASSERTION_GENERATION_WEAK', '0.76', 'TEST_GENERATOR']
  ELSE ['CROSS_STAGE', 'UNCLASSIFIED_FAILURE', '0.45', 'MANUAL_REVIEW'] END AS r
FROM (SELECT *, lower(failure_reason) AS t FROM v_traj))) GROUP BY ALL""",
    ("v_traj",),
)
def root_causes(spark, sf):
    k = F.col("k")
    t = v.v_traj(spark, sf).withColumns(
        {
            "compiled": F.col("compile_success"),
            "original_passed": F.col("original_pass"),
            "equivalence_suspicion": k % 17 == 0,
            "regeneration_round": F.lit(0),
            **{f"{x}_in_kb": k % 2 == 0 for x in ("import", "entry", "receiver")},
            **{f"{x}_in_evidence": k % 3 == 0 for x in ("import", "entry", "receiver")},
            "observable_in_kb": k % 5 == 0,
            "assertion_in_prompt": k % 4 == 0,
        }
    )
    rows = t.select(attribution.root_cause(t.columns).alias("c")).select("c.*").drop("secondary_fix")
    return _count(rows, *rows.columns)


@query(
    "F45_F46_flags_and_scales",
    f"""
SELECT visibility, n, equivalent, CAST(q AS DOUBLE) AS query_score, CAST(d AS DOUBLE) AS derived_score, CAST(a AS DOUBLE) AS access_score FROM (
  SELECT visibility, CASE WHEN e IN (1, 2) THEN '1' WHEN e = 3 THEN '0' ELSE '1' END AS equivalent, count(*) AS n,
  CASE visibility WHEN 'public' THEN 60 WHEN 'protected' THEN 45 WHEN 'package-private' THEN 35 ELSE 0 END AS q,
  CASE visibility WHEN 'public' THEN 100 WHEN 'protected' THEN 70 WHEN 'package-private' THEN 50 ELSE 10 END AS d,
  CASE visibility WHEN 'public' THEN 100 WHEN 'protected' THEN 75 ELSE 50 END AS a
  FROM (SELECT visibility, method_id % 5 AS e FROM v_methods) GROUP BY ALL)""",
    ("v_methods",),
)
def flags_and_scales(spark, sf):
    m = v.v_methods(spark, sf).withColumn(
        "equivalent", status.equivalent_flag(v.pick(["", "1", "Yes", "no", "?"], F.col("method_id") % 5), F.lit(True))
    )
    return _count(m, "visibility", "equivalent").select(
        "visibility",
        "equivalent",
        "n",
        scores.visibility_score("visibility", fixed.VISIBILITY_QUERY).alias("query_score"),
        scores.visibility_score("visibility", fixed.VISIBILITY_DERIVED).alias("derived_score"),
        scores.visibility_score("visibility", fixed.VISIBILITY_ACCESS).alias("access_score"),
    )


@query(
    "F50_token_budgets",
    f"""
SELECT attempt, t AS error_text, CAST(ceil(length(t) / 3.0) AS INT) AS tokens, least(30000, CAST(ceil(10000.0 * i) AS INT)) AS input_tokens,
  least(10500, CAST(ceil(3500.0 * o) AS INT)) AS output_tokens, n FROM (SELECT attempt, t, n,
  (CASE attempt WHEN 0 THEN 1.0::DOUBLE WHEN 1 THEN 1.8::DOUBLE ELSE 2.6::DOUBLE END)
  * CASE WHEN attempt > 0 AND c THEN 1.2::DOUBLE ELSE 1.0::DOUBLE END * CASE WHEN attempt > 0 AND m THEN 1.1::DOUBLE ELSE 1.0::DOUBLE END
  * CASE WHEN attempt > 0 AND s THEN 1.2::DOUBLE ELSE 1.0::DOUBLE END AS i,
  (CASE attempt WHEN 0 THEN 1.0::DOUBLE WHEN 1 THEN 1.45::DOUBLE ELSE 2.3::DOUBLE END)
  * CASE WHEN attempt > 0 AND c THEN 1.2::DOUBLE ELSE 1.0::DOUBLE END * CASE WHEN attempt > 0 AND m THEN 1.1::DOUBLE ELSE 1.0::DOUBLE END
  * CASE WHEN attempt > 0 AND s THEN 1.3::DOUBLE ELSE 1.0::DOUBLE END AS o
FROM (SELECT *, contains(l, 'constructor') OR contains(l, 'cannot be applied') OR contains(l, 'private access') AS c,
  contains(l, 'cannot find symbol') OR contains(l, 'method') AS m, contains(l, 'abstract') OR contains(l, 'does not override') AS s
FROM (SELECT l_linenumber % 3 AS attempt, {sql_pick(ERROR_TEXTS, f'(l_partkey + l_suppkey) % {len(ERROR_TEXTS)}')} AS t, lower(t) AS l,
  count(*) AS n FROM lineitem GROUP BY ALL)))""",
)
def token_budgets(spark, sf):
    li = table(spark, sf, "lineitem").select(
        (F.col("l_linenumber") % 3).alias("attempt"),
        v.pick(ERROR_TEXTS, (F.col("l_partkey") + F.col("l_suppkey")) % len(ERROR_TEXTS)).alias("error_text"),
    )
    return _count(li, "attempt", "error_text").select(
        "attempt",
        "error_text",
        scores.estimated_tokens("error_text").alias("tokens"),
        scores.prompt_budget("attempt", "error_text", F.lit(False)).alias("b"),
        "n",
    ).select("attempt", "error_text", "tokens", "b.input_tokens", "b.output_tokens", "n")


@query(
    "F51_F53_F57_document_texts",
    """
SELECT doc_id, length(CASE WHEN length(text) > 500 THEN substr(text, 1, 500) || '//cut' ELSE text END) AS clipped_chars,
  length(CASE WHEN length(text) > 400 THEN substr(text, 1, 400) || chr(10) || chr(10) || '...[TRUNCATED ' || (length(text) - 400) || ' CHARS]...' ELSE text END) AS payload_chars,
  CASE WHEN lang = source OR source = '' THEN lang ELSE lang || '; ' || source END AS reasons,
  '["' || lang || '","' || source || '"]' AS json_list, CAST(ceil(length(text) / 3.0) AS INT) AS tokens FROM documents""",
)
def document_texts(spark, sf):
    d = table(spark, sf, "documents")
    listed = F.array("lang", "source")
    return d.select(
        "doc_id",
        F.length(tx.clip("text", 500, "//cut")).alias("clipped_chars"),
        F.length(tx.clip_with_count("text", 400)).alias("payload_chars"),
        tx.join_reasons(F.array("lang", F.lit(" "), "source", "lang")).alias("reasons"),
        tx.to_json_list(tx.from_json_list(tx.to_json_list(listed))).alias("json_list"),
        scores.estimated_tokens("text").alias("tokens"),
    )


@query(
    "F52_prompt_keys",
    "SELECT conv_id, turn, sha256('ns' || chr(10) || text) AS cache_key FROM conversations",
)
def prompt_keys(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", keys.prompt_cache_key(F.lit("ns"), "text").alias("cache_key"))


@query(
    "F54_primary_test_mentions",
    """
SELECT killed, (killed AND report_id % 2 = report_id % 3) AS by_primary, count(*) AS n FROM v_suites GROUP BY ALL""",
    ("v_suites",),
)
def primary_mentions(spark, sf):
    s = v.v_suites(spark, sf).withColumn("name", F.concat(F.lit("T"), (F.col("report_id") % 3).cast("string"), F.lit("_"), F.substring("mutant", 2, 20)))
    return _count(s.select("killed", keys.mentions_test("tests", "name").alias("by_primary")), "killed", "by_primary")


@query(
    "F55_response_code",
    """
SELECT conv_id, turn, CASE turn % 3 WHEN 0 THEN trim(text, ' ' || chr(9) || chr(10) || chr(13)) WHEN 1 THEN '' ELSE 'code' END AS code FROM conversations""",
)
def response_code(spark, sf):
    c = table(spark, sf, "conversations")

    def response(**message):
        return F.to_json(F.struct(F.array(F.struct(F.struct(*[x.alias(n) for n, x in message.items()]).alias("message"))).alias("choices")))

    raw = (
        F.when(F.col("turn") % 3 == 0, response(content=F.concat(F.lit("Here:\n```java\n"), F.col("text"), F.lit("\n```\nbye"))))
        .when(F.col("turn") % 3 == 1, response(content=F.lit(" "), reasoning_content=F.col("text")))
        .otherwise(F.lit("```\ncode\n```"))
    )
    return c.select("conv_id", "turn", scores.response_code(raw).alias("code"))
