"""Domain views over the driver tables, once for Spark and once as SQL.

The tables are generic; these mappings give every row of them a meaning in the
domain (run records, outcomes, code facts), so operators run on whole tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import fixed

FAMILIES = ["AOIS", "ROR", "SDL", "COI", "LOR"]

# failure texts that occur in logs; one per rule of the classifiers
ERROR_TEXTS = [
    "Test.java:7: error: cannot find symbol symbol: variable alpha location: class Test",
    "Test.java:9: error: cannot find symbol symbol: method getWidth( location: class Box",
    "Test.java:9: error: cannot find symbol symbol: method run() location: class Box",
    "Test.java:9: error: cannot find symbol symbol: class Missing",
    "error: incompatible types: String cannot be converted to int",
    "error: constructor Box in class Box cannot be applied to given types",
    "error: method run in class Box cannot be applied to given types",
    "error: size has private access in Box",
    "error: size has protected access in Box",
    "error: Box is not public in demo; cannot be accessed from outside package",
    "error: unreported exception IOException; must be caught or declared to be thrown",
    "error: Shape is abstract; cannot be instantiated",
    "error: Box is not abstract and does not override abstract method area()",
    "error: attempting to assign weaker access privileges; was public",
    "error: method does not override or implement a method from a supertype",
    "error: reference to assertEquals is ambiguous",
    "error: no suitable method found for add(int)",
    "error: 'void' type not allowed here void type not allowed here",
    "DataInput stub is missing readLine",
    "finish_reason=length output truncated",
    "reasoning_content only: empty visible content",
    "javac returned success but expected class file not found",
    "error: cannot infer type arguments for Box<>",
    "worker crashed without details",
    "",
]
# outcome texts of test runs
OUTCOME_TEXTS = [
    "pass",
    "java.lang.AssertionError: expected 3 at line: 17",
    "time_out: more than 3000 milliseconds",
    "java.lang.NoClassDefFoundError: Box@1a2b3c",
    "java.lang.OutOfMemoryError: Java heap space",
    "worker_error: lost connection :42",
    "java.lang.IllegalStateException:  bad   state @ff00aa",
]


def literal_array(texts: list[str]) -> Column:
    return F.array(*[F.lit(t) for t in texts])


def sql_list(texts: list[str]) -> str:
    return "[" + ", ".join("'" + t.replace("'", "''") + "'" for t in texts) + "]"


def pick(texts: list[str], index: Column) -> Column:
    return F.get(literal_array(texts), index.cast("int"))


def sql_pick(texts: list[str], index: str) -> str:
    return f"list_extract({sql_list(texts)}, CAST(({index}) AS INT) + 1)"


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf.rstrip('/')}/{name}.parquet")


def _text(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


# --- run log ---------------------------------------------------------------------
def v_traj(spark: SparkSession, sf: str) -> DataFrame:
    return traj_of(table(spark, sf, "events"))


def traj_of(events: DataFrame) -> DataFrame:
    """Run log from the event stream: one mutant per user, one record per event."""
    user, kind = F.col("user_id"), F.col("event_type")
    status = (
        F.when(kind == "purchase", fixed.KILLED)
        .when(kind == "view", fixed.SURVIVED)
        .when(kind == "error", fixed.COMPILE_FAILED_AFTER_REPAIR)
        .when(kind == "click", fixed.ORIGINAL_FAILED)
        .otherwise(fixed.SKIPPED_BY_EVIDENCE)
    )
    base = events.withColumn("k", F.get_json_object("props", "$.k").cast("int"))
    k = F.col("k")
    named = base.select(
        F.col("event_id").alias("line_no"),
        _text("row-", user).alias("task_id"),
        _text("run-", F.pmod(user, F.lit(3))).alias("run_id"),
        _text("proj", F.pmod(user, F.lit(5))).alias("project"),
        _text("C", F.pmod(user, F.lit(20))).alias("class_name"),
        _text("void_m", user, "()").alias("method"),
        _text(pick(FAMILIES, F.pmod(user, F.lit(5))), "_", F.pmod(user, F.lit(9)) + 1).alias("operator"),
        _text(F.pmod(user, F.lit(7)) * 10).alias("line"),
        status.alias("target_status"),
        (~kind.isin("error", "signup")).alias("compile_success"),
        kind.isin("purchase", "view").alias("original_pass"),
        (kind == "purchase").alias("killed"),
        (k % 10 == 9).alias("timed_out"),
        (F.dayofmonth("ts") % 3).alias("outer_loop_round"),
        (k % 4).alias("repair_rounds"),
        (k % 5 + 1).alias("compile_calls"),
        (k % 3 + 1).alias("llm_calls"),
        (k * 400).alias("prompt_chars"),
        F.floor(F.col("value") * 100).cast("long").alias("elapsed_ms"),
        F.col("ts").alias("generated_at"),
        pick(fixed.EVIDENCE_ACTIONS, k % 6).alias("action"),
        _text("T", user % 40).alias("test_name"),
        (F.col("value") / 100 - 2).alias("reward"),
        _text("C", k % 4).alias("coarse_key"),
        _text("C", k % 4, "|", user % 50).alias("exact_key"),
        F.when(kind == "error", pick(ERROR_TEXTS, (k + user) % len(ERROR_TEXTS))).otherwise(F.lit("")).alias("failure_reason"),
        pick(["RETURN_VALUE", "FIELD_STATE", "EXCEPTION", "OTHER"], k % 4).alias("observable"),
        pick(["PUBLIC", "FACTORY", "INDIRECT"], k % 3).alias("entry_kind"),
        pick(["STATIC", "INSTANCE"], k % 2).alias("invocation"),
        "k",
        user.alias("user_id"),
        kind.alias("event_type"),
    )
    return named.withColumn("mutant_id", F.concat_ws("::", "project", "class_name", "method", "operator"))


def v_index(traj: DataFrame) -> DataFrame:
    """Mutant index with one row per user; some rows differ from the log on purpose."""
    users = traj.select("user_id", "project", "class_name", "method", "operator", "mutant_id").distinct()
    kind = F.col("user_id") % 10
    return users.select(
        F.col("user_id").alias("row_no"),
        F.when(kind == 0, F.lit("unknown")).otherwise(F.col("project")).alias("project"),
        "class_name",
        "method",
        "operator",
        F.when(kind <= 1, F.lit("")).otherwise(F.col("mutant_id")).alias("mutant_id"),
    )


def v_feedback(events: DataFrame, targets) -> DataFrame:
    t = traj_of(events)
    k = F.col("k")
    place = pick([targets.knowledge, targets.evidence, targets.generator], F.pmod(F.col("user_id"), F.lit(3)))
    return t.select(
        F.col("line_no").alias("event_id"),
        F.col("line_no").alias("seq"),
        "task_id",
        "mutant_id",
        "run_id",
        "action",
        F.col("compile_success").alias("compiled"),
        F.col("original_pass").alias("original_passed"),
        "killed",
        "target_status",
        "failure_reason",
        (k % 11 == 0).alias("plan_exhausted"),
        (k % 13 != 0).alias("analysed"),
        place.alias("primary_fix"),
        F.when(k % 5 == 0, F.lit(targets.evidence)).otherwise(F.lit("CROSS_STAGE")).alias("failure_stage"),
        pick(["MISSING_IMPORT_KNOWLEDGE", "MISSING_ENTRY_CANDIDATE", "ASSERTION_GENERATION_WEAK", "OTHER"], k % 4).alias("root_cause"),
        F.lit("").alias("secondary_fix"),
        pick(["survived", "compile_failed", "timeout"], k % 3).alias("symptom"),
        (k % 2 == 0).alias("auto_repairable"),
        (k / 100.0).alias("confidence"),
        F.slice(F.array(_text("pkg.A", k % 7), _text("pkg.B", k % 3)), 1, k % 3).alias("suspected_imports"),
        F.date_format("generated_at", "yyyy-MM-dd HH:mm:ss").alias("created_at"),
        "user_id",
        "k",
    )


# --- outcomes, matrix ---------------------------------------------------------------
def v_outcomes(spark: SparkSession, sf: str) -> DataFrame:
    li = table(spark, sf, "lineitem")
    original = F.when(F.col("l_linestatus") == "O", F.lit("pass")).otherwise(
        pick(OUTCOME_TEXTS, F.col("l_partkey") % len(OUTCOME_TEXTS))
    )
    result = F.when(F.col("l_returnflag") == "N", original).otherwise(
        pick(OUTCOME_TEXTS, (F.col("l_partkey") + F.col("l_linenumber")) % len(OUTCOME_TEXTS))
    )
    return li.select(
        _text("C", F.col("l_orderkey") % 50).alias("class_name"),
        _text("m", F.col("l_orderkey") % 500).alias("method"),
        F.col("l_orderkey").alias("mutant"),
        F.col("l_suppkey").alias("test"),
        F.col("l_linenumber").alias("run_no"),
        original.alias("original_result"),
        result.alias("mutant_result"),
    )


def v_matrix(spark: SparkSession, sf: str) -> DataFrame:
    """Kill matrix: (class, mutant, test, kills); equivalence is kept per mutant."""
    li = table(spark, sf, "lineitem")
    return li.select(
        _text("C", F.col("l_orderkey") % 50).alias("class_name"),
        F.col("l_orderkey").alias("mutant"),
        F.col("l_suppkey").alias("test"),
        (F.col("l_returnflag") == "R").alias("kills"),
    )


def v_mutants(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("mutant"),
        _text("C", F.col("o_orderkey") % 50).alias("class_name"),
        (F.col("o_orderstatus") == "P").alias("equivalent"),
    )


# --- run reports -------------------------------------------------------------------
def _order_key() -> list[Column]:
    c = F.col("o_custkey")
    return [
        _text("proj", c % 5).alias("project"),
        _text("C", c % 20).alias("class_name"),
        _text("m", c % 200).alias("method"),
        _text("M", c).alias("mutant"),
    ]


def v_entries(spark: SparkSession, sf: str) -> DataFrame:
    p, s = F.col("o_orderpriority"), F.col("o_orderstatus")
    return table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("row_no"),
        *_order_key(),
        _text("T", F.col("o_orderkey") % 3, "_", F.col("o_custkey")).alias("test_set_name"),
        (s != "P").alias("compiled"),
        F.when(p == "1-URGENT", F.lit("OK")).when(p == "5-LOW", F.lit("")).otherwise(p).alias("mapping_status"),
        p.isin("1-URGENT", "2-HIGH").alias("original_passed"),
        (s != "P").alias("mutant_executed"),
        ((s == "F") & p.isin("1-URGENT", "2-HIGH")).alias("target_killed"),
        F.when(s == "F", F.lit("KILLED")).when(s == "O", F.lit("SURVIVED")).otherwise(F.lit("SKIP_NOT_COMPILED")).alias("target_status"),
        F.when(s == "P", p).otherwise(F.lit("")).alias("failure_reason"),
    )


def v_suites(spark: SparkSession, sf: str) -> DataFrame:
    s, o, c = F.col("o_orderstatus"), F.col("o_orderkey"), F.col("o_custkey")
    return table(spark, sf, "orders").select(
        o.alias("report_id"),
        *_order_key(),
        (s == "F").alias("killed"),
        (s == "O").alias("live"),
        F.when(s == "F", _text("T", o % 2, "_", c, "#t1, X", o % 5, F.when(o % 11 == 0, F.lit(" timeout")).otherwise(F.lit("")))).otherwise(F.lit("")).alias("tests"),
        (o % 4 == 0).alias("same_method_fallback"),
        F.when(o % 6 == 0, F.lit("")).otherwise(F.lit("OK")).alias("suite_status"),
        (o % 3).cast("int").alias("primary_runs"),
        (o % 5).cast("int").alias("fallback_runs"),
        (o % 2).cast("int").alias("timeout_runs"),
        F.floor("o_totalprice").cast("long").alias("elapsed_ms"),
    )


def v_customers(spark: SparkSession, sf: str) -> DataFrame:
    """Whitelist of index keys: customers outside one market segment."""
    return _index_keys(table(spark, sf, "customer").filter(F.col("c_mktsegment") != "MACHINERY"))


def all_customers(spark: SparkSession, sf: str) -> DataFrame:
    """Index keys of every customer."""
    return _index_keys(table(spark, sf, "customer"))


def _index_keys(customers: DataFrame) -> DataFrame:
    c = F.col("c_custkey")
    return customers.select(
        c.alias("index_row"),
        _text("proj", c % 5).alias("project"),
        _text("C", c % 20).alias("class_name"),
        _text("m", c % 200).alias("method"),
        _text("M", c).alias("mutant"),
        _text("stat/", c % 100, ".txt").alias("statistic_file"),
    )


# --- code facts --------------------------------------------------------------------
def v_methods(spark: SparkSession, sf: str) -> DataFrame:
    p = F.col("p_partkey")
    name = F.when(p % 13 == 0, F.lit("parse")).otherwise(_text("m", p % 50))
    ret = pick(["void", "int", "boolean"], F.col("p_size") % 3)
    return table(spark, sf, "part").select(
        p.alias("method_id"),
        _text(F.col("p_brand"), ".", F.col("p_type")).alias("type_id"),
        name.alias("name"),
        _text(name, "(", pick(["", "int", "int,String"], p % 3), ")").alias("signature"),
        ret.alias("return_type"),
        pick(["public", "protected", "package-private", "private"], F.col("p_size") % 4).alias("visibility"),
        (p % 5 == 0).alias("is_static"),
        (p % 17 == 0).alias("is_constructor"),
        (p % 1000).cast("int").alias("begin_line"),
        (p % 1000 + F.col("p_size")).cast("int").alias("end_line"),
    )


def v_types(spark: SparkSession, sf: str) -> DataFrame:
    """Types of all methods, with a readable name for most of them."""
    t = table(spark, sf, "part").select("p_brand", "p_type").distinct()
    return t.select(
        _text(F.col("p_brand"), ".", F.col("p_type")).alias("type_id"),
        _text("org.demo.", F.col("p_brand"), ".", F.col("p_type")).alias("qualified_name"),
    )


LINES_PER_BLOCK = 64


def v_calls(spark: SparkSession, sf: str) -> DataFrame:
    """Calls: the part at line n of an order calls the part at line n + 1."""
    order, line = F.col("l_orderkey"), F.col("l_linenumber")
    # lines of an order lie in blocks, and one that starts a block is also the last of the block before: so the table is
    # shuffled once, and a line meets the next one in its block
    block = lambda n: F.floor(n / LINES_PER_BLOCK).cast("int")
    li = table(spark, sf, "lineitem").filter(order.isNotNull() & line.isNotNull()).select(
        "l_orderkey", "l_linenumber", "l_partkey", F.explode(F.array_distinct(F.array(block(line), block(line - 1)))).alias("_block")
    )
    # several rows may share (order, line): one caller and one callee per line, as sets
    place = ["l_orderkey", "_block"]
    caller = li.repartition(*place).groupBy(*place, "l_linenumber").agg(F.min("l_partkey").alias("caller_method_id"))
    after = W.partitionBy(*place).orderBy("l_linenumber")
    met = caller.withColumns({"_next": F.lead("l_linenumber").over(after), "callee_method_id": F.lead("caller_method_id").over(after)})
    return met.filter(F.col("_next") - 1 == line).select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("call_id"),
        "caller_method_id",
        # every seventh callee stays unresolved and has its raw texts only
        F.when(F.col("callee_method_id") % 7 != 0, F.col("callee_method_id")).alias("callee_method_id"),
        F.lit("raw.Owner").alias("callee_owner"),
        F.when(F.col("callee_method_id") % 13 == 0, F.lit("parse")).otherwise(_text("m", F.col("callee_method_id") % 50)).alias("callee_method_name"),
        F.lit("raw()").alias("callee_signature"),
        F.col("l_linenumber").alias("line_number"),
    )


def v_fields(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "supplier").select(
        F.col("s_suppkey").alias("field_id"),
        _text("Brand#", F.col("s_nationkey") + 1, ".ECONOMY").alias("type_id"),
        _text("f", F.col("s_suppkey")).alias("field_name"),
        pick(["public", "private"], F.col("s_suppkey") % 2).alias("visibility"),
    )


def v_accesses(spark: SparkSession, sf: str) -> DataFrame:
    li = table(spark, sf, "lineitem")
    return li.select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("access_id"),
        F.col("l_partkey").alias("method_id"),
        F.when(F.col("l_suppkey") % 9 != 0, F.col("l_suppkey")).alias("field_id"),
        F.lit("raw.Owner").alias("owner_type"),
        _text("raw", F.col("l_suppkey")).alias("raw_field_name"),
        F.when(F.col("l_returnflag") == "R", F.lit("READ")).otherwise(F.lit("WRITE")).alias("access_kind"),
        F.col("l_linenumber").alias("line_number"),
    )


# --- SQL twins ------------------------------------------------------------------------
SQL_VIEWS = {
    "v_traj": f"""
SELECT *, project || '::' || class_name || '::' || method || '::' || operator AS mutant_id FROM (
SELECT event_id AS line_no, 'row-' || user_id AS task_id, 'run-' || (user_id % 3) AS run_id,
  'proj' || (user_id % 5) AS project, 'C' || (user_id % 20) AS class_name, 'void_m' || user_id || '()' AS method,
  {sql_pick(FAMILIES, 'user_id % 5')} || '_' || (user_id % 9 + 1) AS operator,
  CAST((user_id % 7) * 10 AS VARCHAR) AS line,
  CASE event_type WHEN 'purchase' THEN 'KILLED' WHEN 'view' THEN 'SURVIVED'
    WHEN 'error' THEN 'COMPILE_FAILED_AFTER_REPAIR' WHEN 'click' THEN 'ORIGINAL_FAILED'
    ELSE 'SKIPPED_BY_EVIDENCE' END AS target_status,
  event_type NOT IN ('error', 'signup') AS compile_success, event_type IN ('purchase', 'view') AS original_pass,
  event_type = 'purchase' AS killed, k % 10 = 9 AS timed_out, day(ts) % 3 AS outer_loop_round,
  k % 4 AS repair_rounds, k % 5 + 1 AS compile_calls, k % 3 + 1 AS llm_calls, k * 400 AS prompt_chars,
  CAST(floor(value * 100) AS BIGINT) AS elapsed_ms, ts AS generated_at,
  {sql_pick(fixed.EVIDENCE_ACTIONS, 'k % 6')} AS action, 'T' || (user_id % 40) AS test_name,
  value / 100 - 2 AS reward, 'C' || (k % 4) AS coarse_key, 'C' || (k % 4) || '|' || (user_id % 50) AS exact_key,
  CASE WHEN event_type = 'error' THEN {sql_pick(ERROR_TEXTS, f'(k + user_id) % {len(ERROR_TEXTS)}')} ELSE '' END AS failure_reason,
  {sql_pick(['RETURN_VALUE', 'FIELD_STATE', 'EXCEPTION', 'OTHER'], 'k % 4')} AS observable,
  {sql_pick(['PUBLIC', 'FACTORY', 'INDIRECT'], 'k % 3')} AS entry_kind,
  {sql_pick(['STATIC', 'INSTANCE'], 'k % 2')} AS invocation, k, user_id, event_type
FROM (SELECT *, CAST(regexp_extract(props, '"k": ([0-9]+)', 1) AS INT) AS k FROM events))""",
    "v_last": """
SELECT *, regexp_extract(operator, '^([^_]*)_', 1) AS operator_family,
  CASE WHEN target_status = 'KILLED' OR killed THEN 'KILLED'
    WHEN target_status IN ('COMPILE_FAILED_AFTER_REPAIR', 'COMPILE_FAILED_AFTER_GENERATION') THEN 'COMPILE_FAILED'
    WHEN target_status = 'SURVIVED' OR compile_success THEN 'SURVIVED' ELSE 'OTHER' END AS category,
  CASE WHEN outer_loop_round > 0 THEN outer_loop_round ELSE records END AS final_round
FROM (SELECT *, row_number() OVER (PARTITION BY mutant_id ORDER BY line_no DESC) AS rn,
    count(*) OVER (PARTITION BY mutant_id) AS records,
    bool_or(target_status LIKE 'COMPILE_FAILED%') OVER (PARTITION BY mutant_id) AS ever_compile_failed,
    sum(CASE WHEN target_status IN ('COMPILE_FAILED_AFTER_REPAIR', 'SKIPPED_BY_EVIDENCE') THEN 1 ELSE 0 END)
      OVER (PARTITION BY mutant_id) AS non_executed_records,
    sum(repair_rounds) OVER (PARTITION BY mutant_id) AS sum_repairs,
    sum(compile_calls) OVER (PARTITION BY mutant_id) AS sum_compile_calls,
    sum(llm_calls) OVER (PARTITION BY mutant_id) AS sum_llm_calls
  FROM v_traj) WHERE rn = 1""",
    "v_index": """
SELECT DISTINCT user_id AS row_no, CASE WHEN user_id % 10 = 0 THEN 'unknown' ELSE project END AS project, class_name,
  method, operator, CASE WHEN user_id % 10 <= 1 THEN '' ELSE mutant_id END AS mutant_id FROM v_traj""",
    "v_feedback": f"""
SELECT line_no AS event_id, line_no AS seq, task_id, mutant_id, run_id, action, compile_success AS compiled,
  original_pass AS original_passed, killed, target_status, failure_reason, k % 11 = 0 AS plan_exhausted,
  k % 13 <> 0 AS analysed,
  {sql_pick(['KNOWLEDGE_BASE', 'EVIDENCE_BUILDER', 'TEST_GENERATOR'], 'user_id % 3')} AS primary_fix,
  CASE WHEN k % 5 = 0 THEN 'EVIDENCE_BUILDER' ELSE 'CROSS_STAGE' END AS failure_stage,
  {sql_pick(['MISSING_IMPORT_KNOWLEDGE', 'MISSING_ENTRY_CANDIDATE', 'ASSERTION_GENERATION_WEAK', 'OTHER'], 'k % 4')} AS root_cause,
  '' AS secondary_fix, {sql_pick(['survived', 'compile_failed', 'timeout'], 'k % 3')} AS symptom,
  k % 2 = 0 AS auto_repairable, k / 100.0 AS confidence,
  list_slice(['pkg.A' || (k % 7), 'pkg.B' || (k % 3)], 1, k % 3) AS suspected_imports,
  strftime(generated_at, '%Y-%m-%d %H:%M:%S') AS created_at, user_id, k FROM v_traj""",
    "v_outcomes": f"""
SELECT class_name, method, mutant, test, run_no, original_result,
  CASE WHEN flag = 'N' THEN original_result ELSE {sql_pick(OUTCOME_TEXTS, f'(part + run_no) % {len(OUTCOME_TEXTS)}')} END AS mutant_result
FROM (SELECT 'C' || (l_orderkey % 50) AS class_name, 'm' || (l_orderkey % 500) AS method, l_orderkey AS mutant,
  l_suppkey AS test, l_linenumber AS run_no, l_partkey AS part, l_returnflag AS flag,
  CASE WHEN l_linestatus = 'O' THEN 'pass' ELSE {sql_pick(OUTCOME_TEXTS, f'l_partkey % {len(OUTCOME_TEXTS)}')} END AS original_result
  FROM lineitem)""",
    # kill flag of the runner on the outcome texts above, by text position
    "v_kills": f"""
SELECT *, CASE
    WHEN o = m THEN false
    WHEN o = 3 OR m = 3 THEN o <> 3 AND m = 3
    WHEN o = 5 OR m = 5 THEN o <> 5 AND m = 5
    WHEN o IN (4, 6) OR m IN (4, 6) THEN false
    ELSE true END AS kills
FROM (SELECT *, list_position({sql_list(OUTCOME_TEXTS)}, original_result) AS o,
  list_position({sql_list(OUTCOME_TEXTS)}, mutant_result) AS m FROM v_outcomes)""",
    "v_matrix": """
SELECT 'C' || (l_orderkey % 50) AS class_name, l_orderkey AS mutant, l_suppkey AS test, l_returnflag = 'R' AS kills FROM lineitem""",
    "v_mutants": """
SELECT o_orderkey AS mutant, 'C' || (o_orderkey % 50) AS class_name, o_orderstatus = 'P' AS equivalent FROM orders""",
    "v_entries": """
SELECT o_orderkey AS row_no, 'proj' || (o_custkey % 5) AS project, 'C' || (o_custkey % 20) AS class_name,
  'm' || (o_custkey % 200) AS method, 'M' || o_custkey AS mutant,
  'T' || (o_orderkey % 3) || '_' || o_custkey AS test_set_name, o_orderstatus <> 'P' AS compiled,
  CASE o_orderpriority WHEN '1-URGENT' THEN 'OK' WHEN '5-LOW' THEN '' ELSE o_orderpriority END AS mapping_status,
  o_orderpriority IN ('1-URGENT', '2-HIGH') AS original_passed, o_orderstatus <> 'P' AS mutant_executed,
  o_orderstatus = 'F' AND o_orderpriority IN ('1-URGENT', '2-HIGH') AS target_killed,
  CASE o_orderstatus WHEN 'F' THEN 'KILLED' WHEN 'O' THEN 'SURVIVED' ELSE 'SKIP_NOT_COMPILED' END AS target_status,
  CASE WHEN o_orderstatus = 'P' THEN o_orderpriority ELSE '' END AS failure_reason FROM orders""",
    "v_suites": """
SELECT o_orderkey AS report_id, 'proj' || (o_custkey % 5) AS project, 'C' || (o_custkey % 20) AS class_name,
  'm' || (o_custkey % 200) AS method, 'M' || o_custkey AS mutant, o_orderstatus = 'F' AS killed,
  o_orderstatus = 'O' AS live,
  CASE WHEN o_orderstatus = 'F' THEN 'T' || (o_orderkey % 2) || '_' || o_custkey || '#t1, X' || (o_orderkey % 5)
    || CASE WHEN o_orderkey % 11 = 0 THEN ' timeout' ELSE '' END ELSE '' END AS tests,
  o_orderkey % 4 = 0 AS same_method_fallback, CASE WHEN o_orderkey % 6 = 0 THEN '' ELSE 'OK' END AS suite_status,
  o_orderkey % 3 AS primary_runs, o_orderkey % 5 AS fallback_runs, o_orderkey % 2 AS timeout_runs,
  CAST(floor(o_totalprice) AS BIGINT) AS elapsed_ms FROM orders""",
    "v_customers": """
SELECT c_custkey AS index_row, 'proj' || (c_custkey % 5) AS project, 'C' || (c_custkey % 20) AS class_name,
  'm' || (c_custkey % 200) AS method, 'M' || c_custkey AS mutant, 'stat/' || (c_custkey % 100) || '.txt' AS statistic_file
FROM customer WHERE c_mktsegment <> 'MACHINERY'""",
    "v_methods": f"""
SELECT method_id, type_id, name, name || '(' || {sql_pick(['', 'int', 'int,String'], 'method_id % 3')} || ')' AS signature,
  return_type, visibility, method_id % 5 = 0 AS is_static, method_id % 17 = 0 AS is_constructor,
  method_id % 1000 AS begin_line, method_id % 1000 + p_size AS end_line
FROM (SELECT p_partkey AS method_id, p_brand || '.' || p_type AS type_id, p_size,
  CASE WHEN p_partkey % 13 = 0 THEN 'parse' ELSE 'm' || (p_partkey % 50) END AS name,
  {sql_pick(['void', 'int', 'boolean'], 'p_size % 3')} AS return_type,
  {sql_pick(['public', 'protected', 'package-private', 'private'], 'p_size % 4')} AS visibility FROM part)""",
    "v_types": """
SELECT DISTINCT p_brand || '.' || p_type AS type_id, 'org.demo.' || p_brand || '.' || p_type AS qualified_name FROM part""",
    "v_calls": """
SELECT a.l_orderkey * 10 + a.l_linenumber AS call_id, a.p AS caller_method_id,
  CASE WHEN b.p % 7 <> 0 THEN b.p END AS callee_method_id, 'raw.Owner' AS callee_owner,
  CASE WHEN b.p % 13 = 0 THEN 'parse' ELSE 'm' || (b.p % 50) END AS callee_method_name, 'raw()' AS callee_signature,
  a.l_linenumber AS line_number
FROM (SELECT l_orderkey, l_linenumber, min(l_partkey) AS p FROM lineitem GROUP BY 1, 2) a
JOIN (SELECT l_orderkey, l_linenumber, min(l_partkey) AS p FROM lineitem GROUP BY 1, 2) b
  ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1""",
    "v_fields": f"""
SELECT s_suppkey AS field_id, 'Brand#' || (s_nationkey + 1) || '.ECONOMY' AS type_id, 'f' || s_suppkey AS field_name,
  {sql_pick(['public', 'private'], 's_suppkey % 2')} AS visibility FROM supplier""",
    "v_accesses": """
SELECT l_orderkey * 10 + l_linenumber AS access_id, l_partkey AS method_id,
  CASE WHEN l_suppkey % 9 <> 0 THEN l_suppkey END AS field_id, 'raw.Owner' AS owner_type,
  'raw' || l_suppkey AS raw_field_name, CASE WHEN l_returnflag = 'R' THEN 'READ' ELSE 'WRITE' END AS access_kind,
  l_linenumber AS line_number FROM lineitem""",
    # methods of the anchor's type that touch one of its fields
    "v_readers": """
SELECT DISTINCT a.method_id AS anchor_id, f.field_id, f.field_name, m.method_id, m.signature, m.visibility,
  m.return_type, m.begin_line, x.access_kind
FROM v_methods a JOIN (SELECT DISTINCT method_id, field_id FROM v_accesses) own ON own.method_id = a.method_id
JOIN v_fields f ON f.field_id = own.field_id JOIN v_accesses x ON x.field_id = f.field_id
JOIN v_methods m ON m.method_id = x.method_id AND m.type_id = a.type_id
WHERE m.method_id <> a.method_id AND m.visibility <> 'private'""",
    "v_observers": """
SELECT *, CASE visibility WHEN 'public' THEN 100.0 WHEN 'protected' THEN 70.0 WHEN 'package-private' THEN 50.0 ELSE 10.0 END
  + CASE WHEN access_kind = 'READ' THEN 80.0 ELSE 35.0 END + CASE WHEN return_type <> 'void' THEN 20.0 ELSE 0.0 END AS priority,
  CASE WHEN return_type <> 'void' THEN 'DIRECT_RETURN' WHEN access_kind = 'READ' THEN 'INDIRECT_RETURN' ELSE 'STATE_EFFECT' END AS observer_kind
FROM v_readers""",
    "v_edges": """
SELECT DISTINCT c.caller_method_id AS caller, c.callee_method_id AS callee, a.type_id
FROM v_calls c JOIN v_methods a ON a.method_id = c.caller_method_id
JOIN v_methods b ON b.method_id = c.callee_method_id AND b.type_id = a.type_id""",
}
# helpers of single queries
SQL_VIEWS["r"] = "SELECT coarse_key, exact_key, action, elapsed_ms AS cents FROM v_traj"
SQL_VIEWS["lin_log"] = f"""
SELECT {sql_pick(fixed.EVIDENCE_ACTIONS, 'label % 6')} AS action, CAST(embedding AS DOUBLE[]) AS x, CAST(vec_id % 10 - 4 AS DOUBLE) AS reward,
  1.0 / sqrt(CAST(vec_id % 9 + 1 AS DOUBLE)) AS w FROM embeddings WHERE vec_id % 7 <> 0 AND vec_id % 11 <> 0"""
SQL_VIEWS["blocks"] = """
SELECT l_orderkey, l_linenumber, bool_or(l_returnflag = 'R') AS is_if, bool_or(l_linestatus = 'O') AS is_mark FROM lineitem GROUP BY 1, 2"""
SQL_VIEWS["succs"] = "SELECT l_orderkey, l_linenumber AS block, unnest([l_linenumber + 1, l_linenumber + 2]) AS succ FROM blocks"
SQL_VIEWS["docs"] = "SELECT doc_id, list_transform(string_split(text, chr(10)), lambda x: length(x)) AS lens FROM documents"
SQL_VIEWS["base"] = f"""
SELECT class_name, test, list_position({sql_list(OUTCOME_TEXTS)}, min(original_result)) AS o FROM v_outcomes GROUP BY ALL"""
SQL_VIEWS["m"] = "SELECT 'C' || (c_custkey % 20) AS class_name, 'm' || (c_custkey % 200) AS method, 'M' || c_custkey AS mutant FROM customer"
SQL_VIEWS["t"] = """
SELECT class_name, method, mutant, test_set_name, test_no, row_number() OVER (PARTITION BY class_name, mutant ORDER BY test_no) = 1 AS first_row
FROM (SELECT class_name, method, mutant, test_set_name, min(row_no) AS test_no FROM v_entries GROUP BY ALL)"""
SQL_VIEWS["sets"] = """
SELECT o_custkey AS set_id, list_sort(list(DISTINCT o_orderstatus || '-' || o_orderpriority)) AS tests FROM orders GROUP BY 1"""
SQL_VIEWS["v_distances"] = """
SELECT anchor_id, method_id, min(distance) AS distance FROM (
  SELECT method_id AS anchor_id, method_id, 0 AS distance FROM v_methods
""" + "".join(
    f"""  UNION ALL SELECT DISTINCT {'e1.callee'} AS anchor_id, e{n}.caller AS method_id, {n} AS distance FROM v_edges e1
    {' '.join(f'JOIN v_edges e{i} ON e{i}.callee = e{i - 1}.caller' for i in range(2, n + 1))}
"""
    for n in range(1, 7)
) + ") GROUP BY 1, 2"
