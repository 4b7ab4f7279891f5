"""History, bandit statistics, graph pieces, evidence and caches."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.attribution import Targets
from ..operators import bandit as bd
from ..operators import bicliques as bc
from ..operators import evidence as ev
from ..operators import graph as gr
from ..operators import history as hs
from ..operators.summaries import feedback_counts
from . import views as v
from .registry import query
from .views import table

#: Length of the vectors of the embeddings table.
DIM = 64
LAST_LINE = 7  # highest line number of an order


@query(
    "J30_prior_states",
    """
SELECT DISTINCT t.mutant_id, t.outer_loop_round AS round, p.line_no IS NOT NULL AS has_previous, p.line_no AS previous_line_no, p.target_status AS previous_target_status
FROM (SELECT DISTINCT mutant_id, outer_loop_round FROM v_traj) t LEFT JOIN v_traj p ON p.line_no = (SELECT max(h.line_no) FROM v_traj h
  WHERE h.mutant_id = t.mutant_id AND (t.outer_loop_round = 0 OR h.outer_loop_round = 0 OR h.outer_loop_round < t.outer_loop_round))""",
    ("v_traj",),
)
def prior_states(spark, sf):
    return hs.prior_states(v.v_traj(spark, sf), ["target_status"])


def _history(spark, sf):
    return hs.eligible_history(v.v_traj(spark, sf), 2)


def _targets(spark, sf):
    t = v.v_traj(spark, sf)
    return t.groupBy("mutant_id").agg(F.max_by(F.struct(*[c for c in ("project", "class_name", "method", "line", *hs.TRAITS)]), "line_no").alias("r")).select("mutant_id", "r.*")


_HIST = """SELECT * FROM (SELECT *, compile_success AND original_pass AND killed AS won, row_number() OVER (PARTITION BY mutant_id ORDER BY line_no DESC) AS rn
  FROM v_traj WHERE outer_loop_round < 2) WHERE rn = 1"""


@query(
    "J31_A28_shared_experience",
    f"""
SELECT t.mutant_id, count(h.mutant_id) AS same_class_processed, count(CASE WHEN h.compile_success THEN 1 END) AS same_class_compiled, count(CASE WHEN h.won THEN 1 END) AS same_class_killed,
  round(coalesce(count(CASE WHEN h.won THEN 1 END) / nullif(count(h.mutant_id), 0), 0), 6) AS same_class_killed_rate,
  count(CASE WHEN h.method = t.method THEN 1 END) AS same_method_processed, count(CASE WHEN h.method = t.method AND h.line = t.line THEN 1 END) AS same_site_processed
FROM (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY mutant_id ORDER BY line_no DESC) AS rn FROM v_traj) WHERE rn = 1) t
LEFT JOIN ({_HIST}) h ON h.project = t.project AND h.class_name = t.class_name AND h.mutant_id <> t.mutant_id GROUP BY 1""",
    ("v_traj",),
)
def shared_experience(spark, sf):
    e = hs.shared_experience(_targets(spark, sf), _history(spark, sf))
    return e.select(
        "mutant_id", *[F.col(c).cast("long").alias(c) for c in ("same_class_processed", "same_class_compiled", "same_class_killed", "same_method_processed", "same_site_processed")],
        F.round("same_class_killed_rate", 6).alias("same_class_killed_rate"),
    )


def _many(spark, sf):
    """A denser history: classes, methods and sites that many mutants share."""
    t = v.v_traj(spark, sf)
    kind = F.col("line_no")
    return t.select(
        F.concat(F.lit("M"), kind.cast("string")).alias("mutant_id"), F.lit("p").alias("project"), F.concat(F.lit("C"), (kind % 40).cast("string")).alias("class_name"),
        F.concat(F.lit("m"), (kind % 120).cast("string")).alias("method"), F.concat(F.lit(""), (kind % 3 * 10).cast("string")).alias("line"),
        "operator", "observable", "entry_kind", "invocation", F.lit(True).alias("compile_success"), F.lit(True).alias("original_pass"), "killed",
        F.round("reward", 2).alias("reward"), F.concat(F.lit("T"), (kind % 500).cast("string")).alias("test_name"), F.lit(True).alias("has_test_text"),
    )


_MANY_SQL = """SELECT 'M' || line_no AS mutant_id, 'C' || (line_no % 40) AS class_name, 'm' || (line_no % 120) AS method, CAST(line_no % 3 * 10 AS VARCHAR) AS line,
  operator, observable, entry_kind, invocation, killed, round(reward, 2) AS reward, 'T' || (line_no % 500) AS test_name FROM v_traj"""


@query(
    "F47_W9_similar_references",
    f"""
WITH many AS ({_MANY_SQL}), scored AS (SELECT t.mutant_id, r.mutant_id AS ref_id, r.test_name, r.reward,
  CASE WHEN r.method = t.method AND r.line = t.line THEN 100.0::DOUBLE WHEN r.method = t.method THEN 50.0 ELSE 10.0 END
  + CASE WHEN split_part(r.operator, '_', 1) = split_part(t.operator, '_', 1) THEN 8.0 ELSE 0.0 END + CASE WHEN r.operator = t.operator THEN 4.0 ELSE 0.0 END
  + CASE WHEN r.observable = t.observable THEN 5.0 ELSE 0.0 END + CASE WHEN r.entry_kind = t.entry_kind THEN 2.0 ELSE 0.0 END
  + CASE WHEN r.invocation = t.invocation THEN 2.0 ELSE 0.0 END + least(5.0, greatest(0.0, r.reward)) AS similarity
  FROM many t JOIN many r ON r.class_name = t.class_name AND r.killed AND r.mutant_id <> t.mutant_id),
unique_names AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY mutant_id, test_name ORDER BY similarity DESC, reward DESC, ref_id) AS d FROM scored) WHERE d = 1)
SELECT mutant_id, reference_rank, ref_id, round(similarity, 6) AS similarity FROM (SELECT *, row_number() OVER (PARTITION BY mutant_id ORDER BY similarity DESC, reward DESC, ref_id) AS reference_rank FROM unique_names) WHERE reference_rank <= 3""",
    ("v_traj",),
)
def similar_references(spark, sf):
    many = _many(spark, sf)
    return hs.similar_references(many, many, 3).select("mutant_id", "reference_rank", "ref_id", F.round("similarity", 6).alias("similarity"))


@query(
    "A26_action_statistics",
    """
SELECT 'global' AS level, '' AS bucket, action, count(*) AS samples, round(avg(sqrt(elapsed_ms + 1)), 6) AS mean_reward FROM v_traj GROUP BY action
UNION ALL SELECT 'coarse', coarse_key, action, count(*), round(avg(sqrt(elapsed_ms + 1)), 6) FROM v_traj GROUP BY coarse_key, action
UNION ALL SELECT 'exact', exact_key, action, count(*), round(avg(sqrt(elapsed_ms + 1)), 6) FROM v_traj GROUP BY exact_key, action""",
    ("v_traj",),
)
def action_statistics(spark, sf):
    t = v.v_traj(spark, sf).withColumn("reward", F.sqrt(F.col("elapsed_ms") + 1))
    return bd.action_statistics(t).withColumn("mean_reward", F.round("mean_reward", 6))


_ORD = f"list_position({v.sql_list(fixed.EVIDENCE_ACTIONS)}, action)"


@query(
    "G7_chosen_actions",
    f"""
WITH s AS (SELECT level, key, sum(n) AS n, arg_max(action, (round(m, 9), -{_ORD})) AS best FROM (
  SELECT 'g' AS level, '' AS key, action, count(*) AS n, avg(cents) AS m FROM r GROUP BY ALL UNION ALL SELECT 'c', coarse_key, action, count(*), avg(cents) FROM r GROUP BY ALL
  UNION ALL SELECT 'e', exact_key, action, count(*), avg(cents) FROM r GROUP BY ALL) GROUP BY level, key)
SELECT context_id, CASE WHEN e.n >= 40 THEN 'EXACT' WHEN c.n >= 2000 THEN 'COARSE' ELSE 'GLOBAL' END AS level,
  CASE WHEN e.n >= 40 THEN e.best WHEN c.n >= 2000 THEN c.best ELSE (SELECT best FROM s WHERE level = 'g') END AS action
FROM (SELECT line_no AS context_id, coarse_key, exact_key FROM v_traj) LEFT JOIN s e ON e.level = 'e' AND e.key = exact_key LEFT JOIN s c ON c.level = 'c' AND c.key = coarse_key""",
    ("v_traj", "r"),
)
def chosen_actions(spark, sf):
    """Rewards in whole cents, so both engines average exactly."""
    t = v.v_traj(spark, sf).withColumn("reward", F.floor(F.col("elapsed_ms")))
    contexts = t.select(F.col("line_no").alias("context_id"), "coarse_key", "exact_key")
    return bd.choose_actions(contexts, bd.action_statistics(t), 40, 2000).select("context_id", "level", "action")


@query(
    "G8_exploration",
    f"""
SELECT line_no AS context_id, u < 0.2::DOUBLE AS explored, CASE WHEN u < 0.2::DOUBLE THEN list_extract({v.sql_list(fixed.EVIDENCE_ACTIONS)}, CAST(floor(w * 6) AS INT) + 1) ELSE 'greedy' END AS action
FROM (SELECT line_no, ('0x' || substr(md5('explore:' || line_no), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u, ('0x' || substr(md5('explore-action:' || line_no), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS w FROM v_traj)""",
    ("v_traj",),
)
def exploration(spark, sf):
    t = v.v_traj(spark, sf)
    contexts = t.select(F.col("line_no").alias("context_id"), "coarse_key", "exact_key")
    c = bd.choose_actions(contexts, bd.action_statistics(t), epsilon=0.2)
    return c.select("context_id", "explored", F.when(F.col("explored"), F.col("action")).otherwise(F.lit("greedy")).alias("action"))


def _linear_log(spark, sf):
    return linear_rows(table(spark, sf, "embeddings"))


def linear_rows(e):
    n = F.col("vec_id")
    return e.select(
        v.pick(fixed.EVIDENCE_ACTIONS, F.col("label") % 6).alias("action"), F.col("embedding").cast("array<double>").alias("x"),
        (n % 10 - 4).cast("double").alias("reward"), (1.0 / F.sqrt((n % 9 + 1).cast("double"))).alias("weight"), n.alias("context_id"),
        (n % 7 != 0).alias("visible_code"), (n % 11 == 0).alias("skipped"), F.lit(False).alias("scaffold"),
    )


LINEAR_SQL = """
SELECT action, 'A' AS part, CAST(i AS INT) AS row, CAST(j AS INT) AS col, round(sum(w * xi * xj) + CASE WHEN i = j THEN 1.0 ELSE 0.0 END, 6) AS value FROM lin_log, range(64) r1(i), range(64) r2(j),
  LATERAL (SELECT x[i + 1] AS xi, x[j + 1] AS xj) GROUP BY action, i, j
UNION ALL SELECT action, 'b', CAST(i AS INT), 0, round(sum(w * reward * x[i + 1]), 6) FROM lin_log, range(64) r1(i) GROUP BY action, i"""


@query("A27_linear_statistics", LINEAR_SQL, ("lin_log",))
def linear_statistics(spark, sf):
    s = bd.linear_statistics(bd.policy_rows(_linear_log(spark, sf)), DIM)
    return s.withColumn("value", F.round("value", 6))


@query(
    "G9_G10_linear_scores",
    f"""
WITH RECURSIVE cells AS (
  SELECT action, i, j, sum(w * x[i + 1] * x[j + 1]) + CASE WHEN i = j THEN 1.0 ELSE 0.0 END AS value FROM lin_log, range({DIM}) r1(i), range({DIM}) r2(j) GROUP BY action, i, j
), matrices AS (
  SELECT action, list(numbers ORDER BY i) AS m FROM (SELECT action, i, list(value ORDER BY j) AS numbers FROM cells GROUP BY ALL) GROUP BY ALL
), vectors AS (
  SELECT action, list(value ORDER BY i) AS b FROM (SELECT action, i, sum(w * reward * x[i + 1]) AS value FROM lin_log, range({DIM}) r1(i) GROUP BY ALL) GROUP BY ALL
), pivots AS (
  SELECT action, 1 AS k, m FROM matrices
  UNION ALL SELECT action, k + 1, list_transform(m, lambda r, i: CASE WHEN i = k THEN list_transform(r, lambda y, j: CASE WHEN j = k THEN 1.0 / m[k][k] ELSE y / m[k][k] END)
    ELSE list_transform(r, lambda y, j: CASE WHEN j = k THEN -r[k] / m[k][k] ELSE y - r[k] * m[k][j] / m[k][k] END) END) FROM pivots WHERE k <= {DIM}
), models AS (
  SELECT action, m AS inverse, list_transform(m, lambda r: list_dot_product(r, b)) AS theta FROM pivots JOIN vectors USING (action) WHERE k = {DIM} + 1
), actions AS (
  SELECT unnest({v.sql_list(fixed.EVIDENCE_ACTIONS)}) AS action, unnest(range({len(fixed.EVIDENCE_ACTIONS)})) AS place
), scores AS (
  SELECT vec_id AS context_id, action, place, coalesce(list_dot_product(x, theta), 0.0)
    + 0.5 * sqrt(CASE WHEN inverse IS NULL THEN list_dot_product(x, x) ELSE list_dot_product(x, list_transform(inverse, lambda r: list_dot_product(r, x))) END) AS score
  FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings), actions LEFT JOIN models USING (action)
)
SELECT context_id, action, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY context_id ORDER BY score DESC, place) AS rn FROM scores) WHERE rn = 1""",
    ("lin_log",),
)
def linear_scores(spark, sf):
    log = _linear_log(spark, sf)
    models = bd.model_table(bd.linear_statistics(bd.policy_rows(log), DIM), "SIX_CLASS", DIM)
    usable = bd.compatible_models(models, "SIX_CLASS", DIM)
    return bd.linear_scores(log, usable, DIM).withColumn("score", F.round("score", 6))


# --- feedback -----------------------------------------------------------------------
_ALIVE = "compiled AND original_passed AND NOT killed"


@query(
    "A30_F44_feedback_counts",
    f"""
SELECT run_id, count(*) AS events, count_if(kb) AS knowledge_events, count_if(kb AND strong) AS actionable_knowledge,
  count_if(kb AND strong AND root_cause = 'MISSING_IMPORT_KNOWLEDGE' AND len(suspected_imports) > 0) AS actionable_imports,
  count_if(kb AND strong AND root_cause = 'MISSING_ENTRY_CANDIDATE') AS actionable_other,
  count_if(analysed AND NOT kb AND evd) AS evidence_events, count_if(analysed AND NOT kb AND NOT evd AND primary_fix = 'TEST_GENERATOR') AS generator_events,
  count_if(analysed AND NOT kb AND NOT evd AND primary_fix <> 'TEST_GENERATOR') AS other_events,
  count_if(NOT compiled AND (target_status = 'COMPILE_FAILED_AFTER_REPAIR' OR symptom = 'compile_failed')) AS retryable,
  count_if(CASE WHEN analysed THEN (NOT plan_exhausted OR kb OR evd) AND {_ALIVE} AND (root_cause IN ('ASSERTION_GENERATION_WEAK', 'MISSING_ENTRY_CANDIDATE')
    OR ((evd OR primary_fix = 'TEST_GENERATOR') AND (confidence >= 0.6::DOUBLE OR auto_repairable))) ELSE {_ALIVE} AND NOT plan_exhausted END) AS actionable_kills
FROM (SELECT *, analysed AND primary_fix = 'KNOWLEDGE_BASE' AS kb, primary_fix = 'EVIDENCE_BUILDER' OR failure_stage = 'EVIDENCE_BUILDER' AS evd,
  auto_repairable AND confidence >= 0.3::DOUBLE AS strong FROM v_feedback) GROUP BY 1""",
    ("v_traj", "v_feedback"),
)
def feedback_event_counts(spark, sf):
    return feedback_counts(v.v_feedback(table(spark, sf, "events"), Targets()), 0.3, by=["run_id"])


@query(
    "W22_prioritized_rows",
    """
SELECT mutant_id, min(tier) AS tier FROM (SELECT mutant_id, 0 AS tier FROM v_traj WHERE killed AND k > 90 UNION ALL SELECT mutant_id, 1 FROM v_traj WHERE target_status = 'SURVIVED' AND k > 80
UNION ALL SELECT mutant_id, 2 FROM v_traj) GROUP BY 1""",
    ("v_traj",),
)
def prioritized_rows(spark, sf):
    t = v.v_traj(spark, sf)
    return ev.prioritized_rows([t.filter("killed AND k > 90"), t.filter("target_status = 'SURVIVED' AND k > 80"), t], "mutant_id")


# --- graph ----------------------------------------------------------------------------
@query(
    "G3_control_dependence",
    """
SELECT l_orderkey AS method, block, mark, 'If(q' || block || ') @' || block AS dependence FROM (
  SELECT b.l_orderkey, b.l_linenumber AS block, m.l_linenumber AS mark, bool_or(pd) AS some_pd, bool_and(pd) AS all_pd
  FROM blocks b JOIN blocks m ON m.l_orderkey = b.l_orderkey AND m.is_mark JOIN succs s ON s.l_orderkey = b.l_orderkey AND s.block = b.l_linenumber,
    LATERAL (SELECT s.succ <= m.l_linenumber AND (s.succ + m.l_linenumber) % 2 = 0 AS pd) WHERE b.is_if GROUP BY ALL) WHERE some_pd AND NOT all_pd""",
    ("blocks", "succs"),
)
def control_dependence(spark, sf):
    """Blocks: lines of an order; successors: the next two lines; dominance by line parity."""
    lines = table(spark, sf, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(
        F.max(F.col("l_returnflag") == "R").alias("is_if"), F.max(F.col("l_linestatus") == "O").alias("is_mark")
    )
    n = F.col("l_linenumber")
    blocks = lines.select(F.col("l_orderkey").alias("method"), n.alias("block"), F.col("is_if").alias("tail_is_if"), F.concat(F.lit("q"), n.cast("string")).alias("cond"), n.alias("line"))
    successors = blocks.select("method", "block", F.explode(F.array(F.col("block") + 1, F.col("block") + 2)).alias("succ"))
    marks = lines.filter("is_mark").select(F.col("l_orderkey").alias("method"), n.alias("node"))
    last = F.greatest(F.col("succ"), F.lit(LAST_LINE))
    # every second line behind a successor dominates it
    postdom = successors.select("method", F.col("succ").alias("node"), F.explode(F.sequence("succ", last, F.lit(2))).alias("dominator"))
    return gr.control_dependence(blocks, successors, postdom, marks).select("method", "block", "mark", "dependence")


@query(
    "J32_def_use_edges",
    """
SELECT DISTINCT d.l_orderkey AS method, d.l_suppkey AS variable, d.l_linenumber AS def_stmt, u.l_linenumber AS use_stmt FROM lineitem d JOIN lineitem u
ON u.l_orderkey = d.l_orderkey AND u.l_suppkey = d.l_suppkey WHERE d.l_returnflag <> 'N' AND u.l_returnflag <> 'A'""",
)
def def_use_edges(spark, sf):
    li = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("method"), F.col("l_suppkey").alias("variable"), F.col("l_linenumber").alias("stmt"), "l_returnflag")
    defs = li.filter("l_returnflag <> 'N'").withColumn("kind", F.lit("def"))
    uses = li.filter("l_returnflag <> 'A'").withColumn("kind", F.lit("use"))
    return gr.def_use_edges(defs.unionByName(uses))


def _def_use(spark, sf):
    li = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("method"), F.col("l_suppkey").alias("variable"), F.col("l_linenumber").alias("stmt"), "l_returnflag")
    defs = li.filter("l_returnflag <> 'N'").withColumn("kind", F.lit("def"))
    return defs.unionByName(li.filter("l_returnflag <> 'A'").withColumn("kind", F.lit("use")))


@query(
    "J32_def_use_sides",
    """
SELECT method, variable, side, stmt FROM (SELECT *, count(DISTINCT side) OVER (PARTITION BY method, variable) AS two FROM (
  SELECT DISTINCT l_orderkey AS method, l_suppkey AS variable, 'LEFT' AS side, l_linenumber AS stmt FROM lineitem WHERE l_returnflag <> 'N'
  UNION SELECT l_orderkey, l_suppkey, 'RIGHT', l_linenumber FROM lineitem WHERE l_returnflag <> 'A')) WHERE two = 2""",
)
def def_use_sides(spark, sf):
    """Definitions and uses of each variable that has both: the edges in linear size."""
    return bc.definitions_and_uses(_def_use(spark, sf))


@query(
    "J32_unfolded_edges",
    """
SELECT DISTINCT d.l_orderkey AS method, d.l_suppkey AS variable, d.l_linenumber AS def_stmt, u.l_linenumber AS use_stmt FROM lineitem d JOIN lineitem u
ON u.l_orderkey = d.l_orderkey AND u.l_suppkey = d.l_suppkey JOIN orders ON o_orderkey = d.l_orderkey AND o_orderstatus = 'F' WHERE d.l_returnflag <> 'N' AND u.l_returnflag <> 'A'""",
)
def unfolded_edges(spark, sf):
    """Edges of the methods that are asked for."""
    asked = table(spark, sf, "orders").filter("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("method"))
    return bc.def_use_pairs(bc.definitions_and_uses(_def_use(spark, sf)), asked)


@query(
    "J33_signature_agreement",
    f"""
SELECT group_id, CASE WHEN exact_methods = 0 AND c = 0 THEN 'NOT_VERIFIED_NO_EXACT_SIGNATURES' WHEN n + c = 0 THEN 'VERIFIED_STRICT' ELSE 'FAILED' END AS status, exact_methods, public_methods, setup_methods,
  CASE WHEN exact_methods = 0 AND c = 0 THEN 0 ELSE n + c END AS errors FROM (SELECT group_id, count(e) AS exact_methods, count(p) AS public_methods, count(s) AS setup_methods,
  sum(CASE WHEN e2 <> e THEN 1 ELSE 0 END + CASE WHEN p2 <> p THEN 1 ELSE 0 END + CASE WHEN s2 <> s THEN 1 ELSE 0 END) AS c,
  sum(CASE WHEN e IS NOT NULL AND p IS NULL THEN 1 ELSE 0 END + CASE WHEN e <> p THEN 1 ELSE 0 END + CASE WHEN s IS NOT NULL AND p IS NULL THEN 1 ELSE 0 END
    + CASE WHEN s <> p THEN 1 ELSE 0 END + CASE WHEN s <> e THEN 1 ELSE 0 END) AS n
FROM (SELECT p_brand || '.' || p_type AS group_id, p_name AS key, max(ret) FILTER (kind = 0) AS e, max(ret) FILTER (kind = 1) AS p, max(ret) FILTER (kind = 2) AS s,
    min(ret) FILTER (kind = 0) AS e2, min(ret) FILTER (kind = 1) AS p2, min(ret) FILTER (kind = 2) AS s2
  FROM (SELECT *, {v.sql_pick(['void', 'int', 'long'], 'p_size % 3')} AS ret, unnest(CASE p_partkey % 4 WHEN 0 THEN [0, 1] WHEN 1 THEN [1] WHEN 2 THEN [0, 1, 2] ELSE [2] END) AS kind FROM part) GROUP BY ALL) GROUP BY 1)""",
)
def signature_agreement(spark, sf):
    p = F.col("p_partkey") % 4
    kinds = F.when(p == 0, F.array(F.lit("exact"), F.lit("public"))).when(p == 1, F.array(F.lit("public"))).when(
        p == 2, F.array(F.lit("exact"), F.lit("public"), F.lit("setup"))
    ).otherwise(F.array(F.lit("setup")))
    ret = v.pick(["void", "int", "long"], F.col("p_size") % 3)
    raw = F.concat(ret, F.lit(" "), F.regexp_replace("p_name", " ", "_"), F.lit("(java.util.List<String> a)"))
    rows = table(spark, sf, "part").select(F.concat("p_brand", F.lit("."), "p_type").alias("group_id"), F.explode(kinds).alias("list_kind"), raw.alias("raw"))
    out = gr.signature_agreement(rows)
    return out.withColumn("errors", F.size("errors").cast("long"))


@query(
    "M2_predicate_difference",
    """
SELECT key, side, count(*) AS predicates FROM (SELECT o_custkey AS key, o_orderpriority AS p, CASE WHEN bool_and(o_orderstatus <> 'F') THEN 'MUTANT_ONLY' WHEN bool_and(o_orderstatus = 'F') THEN 'ORIGINAL_ONLY' END AS side
FROM orders GROUP BY 1, 2) WHERE side IS NOT NULL GROUP BY ALL""",
)
def predicate_difference(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("key"), F.col("o_orderpriority").alias("predicate"), "o_orderstatus")
    d = gr.predicate_difference(o.filter("o_orderstatus = 'F'"), o.filter("o_orderstatus <> 'F'"), "key", "predicate")
    return d.groupBy("key", "side").agg(F.count(F.lit(1)).alias("predicates"))


@query(
    "M2_changed_keys",
    """
SELECT key, original_size, mutant_size, differing > 0 AS set_changed, original_size <> mutant_size AS size_changed FROM (SELECT key, count_if(o) AS original_size, count_if(m) AS mutant_size, count_if(o <> m) AS differing FROM (
  SELECT o_custkey AS key, o_orderpriority, bool_or(o_orderstatus = 'F') AS o, bool_or(o_orderstatus <> 'F') AS m FROM orders GROUP BY 1, 2) GROUP BY 1)""",
)
def changed_keys(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("key"), F.col("o_orderpriority").alias("predicate"), "o_orderstatus")
    return gr.changed_keys(o.filter("o_orderstatus = 'F'"), o.filter("o_orderstatus <> 'F'"), "key", "predicate")


# --- evidence --------------------------------------------------------------------------
def _sections(spark, sf):
    """Sections of a prompt: the lines of a document, the first one required."""
    lines = F.split("text", "\n")
    return table(spark, sf, "documents").select(
        "doc_id",
        F.transform(
            lines,
            lambda x, i: F.struct((i + 1).alias("section_no"), F.length(x).alias("length"), (i == 0).alias("required"), (F.lit(1.0) / (i + 1)).alias("keep_ratio")),
        ).alias("sections"),
    )


@query(
    "W23_budgeted_sections",
    """
WITH RECURSIVE fold(doc_id, lens, n, pos, len_, kept, room) AS (
  SELECT doc_id, lens, len(lens), 1, lens[1], least(lens[1], 3000), 3000 - least(lens[1], 3000) FROM docs
  UNION ALL SELECT doc_id, lens, n, pos + 1, lens[pos + 1], kept, room - kept FROM (SELECT *, CASE WHEN lens[pos + 1] <= room THEN lens[pos + 1]
    ELSE least(room, greatest(512, CAST(floor(room * (1.0::DOUBLE / (pos + 1))) AS BIGINT))) END AS kept FROM (SELECT doc_id, lens, n, pos, room FROM fold) WHERE pos < n))
SELECT doc_id, pos AS section_no, len_ AS length, kept, kept < len_ AS truncated FROM fold""",
    ("docs",),
)
def budgeted_sections(spark, sf):
    return ev.budgeted_sections(_sections(spark, sf), "sections", 3000)


def _action():
    """An evidence action by order; two of eight orders have an unknown one or none."""
    k = F.col("l_orderkey") % 8
    return F.when(k < 6, v.pick(fixed.EVIDENCE_ACTIONS, k)).when(k == 6, "OTHER")


@query(
    "W24_evidence_profiles",
    """
SELECT action, kind, count(*) AS kept, CAST(sum(item) AS BIGINT) AS items FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, kind ORDER BY item) AS rn FROM (SELECT l_orderkey, l_partkey * 10 + l_linenumber AS item,
  CASE WHEN l_orderkey % 8 < 6 THEN list_extract(ACTIONS, CAST(l_orderkey % 8 AS INT) + 1) WHEN l_orderkey % 8 = 6 THEN 'OTHER' END AS action,
  list_extract(['entry', 'method', 'field', 'graph'], CAST(l_suppkey % 4 AS INT) + 1) AS kind FROM lineitem))
LEFT JOIN (SELECT unnest(ACTIONS) AS action, unnest([[-1,-1,-1,-1],[2,4,4,4],[3,3,2,3],[1,2,2,0],[2,3,3,0],[1,2,2,0]]) AS lim) USING (action)
WHERE lim IS NULL OR lim[list_position(['entry', 'method', 'field', 'graph'], kind)] < 0 OR rn <= lim[list_position(['entry', 'method', 'field', 'graph'], kind)] GROUP BY ALL""".replace(
        "ACTIONS", v.sql_list(fixed.EVIDENCE_ACTIONS)
    ),
)
def evidence_profiles(spark, sf):
    li = table(spark, sf, "lineitem")
    items = li.select(
        "l_orderkey", (F.col("l_partkey") * 10 + F.col("l_linenumber")).alias("item_no"), _action().alias("action"),
        v.pick(["entry", "method", "field", "graph"], F.col("l_suppkey") % 4).alias("kind"),
    )
    kept = ev.apply_profile(items, ev.profile_table(spark), "l_orderkey")
    return kept.groupBy("action", "kind").agg(F.count(F.lit(1)).alias("kept"), F.sum("item_no").alias("items"))


SECTIONS = sorted({s for lists in (fixed.PROFILE_SECTIONS_LEFT_OUT, fixed.PROFILE_SECTIONS_KEPT) for names in lists.values() for s in names}) + ["notes"]


@query(
    "W24_profile_sections",
    f"""
SELECT coalesce(action, '') AS action, section, count(*) AS kept FROM (SELECT
  CASE WHEN l_orderkey % 8 < 6 THEN list_extract({v.sql_list(fixed.EVIDENCE_ACTIONS)}, CAST(l_orderkey % 8 AS INT) + 1) WHEN l_orderkey % 8 = 6 THEN 'OTHER' END AS action,
  list_extract({v.sql_list(SECTIONS)}, CAST(l_partkey % {len(SECTIONS)} AS INT) + 1) AS section FROM lineitem)
WHERE (action || '/' || section) IS NULL OR (action || '/' || section NOT IN ({{left_out}}) AND (action NOT IN ({{strict}}) OR action || '/' || section IN ({{kept}}))) GROUP BY ALL""".format(
        left_out=", ".join(f"'{a}/{s}'" for a, names in fixed.PROFILE_SECTIONS_LEFT_OUT.items() for s in names),
        strict=", ".join(f"'{a}'" for a in fixed.PROFILE_SECTIONS_KEPT),
        kept=", ".join(f"'{a}/{s}'" for a, names in fixed.PROFILE_SECTIONS_KEPT.items() for s in names),
    ),
)
def profile_sections(spark, sf):
    rows = table(spark, sf, "lineitem").select(_action().alias("action"), v.pick(SECTIONS, F.col("l_partkey") % len(SECTIONS)).alias("section"))
    kept = rows.filter(ev.keeps_section(F.col("action"), F.col("section")))
    return kept.groupBy(F.coalesce("action", F.lit("")).alias("action"), "section").agg(F.count(F.lit(1)).alias("kept"))


# evidence made from a document: (section, field, field_no, text or list); repeats make some of it long
_LINES = ["mutationKillPlan.steps", "publicApiEvidence.antiPatterns", "alternativeChains."]
_WHOLE = {  # place: repeats of the whole text
    "entryGraphEvidence.path": 1, "entryGraphEvidence.dump": 5, "publicApiEvidence.source": 3, "entryEvidence.text": 2,
    "observableSelectionPlan.note": 1, "liftedReachabilityPlan.note": 1, "notes.": 4, "entry.recommendedTarget": 1, "mutationGraphEvidence.dump": 4,
}


def _places():
    """(section, field, number of the field in its section, repeats of the whole text or 0 for its lines)"""
    seen, out = {}, []
    for place in [*_LINES, *_WHOLE]:
        section, field = place.split(".")
        out.append((section, field, seen.get(section, 0), _WHOLE.get(place, 0)))
        seen[section] = seen.get(section, 0) + 1
    return out


def evidence_leaves(docs):
    """Evidence leaves of every document: its lines in lists, its whole text in single fields, entries as objects."""
    k = F.col("doc_id") % 8
    action = F.when(k < 6, v.pick(fixed.EVIDENCE_ACTIONS, k)).when(k == 6, "OTHER")
    base = docs.select("doc_id", action.alias("action"), "text", F.split("text", "\n").alias("lines"))

    def leaf(section, field, field_no, item_no, member, member_no, text):
        values = [section, field, field_no, item_no, member, member_no, -1, text, True]
        return F.struct(*[(x if isinstance(x, Column) else F.lit(x)).alias(c) for c, x in zip(ev.LEAF, values)])

    parts = []
    for section, field, field_no, repeats in _places():
        if repeats:
            text = F.repeat("text", (F.col("doc_id") % repeats + 1).cast("int"))
            parts.append(F.array(leaf(section, field, field_no, -1, "", -1, text)))
        else:
            parts.append(F.transform("lines", lambda x, i: leaf(section, field, field_no, i, "", -1, x)))  # noqa: B023
    entries = F.transform("lines", lambda x, i: F.array(*[leaf("codeKbContext", "candidateEntries", 0, i, f"m{n}", n, x) for n in range(6)]))
    return base.select("doc_id", "action", F.explode(F.concat(*parts, F.flatten(entries))).alias("_l")).select("doc_id", "action", "_l.*")


def _sql_leaf(section, field, field_no, item_no, member, member_no, text):
    return f"{{'section': '{section}', 'field': '{field}', 'field_no': {field_no}, 'item_no': {item_no}, 'member': {member}, 'member_no': {member_no}, 'text': {text}}}"


_SQL_PARTS = [
    f"[{_sql_leaf(s, f, n, 'CAST(-1 AS BIGINT)', chr(39) * 2, '-1', f'repeat(text, CAST(doc_id % {r} + 1 AS INT))')}]" if r
    else f"list_transform(lines, lambda x, i: {_sql_leaf(s, f, n, 'i - 1', chr(39) * 2, '-1', 'x')})"
    for s, f, n, r in _places()
] + [f"list_transform(lines, lambda x, i: {_sql_leaf('codeKbContext', 'candidateEntries', 0, 'i - 1', repr(f'm{n}'), n, 'x')})" for n in range(6)]
_SQL_VALUE = lambda x: "NULL" if x is None else f"'{x}'" if isinstance(x, str) else str(x)
_SQL_ROWS = lambda rows: ", ".join("(" + ", ".join(map(_SQL_VALUE, r)) + ")" for r in rows)
_SQL_RULE = "section, rule_field, text_chars, items, item_chars, members, sub_items, sub_chars"
_SQL_PLANS = ", ".join(f"'{s}'" for names in fixed.EVIDENCE_PLANS.values() for s in names)
_SQL_CUT = """CASE WHEN {n} IS NULL THEN {t} WHEN length(trim({t}, blanks)) <= {n} OR {n} <= 0 THEN trim({t}, blanks) ELSE trim({t}, blanks)[:{n} - 3] || '...' END"""
_SQL_CHARS = """length(CAST(to_json({t}) AS VARCHAR)) + CASE WHEN member <> '' THEN length(member) + 3 + CASE WHEN member_no = 0 THEN 2 ELSE 1 END ELSE 0 END
  + CASE WHEN member_no <= 0 THEN CASE WHEN item_no = 0 THEN 2 WHEN item_no > 0 THEN 1 ELSE 0 END ELSE 0 END
  + CASE WHEN member_no <= 0 AND item_no <= 0 AND field <> '' THEN length(field) + 3 + CASE WHEN field_no = 0 THEN 2 ELSE 1 END ELSE 0 END
  + CASE WHEN member_no <= 0 AND item_no <= 0 AND field_no = 0 THEN length(section) + 4 ELSE 0 END"""
_SQL_LIMIT = "(item_no < 0 OR items IS NULL OR item_no < items) AND (item_no < 0 OR member = '' OR members IS NULL OR member_no < members)"
_SQL_LETTERS = "CASE WHEN item_no >= 0 AND member <> '' THEN sub_chars WHEN item_no >= 0 THEN item_chars ELSE text_chars END"


@query(
    "W24_capped_evidence",
    f"""
WITH texts AS (
  SELECT doc_id, text, string_split(text, chr(10)) AS lines,
    CASE WHEN doc_id % 8 < 6 THEN list_extract({v.sql_list(fixed.EVIDENCE_ACTIONS)}, CAST(doc_id % 8 AS INT) + 1) WHEN doc_id % 8 = 6 THEN 'OTHER' END AS action
  FROM documents
), leaves AS (
  SELECT doc_id, action, unnest(flatten([{", ".join(_SQL_PARTS)}]), recursive := true) FROM texts
), rules AS (
  SELECT * FROM (VALUES {_SQL_ROWS(ev.profile_rules())}) t(action, {_SQL_RULE})
), over AS (
  SELECT * FROM (VALUES {_SQL_ROWS(ev.over_rules())}) t({_SQL_RULE})
), caps AS (
  SELECT * FROM (VALUES {_SQL_ROWS([(a, x[0]) for a, x in fixed.PROFILE_LIMITS.items() if x[0] > 0])}) t(action, cap)
), listed AS (
  SELECT *, CASE WHEN section IN ({_SQL_PLANS}) THEN '*' ELSE field END AS rule_field, array_to_string(list_transform(range(1, 33), lambda c: chr(CAST(c AS INT))), '') AS blanks
  FROM leaves WHERE action IS NULL OR (action || '/' || section NOT IN ({", ".join(f"'{a}/{s}'" for a, names in fixed.PROFILE_SECTIONS_LEFT_OUT.items() for s in names)})
    AND (action NOT IN ({", ".join(f"'{a}'" for a in fixed.PROFILE_SECTIONS_KEPT)}) OR action || '/' || section IN ({", ".join(f"'{a}/{s}'" for a, names in fixed.PROFILE_SECTIONS_KEPT.items() for s in names)})))
), shown AS (
  SELECT doc_id, action, section, field, field_no, item_no, CASE WHEN items = 0 THEN '' ELSE member END AS member, member_no, blanks, rule_field, items = 0 AS emptied,
    {_SQL_CUT.format(t="text", n=f"({_SQL_LETTERS})")} AS text
  FROM listed LEFT JOIN rules USING (action, section, rule_field) WHERE ({_SQL_LIMIT}) OR (items = 0 AND item_no = 0)
), cut AS (
  SELECT shown.*, {_SQL_CUT.format(t="text", n=f"({_SQL_LETTERS})")} AS short, {_SQL_LIMIT} AS stays,
    CASE section {" ".join(f"WHEN '{s}' THEN {i}" for i, names in enumerate(fixed.EVIDENCE_TIERS, start=2) for s in names)} ELSE 0 END AS tier
  FROM shown LEFT JOIN over USING (section, rule_field)
), sized AS (
  SELECT *, CASE WHEN emptied THEN {_SQL_CHARS.format(t="''")} - 2 ELSE {_SQL_CHARS.format(t="text")} END AS a,
    CASE WHEN NOT stays THEN 0 WHEN emptied THEN {_SQL_CHARS.format(t="''")} - 2 ELSE {_SQL_CHARS.format(t="short")} END AS b FROM cut
), sums AS (
  SELECT doc_id, action, cap, sum(a) + 1 AS c0, sum(b) + 1 AS c1, sum(b) FILTER (tier <> 2) + 1 AS c2, sum(b) FILTER (tier NOT IN (2, 3)) + 1 AS c3,
    sum(b) FILTER (tier = 0) + 1 AS c4 FROM sized LEFT JOIN caps USING (action) GROUP BY ALL
), levels AS (
  SELECT *, CASE WHEN cap IS NULL OR c0 <= cap THEN 0 WHEN c1 <= cap THEN 1 WHEN c2 <= cap THEN 2 WHEN c3 <= cap THEN 3 ELSE 4 END AS level FROM sums
)
SELECT doc_id, coalesce(l.action, '') AS action, level, CAST(c0 AS BIGINT) AS chars_before, CAST([c0, c1, c2, c3, c4][level + 1] AS BIGINT) AS chars, count(*) AS leaves,
  CAST(sum(CAST('0x' || md5(section || '|' || field || '|' || item_no || '|' || member || '|' || CASE WHEN emptied THEN '' WHEN level > 0 THEN short ELSE text END)[:8] AS BIGINT)) AS BIGINT) AS content
FROM levels l JOIN sized USING (doc_id) WHERE level = 0 OR (stays AND (tier = 0 OR tier > level)) GROUP BY ALL""",
)
def capped_evidence(spark, sf):
    """Evidence of every document under its action's character limit; content is a sum of digests of all that stays."""
    rows, levels = ev.capped_evidence(evidence_leaves(table(spark, sf, "documents")), "doc_id")
    place = F.concat_ws("|", "section", "field", "item_no", "member", F.coalesce("text", F.lit("")))
    digest = F.conv(F.substring(F.md5(place), 1, 8), 16, 10).cast("long")
    kept = rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("leaves"), F.sum(digest).alias("content"))
    return levels.join(kept, "doc_id").select("doc_id", F.coalesce("action", F.lit("")).alias("action"), "level", "chars_before", "chars", "leaves", "content")


_TESTS = ["x = 1;", "assertTrue(true);", "assertNotNull(x); assertNotNull(y);", "assertEquals(1, f(x)); assertTrue(true);", "assertSame(a, b);", "assertFalse(\"m\", false); assertTrue(true);", "fail();"]


@query(
    "P9_screened_assertions",
    f"""
SELECT assertions, no_assertion, only_tautologies, only_not_null, only_identity, count(*) AS n FROM (SELECT {v.sql_pick(['0', '1', '2', '2', '1', '2', '1'], 'i')}::INT AS assertions, i = 0 AS no_assertion,
  i IN (1, 5) AS only_tautologies, i = 2 AS only_not_null, i = 4 AS only_identity FROM (SELECT c % 7 AS i FROM (SELECT doc_id AS c FROM documents))) GROUP BY ALL""",
)
def screened_assertions(spark, sf):
    """Assertion calls inside prose: the prose itself holds none."""
    d = table(spark, sf, "documents").select("doc_id", F.concat(F.regexp_replace("text", r"(?i)assert|fail", "-"), F.lit("\n"), v.pick(_TESTS, F.col("doc_id") % 7)).alias("text"))
    return ev.screen_assertions(d).groupBy("assertions", "no_assertion", "only_tautologies", "only_not_null", "only_identity").agg(F.count(F.lit(1)).alias("n"))


@query(
    "M14_cache_misses",
    """
SELECT sha256('ns' || chr(10) || text) AS cache_key, min(conv_id * 1000 + turn) AS first_request, count(*) AS requests FROM conversations
WHERE sha256('ns' || chr(10) || text) NOT IN (SELECT sha256('ns' || chr(10) || text) FROM conversations WHERE turn = 0) GROUP BY 1""",
)
def cache_misses(spark, sf):
    c = table(spark, sf, "conversations").withColumnRenamed("text", "prompt").withColumn("request_no", F.col("conv_id") * 1000 + F.col("turn"))
    cache = ev.with_cache_key(c.filter("turn = 0"), "ns").select("cache_key").distinct()
    return ev.cache_misses(c, cache, "ns", "request_no")


@query(
    "M14_cache_hits",
    """SELECT conv_id, turn FROM conversations WHERE sha256('ns' || chr(10) || text) IN (SELECT sha256('ns' || chr(10) || text) FROM conversations WHERE turn = 0)""",
)
def cache_hits(spark, sf):
    c = table(spark, sf, "conversations").withColumnRenamed("text", "prompt")
    cache = ev.with_cache_key(c.filter("turn = 0"), "ns").select("cache_key").distinct()
    return ev.cache_hits(c, cache, "ns").select("conv_id", "turn")
