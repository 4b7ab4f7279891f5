"""Kill matrix, scores, histories, sampling and adequate sets."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import adequacy as ad
from ..operators import killmatrix as km
from ..session import cut_lineage
from . import views as v
from .registry import query
from .views import table


def _kills(spark, sf):
    return km.with_kills(v.v_outcomes(spark, sf))


@query(
    "A19_mutant_verdicts",
    """
SELECT class_name, mutant, coalesce(bool_or(kills), false) AS killed, coalesce(array_to_string(list_sort(list(DISTINCT test) FILTER (kills)), ','), '') AS killing_tests,
  count(DISTINCT test) AS tests_run FROM v_mutants LEFT JOIN v_kills USING (class_name, mutant) GROUP BY ALL""",
    ("v_outcomes", "v_kills", "v_mutants"),
)
def mutant_verdicts(spark, sf):
    out = km.mutant_verdicts(_kills(spark, sf), ["class_name", "mutant"], v.v_mutants(spark, sf))
    return out.withColumn("killing_tests", F.array_join(F.col("killing_tests").cast("array<string>"), ","))


@query("A19_killing_tests", "SELECT DISTINCT class_name, mutant, test FROM v_kills WHERE kills", ("v_outcomes", "v_kills"))
def killing_tests(spark, sf):
    """Killing tests of every mutant in long form."""
    return km.killing_tests(_kills(spark, sf), ["class_name", "mutant"])


@query(
    "A19_mutants_per_test",
    """
SELECT class_name, test, count(*) OVER (PARTITION BY class_name, test) AS killed_mutants, mutant
FROM (SELECT DISTINCT class_name, test, mutant FROM v_kills WHERE kills)""",
    ("v_outcomes", "v_kills"),
)
def mutants_per_test(spark, sf):
    return km.mutants_per_test(_kills(spark, sf), ["class_name", "test"])


@query(
    "A20_failed_workers",
    """
WITH r AS (SELECT class_name, mutant, test, list_position(TEXTS, min(mutant_result)) AS m FROM v_outcomes GROUP BY ALL),
grid AS (SELECT base.class_name, test, o, o_orderkey AS mutant, o_orderstatus = 'P' AS late, o_orderkey NOT IN (SELECT mutant FROM r) AS silent
  FROM orders JOIN base ON base.class_name = 'C' || (o_orderkey % 50))
SELECT class_name, kills, count(*) AS outcomes FROM (
  SELECT class_name, CASE WHEN o = m THEN false WHEN o = 3 OR m = 3 THEN o <> 3 AND m = 3 WHEN o = 5 OR m = 5 THEN o <> 5 AND m = 5
    WHEN o IN (4, 6) OR m IN (4, 6) THEN false ELSE true END AS kills
  FROM (SELECT class_name, o, CASE WHEN late THEN 3 WHEN silent THEN 8 ELSE coalesce(r.m, 1) END AS m FROM grid LEFT JOIN r USING (class_name, mutant, test))
) GROUP BY ALL""".replace("TEXTS", v.sql_list(v.OUTCOME_TEXTS)),
    ("v_outcomes", "base"),
)
def failed_workers(spark, sf):
    """Runs of pending orders ended late; tests that the other runs do not report pass."""
    o = v.v_outcomes(spark, sf)
    originals = o.groupBy("class_name", "test").agg(F.min("original_result").alias("original_result"))
    results = o.groupBy("class_name", "mutant", "test").agg(F.min("mutant_result").alias("mutant_result"))
    late = F.col("o_orderstatus") == "P"
    runs = table(spark, sf, "orders").select(
        F.concat(F.lit("C"), (F.col("o_orderkey") % 50).cast("string")).alias("class_name"), F.col("o_orderkey").alias("mutant"),
        (~late).alias("succeeded"), late.alias("timed_out"), F.lit("").alias("message"),
    )
    full = km.complete_results(originals, results, runs, 3000)
    texts = full.groupBy("class_name", "original_result", "mutant_result").agg(F.sum("tests").alias("tests"))
    return km.with_kills(cut_lineage(texts)).groupBy("class_name", "kills").agg(F.sum("tests").alias("outcomes"))


@query(
    "A21_suite_scores",
    """
SELECT class_name, count_if(k) AS killed, count_if(NOT k) AS live, round(count_if(k) * 100.0::DOUBLE / count(*), 6) AS score
FROM (SELECT class_name, mutant, bool_or(kills) AS k FROM v_kills GROUP BY ALL) GROUP BY 1""",
    ("v_outcomes", "v_kills"),
)
def suite_scores(spark, sf):
    return km.suite_scores(km.mutant_flags(_kills(spark, sf), ["class_name", "mutant"]), "class_name").withColumn("score", F.round("score", 6))


@query(
    "M3_live_minus_killed",
    "SELECT DISTINCT l_orderkey AS mutant FROM lineitem WHERE l_returnflag <> 'R' AND l_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')",
)
def live_minus_killed(spark, sf):
    m = v.v_matrix(spark, sf)
    return km.live_minus_killed(m.filter(~F.col("kills")), m.filter("kills"), ["mutant"])


_OLD = "CASE o_orderstatus WHEN 'F' THEN 'KILLED' WHEN 'P' THEN 'EQUIVALENT' ELSE 'LIVE' END"


def _states(orders):
    s = F.col("o_orderstatus")
    return orders.select(
        F.col("o_orderkey").alias("mutant"),
        F.when(s == "F", F.lit("KILLED")).when(s == "P", F.lit("EQUIVALENT")).otherwise(F.lit("LIVE")).alias("state"),
    )


def _histories(spark, sf):
    """Stored states of most orders, and the states of a new run from their lines."""
    old = _states(table(spark, sf, "orders").filter(F.col("o_orderpriority") != "5-LOW"))
    run = v.v_matrix(spark, sf).groupBy("mutant").agg(F.bool_or("kills").alias("k")).select(
        "mutant", F.when(F.col("k"), F.lit("KILLED")).otherwise(F.lit("LIVE")).alias("state")
    )
    return old, run


_MERGED = f"""SELECT mutant, CASE WHEN old = 'KILLED' THEN 'KILLED' WHEN old = 'EQUIVALENT' THEN CASE WHEN new = 'KILLED' AND RERUN THEN 'KILLED' ELSE 'EQUIVALENT' END
  WHEN new = 'KILLED' THEN 'KILLED' ELSE coalesce(old, new) END AS state
FROM (SELECT o_orderkey AS mutant, {_OLD} AS old FROM orders WHERE o_orderpriority <> '5-LOW')
FULL OUTER JOIN (SELECT mutant, CASE WHEN bool_or(kills) THEN 'KILLED' ELSE 'LIVE' END AS new FROM v_matrix GROUP BY 1) USING (mutant)"""


@query("M4_merged_history", _MERGED.replace("RERUN", "true"), ("v_matrix",))
def merged_history(spark, sf):
    old, run = _histories(spark, sf)
    return km.merge_history(old, run, ["mutant"], True)


@query(
    "A22_history_scores",
    f"""
SELECT 'C' || (mutant % 50) AS class_name, count_if(state = 'KILLED') AS killed, count_if(state = 'LIVE') AS live, count_if(state = 'EQUIVALENT') AS equivalent,
  count(*) AS total, round(count_if(state = 'KILLED') / count(*), 4) AS score FROM ({_MERGED.replace("RERUN", "false")}) GROUP BY 1""",
    ("v_matrix",),
)
def history_scores(spark, sf):
    old, run = _histories(spark, sf)
    states = km.merge_history(old, run, ["mutant"], False).withColumn("class_name", F.concat(F.lit("C"), (F.col("mutant") % 50).cast("string")))
    return km.history_scores(states, "class_name")


@query(
    "M5_marked_equivalents",
    f"""
SELECT mutant, CASE WHEN state = 'LIVE' AND mutant IN (SELECT o_orderkey FROM orders WHERE o_totalprice > 300000) THEN 'EQUIVALENT' ELSE state END AS state
FROM (SELECT o_orderkey AS mutant, {_OLD} AS state FROM orders)""",
)
def marked_equivalents(spark, sf):
    old = _states(table(spark, sf, "orders"))
    marks = table(spark, sf, "orders").filter("o_totalprice > 300000").select(F.col("o_orderkey").alias("mutant"))
    return km.mark_equivalent(old, marks, ["mutant"])


@query(
    "M5_marked_matrix_rows",
    """
SELECT mutant, total, total = 0 AND mutant % 2 = 0 OR equivalent AS equivalent
FROM (SELECT class_name, mutant, count(DISTINCT test) FILTER (kills) AS total FROM v_kills GROUP BY ALL) JOIN v_mutants USING (class_name, mutant)""",
    ("v_outcomes", "v_kills", "v_mutants"),
)
def marked_matrix_rows(spark, sf):
    mutants = v.v_mutants(spark, sf)
    verdicts = km.mutant_verdicts(_kills(spark, sf), ["class_name", "mutant"])
    matrix = verdicts.withColumn("total", F.size("killing_tests").cast("long")).join(mutants, ["class_name", "mutant"])
    return km.mark_equivalent_rows(matrix, mutants.filter("mutant % 2 = 0"), ["mutant"])


def _sets(spark, sf):
    """Test sets: one per nation, its suppliers' tests."""
    return table(spark, sf, "supplier").select(F.col("s_nationkey").alias("set_id"), F.col("s_suppkey").alias("test"))


_SET_SQL = """SELECT set_id, count(DISTINCT mutant) AS killed, any_value(n) AS countable, round(count(DISTINCT mutant) / any_value(n), 6) AS score
FROM (SELECT s_nationkey AS set_id, s_suppkey AS test FROM supplier) LEFT JOIN (SELECT test, mutant FROM v_matrix WHERE kills) USING (test),
  (SELECT count_if(NOT equivalent) AS n FROM v_mutants) GROUP BY 1"""


def _set_scores(spark, sf):
    kills = v.v_matrix(spark, sf).filter("kills").select("mutant", "test")
    return km.test_set_scores(kills, v.v_mutants(spark, sf), _sets(spark, sf))


@query("A23_test_set_scores", _SET_SQL, ("v_matrix", "v_mutants"))
def test_set_scores(spark, sf):
    return _set_scores(spark, sf).withColumn("score", F.round("score", 6))


@query("A23_average_score", f"SELECT count(*) AS sets, round(avg(score), 5) AS average_score FROM ({_SET_SQL})", ("v_matrix", "v_mutants"))
def average_score(spark, sf):
    return km.average_score(_set_scores(spark, sf)).withColumn("average_score", F.round("average_score", 5))


@query("A24_kills_per_test", "SELECT test, count(DISTINCT mutant) AS killed_mutants FROM v_matrix WHERE kills GROUP BY 1", ("v_matrix",))
def kills_per_test(spark, sf):
    return km.kills_per_test(v.v_matrix(spark, sf))


@query(
    "A25_mapped_run_counts",
    """
SELECT o_orderkey AS mutant, count(CASE WHEN run_no = 1 THEN 1 END) AS primary_runs, count(CASE WHEN run_no > 1 THEN 1 END) AS fallback_runs,
  count(CASE WHEN m = 3 THEN 1 END) AS timeout_runs, coalesce(bool_or(kills), false) AS killed, count(CASE WHEN m = 3 THEN 1 END) > 0 AS had_timeout, count(run_no) = 0 AS without_test
FROM orders LEFT JOIN (SELECT *, min(CASE WHEN kills THEN run_no END) OVER (PARTITION BY mutant) AS stop FROM v_kills) k
  ON k.mutant = o_orderkey AND (stop IS NULL OR run_no <= stop) GROUP BY 1""",
    ("v_outcomes", "v_kills"),
)
def mapped_run_counts(spark, sf):
    runs = _kills(spark, sf).select("mutant", "run_no", "kills", F.col("mutant_result").startswith("time_out").alias("timed_out"))
    return km.mapped_run_counts(v.v_mutants(spark, sf).select("mutant"), runs, ["mutant"])


@query(
    "J28_mapped_candidates",
    """
SELECT mutant, count(*) AS candidates, count_if(source = 0) AS own, arg_min(test_set_name, CASE WHEN source = 0 THEN 0 ELSE 1000000000 END + test_no) AS first_test,
  sum(test_no) AS test_no_sum FROM (
  SELECT m.mutant, t.test_set_name, t.test_no, 0 AS source FROM m JOIN t ON t.mutant = m.mutant AND t.first_row
  UNION ALL SELECT mutant, test_set_name, test_no, 1 FROM (SELECT m.mutant, t.test_set_name, t.test_no, row_number() OVER (PARTITION BY m.class_name, m.method, m.mutant ORDER BY t.test_no) AS rn
    FROM m JOIN t ON t.class_name = m.class_name AND t.method = m.method LEFT JOIN t own ON own.mutant = m.mutant AND own.first_row
    WHERE own.mutant IS NULL OR NOT (t.test_set_name = own.test_set_name AND t.mutant = m.mutant)) WHERE rn <= 50) GROUP BY 1""",
    ("v_entries", "m", "t"),
)
def mapped_candidates(spark, sf):
    tests = v.v_entries(spark, sf).select("class_name", "method", "mutant", "test_set_name", F.col("row_no").alias("test_no"))
    mutants = v.all_customers(spark, sf).select("class_name", "method", "mutant")
    c = km.mapped_candidates(mutants, tests)
    return c.groupBy("mutant").agg(
        F.count(F.lit(1)).alias("candidates"),
        F.count_if(F.col("source") == 0).alias("own"),
        F.min_by("test_set_name", "candidate_no").alias("first_test"),
        F.sum("test_no").alias("test_no_sum"),
    )


@query(
    "P6_operator_targets",
    "SELECT operator, count(*) AS n FROM v_traj WHERE contains(operator, 'ROR') OR contains(operator, 'SDL_1') GROUP BY 1",
    ("v_traj",),
)
def operator_targets(spark, sf):
    return km.with_targets(v.v_traj(spark, sf), "operator", ["ROR", "SDL_1"]).groupBy("operator").agg(F.count(F.lit(1)).alias("n"))


@query(
    "S14_matrix_long_form",
    """
SELECT part.p_brand AS mutant, 't' || s AS test, bool_or(p_size % 5 = s) AS kills, false AS equivalent FROM part, (SELECT unnest([0, 1, 2, 3, 4]) AS s) GROUP BY ALL""",
)
def matrix_long_form(spark, sf):
    """A wide matrix (brand x size class) brought into long form."""
    size = F.col("p_size") % 5
    wide = table(spark, sf, "part").groupBy(F.col("p_brand").alias("Mutant")).agg(
        *[F.when(F.bool_or(size == i), F.lit("1")).otherwise(F.lit("")).alias(f"t{i}") for i in range(5)],
        F.count(F.lit(1)).alias("Total"),
        F.lit("n").alias("Equiv?"),
    )
    return km.unpivot_matrix(wide).drop("mark")


@query(
    "G4_exact_sample",
    """
SELECT mutant, class_name FROM (SELECT *, row_number() OVER (PARTITION BY class_name ORDER BY md5('s1:' || mutant), mutant) AS rn,
  count(*) OVER (PARTITION BY class_name) AS n FROM v_mutants) WHERE rn <= floor(n * 0.15::DOUBLE + 0.5)""",
    ("v_mutants",),
)
def exact_sample(spark, sf):
    return ad.exact_sample(v.v_mutants(spark, sf).select("mutant", "class_name"), ["class_name"], "mutant", 0.15, "s1")


@query(
    "G4_exact_sample_all",
    "SELECT mutant FROM (SELECT *, row_number() OVER (ORDER BY md5('s2:' || mutant), mutant) AS rn, count(*) OVER () AS n FROM v_mutants) WHERE rn <= floor(n * 0.05::DOUBLE + 0.5)",
    ("v_mutants",),
)
def exact_sample_all(spark, sf):
    return ad.exact_sample(v.v_mutants(spark, sf).select("mutant"), [], "mutant", 0.05, "s2")


def _cover(spark, sf, trials):
    kills = v.v_matrix(spark, sf).filter("kills").select("class_name", "mutant", "test")
    return ad.adequate_sets(kills, ["class_name"], trials)


# the choice one mutant at a time: a step takes the first open mutant's test and what that test kills
_COVER_SQL = """
WITH RECURSIVE edges AS (
  SELECT DISTINCT class_name, mutant, test FROM v_matrix WHERE kills {where}
), choices AS (
  SELECT trial, class_name, mutant, arg_min(test, md5('cover:' || trial || ':' || mutant || ':' || test) || ':' || test) AS test, md5('cover:' || trial || ':' || mutant) || ':' || mutant AS prio
  FROM edges, (SELECT unnest(range({trials})) AS trial) GROUP BY ALL
), killers AS (
  SELECT class_name, test, list(mutant) AS killed FROM edges GROUP BY ALL
), cover AS (
  SELECT trial, class_name, list({{'m': mutant, 't': test}} ORDER BY prio) AS left_over, CAST(NULL AS BIGINT) AS mutant, CAST(NULL AS BIGINT) AS test FROM choices GROUP BY ALL
  UNION ALL
  SELECT c.trial, c.class_name, list_filter(left_over, lambda x: NOT list_contains(killed, x.m)), left_over[1].m, left_over[1].t
  FROM cover c JOIN killers k ON k.class_name = c.class_name AND k.test = left_over[1].t WHERE len(left_over) > 0
)
"""


@query(
    "G5_adequate_sets",
    _COVER_SQL.format(where="", trials=2) + "SELECT CAST(trial AS INT) AS trial, class_name, count(*) AS tests FROM cover WHERE mutant IS NOT NULL GROUP BY ALL",
    ("v_matrix",),
)
def adequate_sets(spark, sf):
    return _cover(spark, sf, 2).groupBy("trial", "class_name").agg(F.count(F.lit(1)).alias("tests"))


@query(
    "G5_unmarked_adequate_sets",
    _COVER_SQL.format(where="AND mutant NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P' OR o_orderkey % 17 = 0 OR o_orderkey % 19 = 0)", trials=2)
    + "SELECT CAST(trial AS INT) AS trial, class_name, mutant, test FROM cover WHERE mutant IS NOT NULL",
    ("v_matrix",),
)
def unmarked_adequate_sets(spark, sf):
    """Tests chosen for the mutants that have no mark, with the mutant each was chosen for."""
    o, status = F.col("mutant"), F.col("o_orderstatus")
    orders = table(spark, sf, "orders").withColumn("mutant", F.col("o_orderkey"))
    mark = F.when(status == "P", "Y").when(o % 17 == 0, "n").when(o % 19 == 0, " ? ").otherwise("")
    marks = orders.select(F.concat(F.lit("C"), (o % 50).cast("string")).alias("class_name"), "mutant", mark.alias("mark"))
    kills = v.v_matrix(spark, sf).filter("kills").select("class_name", "mutant", "test")
    return ad.adequate_sets(ad.without_marked(kills, marks, ["class_name"]), ["class_name"], 2)


@query(
    "G6_minimal_sets",
    """
SELECT array_to_string(a.tests, ',') AS tests FROM (SELECT DISTINCT tests FROM sets) a
WHERE NOT EXISTS (SELECT 1 FROM (SELECT DISTINCT tests FROM sets) b WHERE len(b.tests) < len(a.tests) AND len(list_intersect(a.tests, b.tests)) = len(b.tests))""",
    ("sets",),
)
def minimal_sets(spark, sf):
    o = table(spark, sf, "orders")
    sets = o.select(F.col("o_custkey").alias("set_id"), F.concat_ws("-", "o_orderstatus", "o_orderpriority").alias("test"))
    return ad.minimal_sets(sets).select(F.array_join("tests", ",").alias("tests"))

