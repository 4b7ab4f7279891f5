"""Operators against brute force, and properties that SQL twins do not show."""

import hashlib
import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from mutspan.functions import fixed
from mutspan.operators import adequacy, bandit, candidates, evidence, facts, graph, history, killmatrix, merge, ordering, status_report, trajectory, upserts


def md5(*parts):
    return hashlib.md5(":".join(map(str, parts)).encode()).hexdigest()


def sequential_cover(edges, seed, trial):
    """Mutants in hash order; an uncovered one picks its test of smallest hash."""
    tests = {}
    for mutant, test in edges:
        tests.setdefault(mutant, set()).add(test)
    order = sorted(tests, key=lambda m: f"{md5(seed, trial, m)}:{m}")
    covered, picks = set(), []
    for mutant in order:
        if mutant in covered:
            continue
        pick = min(tests[mutant], key=lambda t: f"{md5(seed, trial, mutant, t)}:{t}")
        picks.append((mutant, pick))
        covered |= {m for m, ts in tests.items() if pick in ts}
    return picks, covered == set(tests)


def test_adequate_sets_equal_the_sequential_choice(spark):
    rng = random.Random(3)
    groups = {g: sorted({(rng.randrange(60), rng.randrange(12)) for _ in range(150)}) for g in ("a", "b")}
    rows = [(g, m, t) for g, edges in groups.items() for m, t in edges]
    kills = spark.createDataFrame(rows, "g string, mutant int, test int")
    got = {}
    for r in adequacy.adequate_sets(kills, ["g"], 2, "s").collect():
        got.setdefault((r["trial"], r["g"]), set()).add((r["mutant"], r["test"]))
    for trial, g in itertools.product(range(2), groups):
        picks, complete = sequential_cover(groups[g], "s", trial)
        assert complete and got[(trial, g)] == set(picks)


def test_minimal_sets(spark):
    sets = {1: "ab", 2: "abc", 3: "cd", 4: "dc", 5: "abcd", 6: "e"}
    df = spark.createDataFrame([(k, t) for k, ts in sets.items() for t in ts], "set_id int, test string")
    assert {"".join(r["tests"]) for r in adequacy.minimal_sets(df).collect()} == {"ab", "cd", "e"}


@pytest.mark.parametrize("share", [0.0, 0.1, 0.5, 1.0])
def test_exact_sample_size(spark, share):
    df = spark.range(1000).select("id", (F.col("id") % 3).alias("g"))
    got = dict(adequacy.exact_sample(df, ["g"], "id", share, "x").groupBy("g").count().collect())
    want = {g: int(n * share + 0.5) for g, n in ((0, 334), (1, 333), (2, 333))}
    assert got == {g: n for g, n in want.items() if n}


def test_position_and_text_of_a_hot_key(spark):
    rows = [(1 if i % 3 else i, i) for i in range(2000)]
    df = spark.createDataFrame(rows, "k int, line_no long")
    block = F.floor(F.col("line_no") / 100)
    got = {r["line_no"]: (r["p"], r["n"]) for r in ordering.with_position(df, ["k"], "line_no", "p", block, "n").collect()}
    seen, total = {}, {}
    for k, _ in rows:
        total[k] = total.get(k, 0) + 1
    for k, i in rows:
        seen[k] = seen.get(k, 0) + 1
        assert got[i] == (seen[k], total[k])
    text = ordering.ordered_text(df, ["k"], "line_no", F.col("line_no").cast("string"), ",", "t", block).filter("k = 1").collect()[0]["t"]
    assert text == ",".join(str(i) for k, i in rows if k == 1)


def test_report_rows_are_numbered_in_order(spark):
    df = spark.range(500).select((F.lit(500) - F.col("id")).alias("v")).repartition(7)
    rows = ordering.with_report_rows(df, [F.col("v")], "n").collect()
    assert {(r["v"], r["n"]) for r in rows} == {(i, i) for i in range(1, 501)}


def test_linear_scores_match_numpy(spark):
    rng = np.random.default_rng(1)
    rows = [(fixed.EVIDENCE_ACTIONS[i % 3], rng.normal(size=4).tolist(), float(i % 5), 1.0 / (1 + i % 4), i) for i in range(60)]
    log = spark.createDataFrame(rows, "action string, x array<double>, reward double, weight double, context_id long")
    models = bandit.model_table(bandit.linear_statistics(log, 4), "SIX_CLASS", 4)
    assert bandit.compatible_models(models, "ONE_HOT", 4).isEmpty()
    got = {r["context_id"]: (r["action"], r["score"]) for r in bandit.linear_scores(log, bandit.compatible_models(models, "SIX_CLASS", 4), 4).collect()}
    for _, x, _, _, i in rows:
        best = None
        for action in fixed.EVIDENCE_ACTIONS:
            a, b = np.eye(4), np.zeros(4)
            for name, y, r, w, _ in rows:
                if name == action:
                    a += w * np.outer(y, y)
                    b += w * r * np.array(y)
            xv = np.array(x)
            s = xv @ np.linalg.solve(a, b) + 0.5 * np.sqrt(xv @ np.linalg.solve(a, xv))
            if best is None or s > best[1] + 1e-12:
                best = (action, s)
        assert got[i][0] == best[0] and got[i][1] == pytest.approx(best[1])


def test_solved_models_match_numpy(spark):
    rng = np.random.default_rng(4)
    rows = []
    for name, d in (("a", 7), ("b", 7)):
        x = rng.normal(size=(20, d))
        rows.append((name, (np.eye(d) + x.T @ x).ravel().tolist(), rng.normal(size=d).tolist()))
    models = spark.createDataFrame(rows, "action string, a array<double>, b array<double>")
    for r in bandit.solved_models(models, 7).collect():
        a, root = np.array(r["a"]).reshape(7, 7), np.array(r["root"])
        assert np.allclose(np.triu(root, 1), 0) and np.allclose(root.T @ root, np.linalg.inv(a))
        assert np.allclose(r["theta"], np.linalg.solve(a, r["b"]))


def test_policy_prefers_exact_then_coarse_then_global(spark):
    log = spark.createDataFrame(
        [("COMPACT", 9.0, "c1", "e1")] * 5 + [("ENTRY_HEAVY", 1.0, "c1", "e2")] * 6 + [("BASELINE", 20.0, "c2", "e3")],
        "action string, reward double, coarse_key string, exact_key string",
    )
    stats = bandit.action_statistics(log)
    contexts = spark.createDataFrame([(1, "c1", "e1"), (2, "c1", "zz"), (3, "zz", "zz"), (4, "c2", "e3")], "context_id int, coarse_key string, exact_key string")
    got = {r["context_id"]: (r["level"], r["action"]) for r in bandit.choose_actions(contexts, stats).collect()}
    assert got == {1: ("EXACT", "COMPACT"), 2: ("COARSE", "COMPACT"), 3: ("GLOBAL", "BASELINE"), 4: ("GLOBAL", "BASELINE")}
    empty = bandit.choose_actions(contexts, bandit.action_statistics(log.limit(0)), warmup="COMPACT")
    assert {(r["level"], r["action"]) for r in empty.collect()} == {("WARMUP", "COMPACT")}


LOG = "mutant_id string, project string, class_name string, method string, line string, outer_loop_round int, line_no long, compile_success boolean, original_pass boolean, killed boolean, target_status string"


def test_history_of_a_round_sees_earlier_rounds_only(spark):
    rows = [
        ("m1", "p", "C", "f", "1", 1, 1, True, True, True, "KILLED"),
        ("m1", "p", "C", "f", "1", 2, 2, True, True, False, "SURVIVED"),
        ("m2", "p", "C", "f", "1", 1, 3, False, False, False, "X"),
        ("m3", "p", "C", "g", "1", 2, 4, True, True, True, "KILLED"),
        ("m4", "p", "C", "f", "2", 0, 5, True, True, True, "KILLED"),
    ]
    log = spark.createDataFrame(rows, LOG)
    seen = history.eligible_history(log, 2)
    assert {(r["mutant_id"], r["line_no"]) for r in seen.collect()} == {("m1", 1), ("m2", 3), ("m4", 5)}
    targets = log.filter("line_no in (1, 4)")
    got = {r["mutant_id"]: r for r in history.shared_experience(targets, seen).collect()}
    # m1 does not count itself
    assert (got["m1"]["same_method_processed"], got["m1"]["same_site_processed"], got["m1"]["same_site_killed"]) == (2, 1, 0)
    assert got["m1"]["same_method_compiled_rate"] == 0.5
    assert (got["m3"]["same_class_processed"], got["m3"]["same_class_killed"]) == (3, 2)


def test_references_keep_test_names_unique_and_skip_the_target(spark):
    schema = "mutant_id string, project string, class_name string, method string, line string, operator string, observable string, entry_kind string, invocation string, compile_success boolean, original_pass boolean, killed boolean, reward double, test_name string, has_test_text boolean"
    rng = random.Random(5)
    rows = [
        (f"m{i}", "p", f"C{rng.randrange(2)}", f"f{rng.randrange(3)}", rng.choice(["", "1", "2"]), rng.choice(["ROR_1", "ROR_2", "SDL_1"]), rng.choice("ab"), rng.choice("cd"), rng.choice("ef"),
         True, True, rng.random() < 0.7, round(rng.uniform(-2, 8), 1), f"T{rng.randrange(12)}", rng.random() < 0.9)
        for i in range(80)
    ]
    df = spark.createDataFrame(rows, schema)
    names = [c.split()[0] for c in schema.split(", ")]
    data = [dict(zip(names, r)) for r in rows]

    def brute(t, keep):
        scored = []
        for r in data:
            if r is t or not (r["killed"] and r["has_test_text"]) or r["class_name"] != t["class_name"]:
                continue
            method = r["method"] == t["method"]
            site = method and t["line"] and r["line"] == t["line"]
            s = 100 if site else 50 if method else 10
            s += 8 * (r["operator"].split("_")[0] == t["operator"].split("_")[0]) + 4 * (r["operator"] == t["operator"])
            s += 5 * (r["observable"] == t["observable"]) + 2 * (r["entry_kind"] == t["entry_kind"]) + 2 * (r["invocation"] == t["invocation"])
            scored.append((-(s + min(5.0, max(0.0, r["reward"]))), -r["reward"], r["mutant_id"], r["test_name"]))
        out = []
        for row in sorted(scored):
            if row[3] not in [o[3] for o in out]:
                out.append(row)
        return [o[2] for o in out[:keep]]

    got = {}
    for r in history.similar_references(df, df, 3).collect():
        got.setdefault(r["mutant_id"], {})[r["reference_rank"]] = r["ref_id"]
    for t in data:
        assert [got.get(t["mutant_id"], {}).get(i) for i in range(1, 1 + len(brute(t, 3)))] == brute(t, 3), t


def test_upserts_are_idempotent(spark):
    rows = spark.createDataFrame(
        [(1, 7, "m", "s", "c", "p", "x", "y", True, "w", "l", "a", "f", "r", 0.2, ""), (2, None, "m ", "s", "c", "p", "x", "y", True, "w", "l", "a", "f", "r", 0.9, "t1")],
        "seq long, mutant_row_id long, mutant_id string, failure_stage string, root_cause string, primary_fix string, secondary_fix string, symptom string, auto_repairable boolean, why string, signal_ledger string, action string, failure_reason string, run_id string, confidence double, created_at string",
    )
    once = upserts.upsert_events(rows)
    twice = upserts.upsert_events(once.withColumn("seq", F.lit(1)).unionByName(rows))
    assert once.collect() == twice.collect()
    row = once.collect()[0]
    assert (row["mutant_row_id"], row["confidence"], row["created_at"]) == (7, 0.9, "t1")


def test_scores_stay_in_range_and_lists_cover_all(spark):
    kills = spark.createDataFrame([("C", m, t, (m + t) % 4 == 0) for m in range(40) for t in range(3)], "class_name string, mutant int, test int, kills boolean")
    verdicts = killmatrix.mutant_verdicts(kills, ["class_name", "mutant"])
    score = killmatrix.suite_scores(verdicts, "class_name").collect()[0]
    assert score["killed"] + score["live"] == 40 and 0 <= score["score"] <= 100
    rows = killmatrix.mutants_per_test(kills, ["class_name", "test"]).filter("test = 0").collect()
    assert sorted(r["mutant"] for r in rows) == list(range(0, 40, 4)) and {r["killed_mutants"] for r in rows} == {10}


def test_missing_results_have_defaults(spark):
    originals = spark.createDataFrame([("C", "a", "pass"), ("C", "b", "java.lang.AssertionError: x"), ("C", "c", "pass")], "class_name string, test string, original_result string")
    results = spark.createDataFrame([("C", 1, "a", "pass"), ("C", 2, "a", "pass")], "class_name string, mutant int, test string, mutant_result string")
    runs = spark.createDataFrame([("C", 1, True, False, ""), ("C", 2, False, False, "lost"), ("C", 3, True, False, None)], "class_name string, mutant int, succeeded boolean, timed_out boolean, message string")
    out = killmatrix.with_kills(killmatrix.complete_results(originals, results, runs, 3000))
    got = {}
    for r in out.collect():
        key = (r["mutant"], r["original_result"] == "pass", r["mutant_result"], r["kills"])
        got[key] = got.get(key, 0) + r["tests"]
    assert got == {
        (1, True, "pass", False): 2, (1, False, "pass", True): 1,  # b is not reported, so it passes and kills
        (2, True, "worker_error: lost", False): 2, (2, False, "worker_error: lost", False): 1,
        (3, True, "worker_error", True): 2, (3, False, "worker_error", True): 1,
    }


def test_best_attempt_keeps_the_earlier_of_equals(spark):
    rows = [("m", i, "SURVIVED", False, True, True, False, 1, 5) for i in range(3)]
    df = spark.createDataFrame(rows, "mutant_id string, line_no long, target_status string, killed boolean, compile_success boolean, original_pass boolean, timed_out boolean, repair_rounds int, elapsed_ms long")
    assert trajectory.best_attempts(df).collect()[0]["line_no"] == 0


def test_control_dependence_of_a_branch(spark):
    # block 0 branches to 1 and 2; both meet in 3
    blocks = spark.createDataFrame([("m", 0, True, "x > 0", 10), ("m", 1, False, "", 11), ("m", 2, False, "", 12), ("m", 3, False, "", 13)], "method string, block int, tail_is_if boolean, cond string, line int")
    successors = spark.createDataFrame([("m", 0, 1), ("m", 0, 2), ("m", 1, 3), ("m", 2, 3)], "method string, block int, succ int")
    postdom = spark.createDataFrame([("m", 1, 1), ("m", 1, 3), ("m", 2, 2), ("m", 2, 3), ("m", 3, 3)], "method string, node int, dominator int")
    marks = spark.createDataFrame([("m", 1), ("m", 3)], "method string, node int")
    got = graph.control_dependence(blocks, successors, postdom, marks).collect()
    assert [(r["mark"], r["dependence"]) for r in got] == [(1, "If(x > 0) @10")]


def test_signature_agreement(spark):
    rows = [
        ("ok", "exact", "int Size(java.lang.String, int...)"), ("ok", "public", "int size(String,int[])"), ("ok", "public", "String extra()"),
        ("bad", "exact", "int size()"), ("bad", "exact", "void gone()"), ("bad", "public", "static long size()"), ("bad", "setup", "void init()"),
        ("none", "public", "int f()"), ("none", "setup", "int g()"), ("none", "public", "Box(int)"),
        ("twice", "public", "int f()"), ("twice", "public", "long f()"),
    ]
    got = {r["group_id"]: r for r in graph.signature_agreement(spark.createDataFrame(rows, "group_id string, list_kind string, raw string")).collect()}
    assert got["ok"]["status"] == "VERIFIED_STRICT" and got["none"]["status"] == "NOT_VERIFIED_NO_EXACT_SIGNATURES"
    assert got["bad"]["errors"] == ["PUBLIC_MISSING:gone()", "PUBLIC_RETURN:size()", "PUBLIC_STATIC:size()", "SETUP_NOT_PUBLIC:init()"]
    assert got["twice"]["status"] == "FAILED" and got["twice"]["errors"] == ["PUBLIC_CONFLICT:f()"] and got["none"]["public_methods"] == 1


def test_callee_resolution_prefers_constructor_then_file(spark):
    methods = spark.createDataFrame(
        [(1, True, "Box(int)", 1, 5, "a.Box", "Box"), (2, False, "run()", 1, 5, "a.Box", "Box"), (3, False, "run()", 1, 6, "a.Box", "Box"), (4, True, "Box(int)", 1, 6, "b.Box", "Box")],
        "method_id int, is_constructor boolean, signature string, variant_id int, file_id int, qualified_name string, type_simple_name string",
    )
    parameters = spark.createDataFrame([(1, "int"), (4, "int")], "method_id int, parameter_type string")
    calls = spark.createDataFrame(
        [(1, 1, 9, "b.Box", "Box", "Box(*)"), (2, 1, 6, "a.Box", "run", "run()"), (3, 1, 9, "a.Box", "run", "run()"), (4, 1, 9, "", "run", "run()"), (5, 1, 9, "c.Box", "", "Box(*)")],
        "call_id int, variant_id int, file_id int, callee_owner string, callee_method_name string, callee_signature string",
    )
    got = {r["call_id"]: (r["resolved_method_id"], r["resolved_by"]) for r in facts.resolve_callees(calls, methods, parameters).collect()}
    assert got == {1: (4, "CONSTRUCTOR"), 2: (3, "FILE"), 3: (2, "VARIANT"), 4: (None, "NONE"), 5: (1, "CONSTRUCTOR")}


def test_call_distance_stops_after_six_steps(spark):
    methods = spark.createDataFrame([(i, "T", f"m{i}", f"m{i}()", "void", False) for i in range(1, 10)], "method_id int, type_id string, name string, signature string, return_type string, is_constructor boolean")
    calls = spark.createDataFrame([(i + 1, i) for i in range(1, 9)] + [(1, 9), (3, 1)], "caller_method_id int, callee_method_id int")
    anchors = candidates.anchors_of(methods).filter("anchor_id = 1")
    got = {r["method_id"]: r["distance"] for r in candidates.call_distances(anchors, methods, calls).collect()}
    assert got == {1: 0, 2: 1, 3: 1, 4: 2, 5: 3, 6: 4, 7: 5, 8: 6}


def test_budget_keeps_required_first_and_cuts_the_rest(spark):
    df = spark.createDataFrame(
        [("d", [(1, 700, False, 0.5), (2, 600, True, 1.0), (3, 900, False, 0.5), (4, 5, False, 1.0)])],
        "doc_id string, sections array<struct<section_no:int,length:int,required:boolean,keep_ratio:double>>",
    )
    got = {r["section_no"]: r["kept"] for r in evidence.budgeted_sections(df, "sections", 2000).collect()}
    # 600 required, 700 fits, 700 left for 900: max(512, 350) = 512, then 5 fits
    assert got == {2: 600, 1: 700, 3: 512, 4: 5}


def test_index_match_takes_parts_from_the_id_and_skips_blanks(spark):
    parts = "project string, class_name string, method string, operator string"
    index = spark.createDataFrame([(1, "", "p", "C", "m()", "X_1"), (2, "", "", "", "", ""), (3, "p::D::m()::X_2", "p", "D", "m()", "X_2")], f"row_no long, mutant_id string, {parts}")
    records = spark.createDataFrame(
        [("a", "", "p", "C", "m()", "X_1"), ("b", "p::C::m()::X_1", "", None, "", ""), ("c", "", "", "", "", ""), ("d", "p::D::m()::X_2", None, None, None, None)],
        f"k string, mutant_id string, {parts}",
    ).withColumn("task_row", F.lit(2).cast("long"))
    got = {r["k"]: (r["index_row"], r["tier"]) for r in status_report.match_index(records, index).collect()}
    assert got == {"a": (1, 2), "b": (1, 2), "c": (None, 0), "d": (3, 1)}


def test_baseline_match_skips_blank_files_and_flags_several_keys(spark):
    index = spark.createDataFrame(
        [("p", "C", "m", "X_1", ""), ("q", "C", "m", "X_1", "f"), ("p", "D", "m", "X_1", "g")], "project string, class_name string, method string, mutant string, statistic_file string"
    )
    reported = spark.createDataFrame(
        [(1, "p", "C", "X_1", "g"), (2, "?", "?", "X_1", ""), (3, "?", "C", "X_1", ""), (4, "?", "?", "X_1", "f")],
        "report_id int, project string, class_name string, mutant string, statistic_file string",
    )
    got = sorted((r["report_id"], r["index_project"], r["tier"], r["ambiguous"]) for r in merge.match_baseline(reported, index).collect())
    assert got == [(1, "p", 1, False), (3, "p", 3, True), (3, "q", 3, True), (4, "q", 2, False)]


def test_mutants_without_results_are_live_and_unmarked_if_killed(spark):
    kills = spark.createDataFrame([(1, 5, True), (1, 5, False), (1, 6, None), (2, 5, False)], "mutant int, test int, kills boolean")
    mutants = spark.createDataFrame([(1,), (2,), (3,)], "mutant int")
    rows = killmatrix.mutant_verdicts(kills, ["mutant"], mutants)
    assert {r["mutant"]: (r["killed"], r["killing_tests"], r["tests_run"]) for r in rows.collect()} == {1: (True, [5], 2), 2: (False, [], 1), 3: (False, [], 0)}
    matrix = rows.select("mutant", F.size("killing_tests").alias("total"), (F.col("mutant") == 3).alias("equivalent"))
    marked = killmatrix.mark_equivalent_rows(matrix, mutants.filter("mutant < 3"), ["mutant"])
    assert {r["mutant"]: r["equivalent"] for r in marked.collect()} == {1: False, 2: True, 3: True}


def test_profiles_keep_all_for_unknown_actions(spark):
    items = spark.createDataFrame([(1, a, "entry", i) for a in ("COMPACT", "OTHER", None) for i in range(4)], "k int, action string, kind string, item_no int")
    kept = evidence.apply_profile(items, evidence.profile_table(spark), "k").groupBy("action").count().collect()
    assert {r["action"]: r["count"] for r in kept} == {"COMPACT": 1, "OTHER": 4, None: 4}
    rows = spark.createDataFrame([(a, s) for a in ("COMPACT", "ENTRY_HEAVY", None) for s in ("entryEvidence", "notes", "mutation")], "action string, section string")
    kept = rows.filter(evidence.keeps_section(F.col("action"), F.col("section"))).collect()
    assert sorted((r["action"] or "", r["section"]) for r in kept) == [
        ("", "entryEvidence"), ("", "mutation"), ("", "notes"), ("COMPACT", "mutation"), ("ENTRY_HEAVY", "entryEvidence"), ("ENTRY_HEAVY", "mutation"), ("ENTRY_HEAVY", "notes"),
    ]
