"""Steps whose rows must grow with their input, not with the square of a group."""

import pytest
from pyspark.sql import functions as F

from mutspan.operators import candidates as cd
from mutspan.operators import evidence
from mutspan.operators import facts as fc
from mutspan.operators import graph
from mutspan.operators import history as hs
from mutspan.plans import queries_functions, queries_io, queries_merge, views

METHODS = "method_id long, type_id string, name string, signature string, return_type string, visibility string, is_static boolean, is_constructor boolean, begin_line int, end_line int"
CALLS = "call_id long, caller_method_id long, callee_method_id long, callee_method_name string, line_number int"
ACCESSES = "access_id long, method_id long, field_id long, access_kind string, line_number int"
FIELDS = "field_id long, type_id string, field_name string, visibility string"


def most_rows(df):
    """Rows of the result, and the most rows that a step of its plan gave."""
    rows, most = df.collect(), 0
    todo = [df._jdf.queryExecution().executedPlan()]
    while todo:
        plan = todo.pop()
        kind = plan.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            todo.append(plan.executedPlan())
        elif kind.endswith("QueryStageExec"):
            todo.append(plan.plan())
        children = plan.children()
        todo += [children.apply(i) for i in range(children.size())]
        if plan.metrics().contains("numOutputRows"):
            most = max(most, plan.metrics().apply("numOutputRows").value())
    return [tuple(r) for r in rows], most


def one_type(spark, n):
    """Methods of one type and one name; each calls the next one, and so by name all of them."""
    kinds = ["public", "protected", "private", "package-private"]
    methods = [(i, "T", "m", f"m({i % 2})", "int" if i % 3 else "void", kinds[i % 4], False, i % 7 == 0, (i * 37) % 101, 0) for i in range(n)]
    calls = [(i, i, (i + 1) % n, "m", i) for i in range(n)]
    accesses = [(i * 2 + k, i, k, "READ" if (i + k) % 3 else "WRITE", (i * 11) % 17) for i in range(n) for k in (0, 1)]
    fields = [(k, "T", f"f{k}", "private") for k in (0, 1)]
    return [spark.createDataFrame(rows, schema).cache() for rows, schema in ((methods, METHODS), (calls, CALLS), (accesses, ACCESSES), (fields, FIELDS))]


def test_log_rows_meet_counted_artifacts(spark, tmp_path):
    n = 400
    line = [(i, 1, 5.0, 25 * i + 3, "R") for i in range(n)]
    spark.createDataFrame(line, "l_orderkey long, l_linenumber int, l_quantity double, l_suppkey long, l_returnflag string").write.parquet(str(tmp_path / "lineitem.parquet"))
    part = [(f"n{i:04}", 5, "Brand#3", "ECONOMY") for i in range(n)]
    spark.createDataFrame(part, "p_name string, p_size int, p_brand string, p_type string").write.parquet(str(tmp_path / "part.parquet"))
    rows, most = most_rows(queries_merge.log_artifacts(spark, str(tmp_path)))
    assert sorted(rows) == [(i * 10 + 1, n, "n0000") for i in range(n)]
    assert most <= 2 * n


def test_equal_targets_meet_the_references_together(spark):
    n = 300
    columns = "mutant_id string, project string, class_name string, method string, line string, operator string, observable string, entry_kind string, invocation string"
    targets = spark.createDataFrame([(f"M{i}", "p", "C", "m", "7", f"A_{i % 2}", "o", "e", "v") for i in range(n)], columns)
    refs = targets.withColumnRenamed("mutant_id", "ref_id").withColumns(
        {"test_name": F.concat(F.lit("T"), F.substring("ref_id", 2, 9)), "reward": (F.substring("ref_id", 2, 9).cast("int") % 5).cast("double")}
    )
    names = ["project", "class_name", "method", "line", *hs.TRAITS]
    rows, most = most_rows(hs._references_in_scope(targets, refs, "same_site", names, 2).select("mutant_id", "_p.ref_id"))
    best = [sorted((f"M{i}" for i in range(n) if i % 5 == 4 and i % 2 == k))[:3] for k in (0, 1)]
    assert sorted(rows) == sorted((f"M{i}", r) for i in range(n) for r in [r for r in best[i % 2] if r != f"M{i}"][:2])
    assert most <= 26 * n  # the references' own keys


def test_a_folder_takes_many_entries(spark, tmp_path, monkeypatch):
    n = 2000
    monkeypatch.setattr(queries_io, "shared_folder", lambda *_: str(tmp_path / "tree"))
    rows = [(i, i % 30, "OFP"[i % 3], "1-URGENT") for i in range(n)]
    spark.createDataFrame(rows, "o_orderkey long, o_custkey long, o_orderstatus string, o_orderpriority string").write.parquet(str(tmp_path / "orders.parquet"))
    got = queries_io.target_entry_files(spark, str(tmp_path)).select("row_no", "mutant", "origin").collect()
    assert sorted(tuple(r) for r in got) == [(i, f"M{i % 30}", "csv" if i // 50 % 4 == 3 else "json") for i in range(n)]
    assert len(list((tmp_path / "tree").glob("pile=*"))) == 4


@pytest.mark.parametrize("kind", ["live", "stored"])
def test_first_entries_pair_no_whole_type(spark, kind):
    n, keep = 200, 3
    methods, calls, _, _ = one_type(spark, n)
    anchors = cd.anchors_of(methods)
    if kind == "live":
        every, best = cd.live_entries(anchors, methods, calls), cd.best_live_entries(anchors, methods, calls, keep)
    else:
        distances = anchors.select("anchor_id", F.col("anchor_id").alias("method_id"), F.lit(0).alias("distance"))
        every, best = cd.entry_scores(anchors, methods, distances), cd.best_entries(anchors, methods, distances, keep)
    rows, most = most_rows(best.select("anchor_id", "method_id", "score"))
    want = {}
    for r in every.collect():
        want.setdefault(r.anchor_id, []).append((-r.score, r.begin_line, r.method_id))
    assert sorted(rows) == sorted((a, m, -s) for a, found in want.items() for s, _, m in sorted(found)[:keep])
    assert most <= 12 * n


def test_fallback_witnesses_need_first_entries_and_observables_only(spark):
    n = 120
    methods, calls, accesses, fields = one_type(spark, n)
    anchors = cd.anchors_of(methods)
    entries, spread = cd.live_entries(anchors, methods, calls, keep=2), fc.propagation_candidates(anchors, methods, accesses, fields, keep=2)
    assert entries.count() <= 8 * n and spread.count() <= 8 * n
    whole = cd.witness_fallback(cd.live_entries(anchors, methods, calls), cd.observables_fallback(anchors, fc.propagation_candidates(anchors, methods, accesses, fields)))
    some = cd.witness_fallback(entries, cd.observables_fallback(anchors, spread))
    assert sorted(map(tuple, some.collect())) == sorted(map(tuple, whole.collect()))


def test_a_line_meets_the_spans_near_it(spark):
    n = 400
    schema = "method_id long, variant_id int, type_simple_name string, name string, begin_line int, end_line int"
    spans = [(i, 1, "T", "m", 10 * i, 10 * i + (200 if i % 40 == 0 else 5)) for i in range(n)]
    methods = spark.createDataFrame([*spans, (n, 1, "T", "m", 30, 20), (n + 1, 1, "T", "m", None, 9)], schema)
    requests = spark.createDataFrame([(i, 1, "T", "m", 10 * (i % n) + i % 9) for i in range(2 * n)], "request_id long, variant_id int, type_simple_name string, name string, line int")
    rows, most = most_rows(fc.methods_by_line(requests, methods).select("request_id", "method_id"))
    want = {}
    for i in range(2 * n):
        line = 10 * (i % n) + i % 9
        found = sorted((end - begin, m) for m, _, _, _, begin, end in spans if begin <= line <= end)
        want.update({i: found[0][1]} if found else {})
    assert dict(rows) == want and len(rows) == len(want)
    assert most <= 24 * n


def test_rows_of_a_small_file_are_dealt_to_all_tasks(spark, tmp_path):
    parts = spark.createDataFrame([(i, "red ring", f"Brand#{i % 9}", i % 50) for i in range(100)], "p_partkey long, p_name string, p_brand string, p_size int")
    parts.coalesce(1).write.parquet(str(tmp_path / "part.parquet"))
    rows = queries_functions.row_signatures(spark, str(tmp_path))
    assert rows.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert rows.select("part").distinct().count() == 100


def test_direct_callers_by_name_leave_no_doubles_and_are_not_shuffled(spark):
    n = 60
    methods, calls, _, _ = one_type(spark, n)
    twice = methods.unionByName(methods.filter("method_id < 5")).unionByName(
        methods.filter("method_id = 7").withColumn("name", F.lit("k"))).unionByName(methods.filter("method_id = 9").withColumn("name", F.lit(None).cast("string")))
    only_id = spark.createDataFrame([(900, 1, 50, "other", 1)], CALLS)
    nameless = twice.filter("method_id <> 50").unionByName(methods.filter("method_id = 50").withColumn("name", F.lit(None).cast("string")))
    found = fc.direct_callers(cd.anchors_of(nameless), nameless, calls.unionByName(only_id))
    rows = [tuple(r) for r in found.collect()]
    want = {(a, m) for a in range(n) if a != 50 for m in range(n)} | {(50, 49), (50, 1)}
    assert len(rows) == len(set(rows)) and set(rows) == want
    plain = fc.direct_callers(cd.anchors_of(methods), methods, calls)
    plain.collect()
    written, todo = 0, [plain._jdf.queryExecution().executedPlan()]
    while todo:
        plan = todo.pop()
        kind = plan.getClass().getSimpleName()
        todo += [plan.executedPlan()] if kind == "AdaptiveSparkPlanExec" else [plan.plan()] if kind.endswith("QueryStageExec") else []
        todo += [plan.children().apply(i) for i in range(plan.children().size())]
        if kind == "ShuffleExchangeExec":
            written = max(written, plan.metrics().apply("shuffleRecordsWritten").value())
    assert written <= 4 * n


def most_shuffled(df):
    """Most records that one exchange of the plan sent, after a run without broadcasts."""
    spark = df.sparkSession
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = df.select("*")
        df.collect()
        most, todo = 0, [df._jdf.queryExecution().executedPlan()]
        while todo:
            plan = todo.pop()
            kind = plan.getClass().getSimpleName()
            if kind == "AdaptiveSparkPlanExec":
                todo.append(plan.executedPlan())
            elif kind.endswith("QueryStageExec"):
                todo.append(plan.plan())
            children = plan.children()
            todo += [children.apply(i) for i in range(children.size())]
            if plan.metrics().contains("shuffleRecordsWritten"):
                most = max(most, plan.metrics().apply("shuffleRecordsWritten").value())
        return most
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_live_entries_shuffle_their_sides_only(spark):
    n = 300
    methods, calls, _, _ = one_type(spark, n)
    entries = cd.live_entries(cd.anchors_of(methods), methods, calls)
    assert entries.count() > 200 * n
    assert 0 < most_shuffled(entries) <= cd.ANCHOR_PARTS * n


def test_live_entries_of_repeated_and_missing_keys(spark):
    rows = [
        (1, "T", "a"), (1, "U", "b"), (2, "T", "c"), (2, "T", "c"), (3, "T", "a"), (4, "U", "d"), (5, "T", None), (6, None, "a"), (None, "T", "a"), (7, "U", "a"), (7, "T", "e"),
    ]
    methods = spark.createDataFrame([(i, t, n, f"{n}()", "int", "public", False, False, k, 0) for k, (i, t, n) in enumerate(rows)], METHODS)
    calls = spark.createDataFrame([(1, 2, 1, "x", 1), (2, 4, None, "b", 1), (3, 3, 5, None, 1), (4, 3, 9, "c", 1), (5, 7, None, "a", 1), (6, None, 1, "a", 1), (7, 6, 1, "a", 1)], CALLS)
    anchors = cd.anchors_of(methods)
    callers = {tuple(r) for r in fc.direct_callers(anchors, methods, calls).collect()}
    found = cd.live_entries(anchors, methods, calls).select("anchor_id", "method_id", "begin_line", "score").collect()
    want = [
        (a, m, line, 60.0 + (120.0 if (a, m) in callers else 0.0))
        for a, t, _ in rows for line, (m, u, _) in enumerate(rows) if t is not None and t == u and None not in (a, m) and a != m
    ]
    assert sorted(map(tuple, found)) == sorted(want) and callers


def leaves_of_plan(df):
    """Inputs that the optimized plan reads, each as often as it is read."""
    return df._jdf.queryExecution().optimizedPlan().collectLeaves().size()


def test_observers_are_read_once(spark):
    methods = [(1, "T", "a", "a()", "int"), (2, "T", "b", "b()", "void"), (3, "T", "c", "c()", "void"), (3, "T", "c", "c()", "void"), (None, "T", "d", "d()", "void")]
    rows = [(i, t, n, s, r, "public", False, False, 1, 2) for i, t, n, s, r in methods]
    anchors = cd.anchors_of(spark.createDataFrame(rows, METHODS))
    best = spark.createDataFrame(
        [(1, 2, 40.0, "f", "STATE_EFFECT", "b()"), (2, 1, 45.0, "f", "STATE_EFFECT", "a()"), (2, 3, 300.0, "f", "STATE_EFFECT", "c()")],
        "anchor_id long, method_id long, priority double, field_name string, observer_kind string, observer_signature string",
    )
    found = cd.observable_candidates(anchors, best)
    assert leaves_of_plan(found) == 3
    seen, done = "PUBLIC_METHOD_DEPENDS_ON_MUTATED_STATE", "METHOD_COMPLETION"
    got = found.select("anchor_id", "method_id", "observable_kind", "observable_rank", "is_primary").collect()
    assert sorted(map(tuple, got), key=str) == sorted(
        [(1, 1, "RETURN_VALUE", 1, True), (1, 2, seen, 2, False), (2, 3, seen, 1, True), (2, 1, seen, 2, False), (3, 3, done, 1, True), (3, 3, done, 2, False), (None, None, done, 1, True)],
        key=str,
    )


def test_context_items_are_made_once_per_scope(spark):
    n = 150
    links = spark.createDataFrame([(i, 1) for i in range(n)] + [(0, 1), (0, 2), (None, 1), (n, None)], "mutant int, method int")
    calls = spark.createDataFrame([(1, i) for i in range(n)] + [(2, 7), (None, 8)], "method int, call_id int")
    named = spark.createDataFrame([(1, "m")], "method int, name string")
    found = cd.context_sections(links, {"calls": calls, "method": named}, "mutant", "method")
    rows = [tuple(r) for r in found.collect()]
    want = [(i, "calls", n, f'{{"call_id":{c}}}') for i in range(1, n) for c in range(n)] + [(i, "method", 1, '{"name":"m"}') for i in range(1, n)]
    want += [(0, "calls", 2 * n + 1, f'{{"call_id":{c}}}') for c in [*range(n), *range(n), 7]] + [(0, "method", 2, '{"name":"m"}')] * 2
    assert sorted(rows) == sorted(want)
    assert 0 < most_shuffled(found) <= 4 * n


def test_evidence_sums_are_stored_for_the_rows(spark):
    leaf = "id int, action string, section string, field string, field_no int, item_no int, member string, member_no int, sub_no int, text string, quoted boolean"
    leaves = spark.createDataFrame([(i, "ENTRY_HEAVY", "notes", "", 0, -1, "", -1, -1, " é\"" + "x" * 40000 * i, True) for i in range(3)], leaf)
    rows, levels = evidence.capped_evidence(leaves, "id")
    assert leaves_of_plan(levels) == 1 and leaves_of_plan(rows) == 4
    assert levels.count() == 3


def test_only_asked_statements_meet_the_branches(spark):
    n, marks = 60, 80
    blocks = spark.createDataFrame([(1, b, b < n, f"c{b}", b) for b in range(n + 2)], "method int, block int, tail_is_if boolean, cond string, line int")
    successors = spark.createDataFrame([(1, b, s) for b in range(n) for s in (n, n + 1)] * 2, "method int, block int, succ int")
    postdom = spark.createDataFrame([(1, n, 1000 + m) for m in range(marks)] + [(1, n + 1, 1000 + m) for m in range(1, marks)], "method int, node int, dominator int")
    asked = spark.createDataFrame([(1, 1000), (1, 1001), (1, 1001)], "method int, node int")
    found = graph.control_dependence(blocks, successors, postdom, asked)
    assert leaves_of_plan(found) == 4
    rows, most = most_rows(found)
    assert sorted(rows) == [(1, 1000, b, f"If(c{b}) @{b}") for b in range(n)]
    assert most <= 8 * n


def test_witnesses_need_no_second_look_at_the_observers(spark, monkeypatch):
    stored, keep = [], cd.cut_lineage
    monkeypatch.setattr(cd, "cut_lineage", lambda df: stored.append(df.columns) or keep(df))
    methods, calls, accesses, fields = one_type(spark, 12)
    chains = cd.derive_witnesses(methods, calls, accesses, fields)
    assert not [c for c in stored if "observer_signature" in c]
    assert leaves_of_plan(chains.select("anchor_id")) and chains.groupBy("anchor_id").count().filter("count > 5").isEmpty()
    own = chains.filter("entry_id = anchor_id AND observable_kind = 'PUBLIC_METHOD_DEPENDS_ON_MUTATED_STATE'").first()
    best = cd.best_observers(cd.field_observers(cd.anchors_of(methods), methods, accesses, fields))
    points = best.filter(f"anchor_id = {own.anchor_id} AND method_id = {own.observable_id}").first().priority
    entry = cd.entry_scores(cd.anchors_of(methods), methods, cd.anchors_of(methods).select("anchor_id", F.col("anchor_id").alias("method_id"), F.lit(0).alias("distance")), reached_only=True)
    score = entry.filter(f"anchor_id = {own.anchor_id}").first().score
    assert own.score == score + 140.0 + points + 100.0


def test_calls_come_from_one_reading_of_the_lines(spark, tmp_path):
    rows = [(o, n, 100 * o + n) for o in (1, 2) for n in range(60, 195) if (o, n) != (2, 128)] + [(1, 64, 7), (1, 65, None), (3, 1, None), (3, 2, 5), (3, 2, None), (None, 1, 8), (None, 2, 9), (4, None, 1), (4, 1, 2), (5, 0, 1), (5, -1, 3)]
    spark.createDataFrame(rows, "l_orderkey long, l_linenumber int, l_partkey long").write.parquet(str(tmp_path / "lineitem.parquet"))
    calls = views.v_calls(spark, str(tmp_path))
    assert leaves_of_plan(calls) == 1
    least = {}
    for o, n, p in rows:
        if None not in (o, n):
            least[o, n] = min(p, least.get((o, n)) or p) if p is not None else least.get((o, n))
    want = [(10 * o + n, p, least[o, n + 1] if (least[o, n + 1] or 0) % 7 else None) for (o, n), p in least.items() if (o, n + 1) in least]
    assert sorted(map(str, calls.select("call_id", "caller_method_id", "callee_method_id").collect())) == sorted(
        f"Row(call_id={c}, caller_method_id={p}, callee_method_id={q})" for c, p, q in want
    )


def test_ids_are_joined_for_anchors_without_a_name_only(spark):
    methods, calls, _, _ = one_type(spark, 20)
    assert leaves_of_plan(fc.direct_callers(cd.anchors_of(methods), methods, calls)) == 4
    stranger = cd.anchors_of(methods).filter("method_id = 3").withColumn("name", F.lit("other"))
    found = fc.direct_callers(cd.anchors_of(methods).unionByName(stranger.withColumns({"anchor_id": F.lit(4).cast("long")})), methods, calls.withColumn("callee_method_name", F.lit("x")))
    assert sorted(map(tuple, found.collect())) == sorted((a, m) for a in range(20) for m in range(20))
    apart = fc.direct_callers(stranger, methods, calls)
    assert [tuple(r) for r in apart.collect()] == [(3, 2)]


def test_stored_entries_shuffle_their_sides_only(spark):
    n = 300
    methods, calls, _, _ = one_type(spark, n)
    anchors = cd.anchors_of(methods)
    entries = cd.entry_candidates(anchors, methods, cd.call_distances(anchors, methods, calls))
    assert entries.count() > 200 * n
    assert 0 < most_shuffled(entries) <= 8 * n


@pytest.mark.parametrize("pairs", [1, 1 << 21])
def test_stored_entries_of_repeated_and_missing_keys(spark, monkeypatch, pairs):
    dealt = cd.dealt_by_type
    monkeypatch.setattr(cd, "dealt_by_type", lambda target, base, _, parts: dealt(target, base, pairs, parts))
    rows = [
        (1, "T", "a"), (1, "U", "b"), (2, "T", "c"), (2, "T", "c"), (3, "T", "a"), (4, "U", "d"), (5, "T", None), (6, None, "a"), (None, "T", "a"), (None, "U", "a"), (7, "U", "a"), (8, "T", "parse"),
    ]
    methods = spark.createDataFrame([(i, t, n, n and f"{n}()", "int" if k % 2 else "void", "public" if k % 3 else "protected", k % 4 == 0, k == 5, k, 0) for k, (i, t, n) in enumerate(rows)], METHODS)
    distances = spark.createDataFrame([(1, 2, 1), (2, 2, 0), (2, 2, 0), (3, 8, 3), (3, 1, 6), (None, 3, 1), (7, 4, 2), (7, None, 1)], "anchor_id long, method_id long, distance int")
    anchors = cd.anchors_of(methods)
    want = {}
    for r in cd.entry_scores(anchors, methods, distances).collect():
        want.setdefault(r.anchor_id, []).append((-r.score, r.begin_line, str(r.method_id), r.reasons))
    found = {}
    for r in cd.entry_candidates(anchors, methods, distances).orderBy("entry_rank").collect():
        found.setdefault(r.anchor_id, []).append((r.entry_rank, r.preferred, r.score, str(r.method_id), r.reasons))
    assert set(found) == set(want) and None in want
    for a, entries in want.items():
        assert [x[0] for x in found[a]] == [*range(1, len(entries) + 1)] and [x[1] for x in found[a]] == [True] + [False] * (len(entries) - 1)
        assert [x[2] for x in found[a]] == [-s for s, *_ in sorted(entries)]
        assert sorted(x[2:] for x in found[a]) == sorted((-s, m, why) for s, _, m, why in entries)


def test_live_entries_judge_a_name_once(spark):
    n = 300
    methods, calls, _, _ = one_type(spark, n)
    entries = cd.live_entries(cd.anchors_of(methods), methods, calls)
    assert "exists(" not in entries._jdf.queryExecution().optimizedPlan().toString()
    assert 0 < most_shuffled(entries) <= 2 * n


def large_shuffles(df, records):
    """Exchanges of the plan that sent more than so many records, after a run without broadcasts."""
    before = df.sparkSession.conf.get("spark.sql.autoBroadcastJoinThreshold")
    df.sparkSession.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = df.select("*")
        df.collect()
        found, todo = 0, [df._jdf.queryExecution().executedPlan()]
        while todo:
            plan = todo.pop()
            kind = plan.getClass().getSimpleName()
            todo += [plan.executedPlan()] if kind == "AdaptiveSparkPlanExec" else [plan.plan()] if kind.endswith("QueryStageExec") else []
            todo += [plan.children().apply(i) for i in range(plan.children().size())]
            found += kind == "ShuffleExchangeExec" and plan.metrics().apply("shuffleRecordsWritten").value() > records
        return found
    finally:
        df.sparkSession.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_readers_of_witnesses_are_shuffled_once(spark, monkeypatch):
    n, stored, keep = 40, [], cd.cut_lineage
    monkeypatch.setattr(cd, "cut_lineage", lambda df: stored.append(df) or keep(df))
    methods, calls, accesses, fields = one_type(spark, n)
    cd.derive_witnesses(methods, calls, accesses, fields)
    (rated,) = [df for df in stored if "observable_part" in df.columns]
    assert large_shuffles(rated, 10 * n) == 1
    assert rated.count() <= 8 * n  # five each, and those that are entries


def test_reader_points_are_those_of_the_best_observers(spark):
    rows = [(1, "T", "a()"), (1, "U", "a()"), (2, "T", "b()"), (2, "T", "b()"), (3, "T", None), (4, "U", "d()"), (5, None, "e()"), (None, "T", "f()"), (6, "T", "g()")]
    kinds = ["public", "protected", "private", "package-private", "public", None]
    methods = spark.createDataFrame([(i, t, "m", s, ["int", "void", None][k % 3], kinds[k % 6], False, False, k, 0) for k, (i, t, s) in enumerate(rows)], METHODS)
    touches = [(m, f, "READ" if (m or 0) + (f or 0) & 1 else "WRITE") for m in (1, 2, 3, 4, 5, 6, None) for f in (1, 2, None)] + [(1, 1, "WRITE"), (2, 1, None), (3, 1, "READ"), (3, 1, "WRITE")]
    accesses = spark.createDataFrame([(k, m, f, a, k) for k, (m, f, a) in enumerate(touches)], ACCESSES)
    fields = spark.createDataFrame([(1, "T", "f1", "private"), (1, "T", "f1", "private"), (2, "U", "f2", "public"), (None, "T", "f3", "public")], FIELDS)
    anchors = cd.anchors_of(methods)
    best = cd.best_observers(cd.field_observers(anchors, methods, accesses, fields)).select("anchor_id", "method_id", "observer_signature", "priority")
    found = fc.reader_points(anchors, methods, accesses, fields, cd._observing()[2])
    assert sorted(map(str, map(tuple, found.collect()))) == sorted(map(str, map(tuple, best.collect()))) and best.count() > 4


def test_fallback_observables_are_shuffled_once(spark):
    n = 40
    methods, _, accesses, fields = one_type(spark, n)
    anchors = cd.anchors_of(methods)
    found = cd.observables_fallback(anchors, fc.propagation_candidates(anchors, methods, accesses, fields))
    assert large_shuffles(found, 10 * n) == 1
