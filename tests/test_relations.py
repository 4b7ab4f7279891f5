"""Relations in linear size: two sides of all pairs, tries of paths."""

import random
from collections import Counter

from pyspark.sql import functions as F

from mutspan.operators import bicliques, facts, status_report

METHOD = "method_id long, type_id string, signature string, visibility string, return_type string, begin_line int"


def field_facts(spark, methods, touches):
    m = spark.createDataFrame([(i, "T", f"m{i}()", "private" if i % 7 == 0 else "public", "void" if i % 2 else "int", i) for i in range(methods)], METHOD)
    f = spark.createDataFrame([(i, "T", f"f{i}", "public") for i in range(3)], "field_id long, type_id string, field_name string, visibility string")
    x = spark.createDataFrame(touches, "method_id long, field_id long, access_kind string, line_number long")
    return m, x, f


def test_a_field_that_all_methods_touch_is_kept_in_linear_size(spark):
    n = 300
    touches = [(i, 0, "READ", i) for i in range(n)] + [(0, 1, "WRITE", 1), (5, None, "READ", 2)]
    m, x, f = field_facts(spark, n, touches)
    rows = bicliques.field_readers(m, x, f)
    assert rows.count() == n + (n - len(range(0, n, 7)))  # field 1 has no open reader and goes
    asked = spark.createDataFrame([(4,)], "anchor_id long")
    some = bicliques.field_reader_pairs(rows, asked)
    anchors = m.withColumnRenamed("method_id", "anchor_id")
    want = facts.propagation_candidates(anchors.join(asked, "anchor_id"), m, x, f)
    columns = ["anchor_id", "field_id", "method_id", "access_kind", "line_number", "score"]
    got = sorted(map(tuple, some.select(*columns).collect()))
    assert got == sorted(map(tuple, want.select(*columns).collect())) and len(got) > 200


def test_definitions_and_uses_unfold_to_edges(spark):
    rnd = random.Random(3)
    rows = [(rnd.randrange(3), rnd.randrange(4), rnd.choice(["def", "use"]), rnd.randrange(50)) for _ in range(200)]
    df = spark.createDataFrame(rows, "method int, variable int, kind string, stmt int")
    kept = bicliques.definitions_and_uses(df)
    want = {(a[0], a[1], a[3], b[3]) for a in rows for b in rows if a[:2] == b[:2] and (a[2], b[2]) == ("def", "use")}
    edges = bicliques.def_use_pairs(kept).select("method", "variable", "def_stmt", "use_stmt")
    assert Counter(map(tuple, edges.collect())) == Counter(want)
    asked = bicliques.def_use_pairs(kept, spark.createDataFrame([(1,)], "method int"))
    assert {r.method for r in asked.collect()} == {1} and kept.count() <= len(rows)


def test_trie_of_status_paths(spark):
    rnd = random.Random(2)
    paths = {f"m{i}": [rnd.choice("AB") for _ in range(rnd.randint(1, 6))] for i in range(60)}
    paths["long"] = [rnd.choice("AB") for _ in range(400)]
    rows = [(m, 10 * n, s) for m, path in paths.items() for n, s in enumerate(path)]
    log = spark.createDataFrame(rows, "mutant_id string, line_no long, target_status string").repartition(4)
    trie = status_report.status_trie(log, F.floor(F.col("line_no") / 100), block_records=7).cache()
    prefixes = Counter("".join(p[: k + 1]) for p in paths.values() for k in range(len(p)))
    ends = Counter("".join(p) for p in paths.values())
    assert trie.count() == len(prefixes)
    want = Counter((len(p), p[-1], n, ends[p]) for p, n in prefixes.items())
    assert Counter((r.depth, r.status, r.mutants, r.ending) for r in trie.collect()) == want
    short = trie.filter("ending > 0 and depth <= 6")
    steps = status_report.trie_paths(trie, short.select("node")).collect()
    found = {}
    for r in sorted(steps, key=lambda r: r.depth):
        found[r.node] = found.get(r.node, "") + r.status
    assert Counter(found.values()) == Counter(p for p in ends if len(p) <= 6)


def test_best_entries_equal_the_first_of_all(spark):
    from mutspan.operators import candidates

    rnd = random.Random(5)
    rows = []
    for i in range(120):
        kind = rnd.choice(["public", "protected", "package-private", "private"])
        rows.append((i, f"T{i % 2}", rnd.choice(["parse", f"m{i}", "m"]), f"m{i % 40}()", kind, "int", rnd.random() < 0.3, rnd.random() < 0.2, i % 11, i % 11 + 3))
    methods = spark.createDataFrame(
        rows, "method_id long, type_id string, name string, signature string, visibility string, return_type string, is_static boolean, is_constructor boolean, begin_line int, end_line int"
    )
    sites = [(n, rnd.randrange(120), rnd.choice([None, rnd.randrange(120)]), rnd.choice(["m", "m3", "x"])) for n in range(150)]
    calls = spark.createDataFrame(sites, "call_id long, caller_method_id long, callee_method_id long, callee_method_name string")
    anchors = candidates.anchors_of(methods)
    distances = candidates.call_distances(anchors, methods, calls).cache()
    place = lambda r: (r.anchor_id, r.entry_rank, r.method_id, r.score)
    for keep in (1, 4, 200):
        got = sorted(map(place, candidates.best_entries(anchors, methods, distances, keep).collect()))
        every = candidates.entry_candidates(anchors, methods, distances).filter(F.col("entry_rank") <= keep)
        assert got == sorted(map(place, every.collect()))
    live = {}
    for r in candidates.live_entries(anchors, methods, calls).collect():
        live.setdefault(r.anchor_id, []).append((-r.score, r.begin_line, r.method_id))
    want = sorted((a, n + 1, m, -s) for a, found in live.items() for n, (s, _, m) in enumerate(sorted(found)[:4]))
    assert sorted(map(place, candidates.best_live_entries(anchors, methods, calls, 4).collect())) == want
