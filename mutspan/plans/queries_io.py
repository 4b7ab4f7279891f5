"""Sources, sinks and streams: tables are written in each format and read back."""

from __future__ import annotations

from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from ..functions.attribution import Targets
from ..functions.text import safe
from ..operators import merge as mg
from ..operators import trajectory as tj
from ..operators import upserts as up
from ..operators.killmatrix import unpivot_matrix
from ..session import shared_folder
from ..sources import readers, schemas, sinks
from ..streaming import commits, jobs, mutants, rounds
from . import queries_facts, queries_history, queries_merge, queries_status
from . import views as v
from .registry import query
from .views import table


def _json_log(spark, sf):
    """The run log as JSON lines; part of the records use the older nested layout."""
    t = v.v_traj(spark, sf)
    old = F.col("k") % 3 == 0
    return t.select(
        F.col("line_no").alias("lineNo"), F.col("task_id").alias("taskId"), F.when(~old, F.col("mutant_id")).alias("mutantId"), "project", "operator",
        F.col("class_name").alias("className"), "method", "line", F.when(~old, F.col("outer_loop_round")).alias("outerLoopRound"), "action",
        F.when(~old, F.col("compile_success")).alias("compileSuccess"), F.when(~old, F.col("killed")).alias("killed"),
        F.when(~old, F.col("target_status")).alias("targetStatus"), F.col("repair_rounds").alias("repairRounds"), F.col("reward").alias("reward"),
        F.when(
            old,
            F.struct(
                F.col("mutant_id").alias("mutantId"), F.col("compile_success").alias("compiled"), "killed", F.col("target_status").alias("targetStatus"),
                F.struct(F.col("outer_loop_round").alias("outerLoopRound")).alias("evidenceState"),
            ),
        ).alias("stateAfter"),
    )


_LOG_SQL = "SELECT line_no, mutant_id, target_status, outer_loop_round, compile_success, killed, repair_rounds FROM v_traj"


def _log_columns(df):
    return df.select("line_no", "mutant_id", "target_status", "outer_loop_round", "compile_success", "killed", "repair_rounds")


@query("S4_S22_strict_log", _LOG_SQL, ("v_traj",))
def strict_log(spark, sf):
    path = shared_folder(spark, "log")
    sinks.append_json(_json_log(spark, sf), path)
    return _log_columns(readers.trajectory(spark, path, strict=True))


@query("S5_permissive_log", f"SELECT count(*) AS good, (SELECT count(*) FROM region) AS broken FROM ({_LOG_SQL})", ("v_traj",))
def permissive_log(spark, sf):
    path = shared_folder(spark, "log")
    sinks.append_json(_json_log(spark, sf), path)
    table(spark, sf, "region").select(F.concat(F.lit('{"lineNo": '), "r_name").alias("value")).write.mode("append").option("compression", "none").format("text").save(path)
    raw = readers.permissive_json(spark, path, schemas.TRAJECTORY)
    return raw.agg(F.count_if(F.col("_broken").isNull()).alias("good"), F.count_if(F.col("_broken").isNotNull()).alias("broken"))


@query("S6_feedback_log", "SELECT event_id, primary_fix, confidence, len(suspected_imports) AS imports FROM v_feedback WHERE analysed", ("v_traj", "v_feedback"))
def feedback_log(spark, sf):
    path = shared_folder(spark, "feedback")
    f = v.v_feedback(table(spark, sf, "events"), Targets())
    analysis = F.struct(
        F.col("failure_stage").alias("failureStage"), F.col("root_cause").alias("rootCauseType"), F.col("primary_fix").alias("primaryFixTarget"), "confidence",
        F.col("auto_repairable").alias("autoRepairable"), F.col("suspected_imports").alias("suspectedMissingImports"),
    )
    sinks.append_json(f.select(F.col("event_id").cast("string").alias("taskId"), F.col("mutant_id").alias("mutantId"), F.when(F.col("analysed"), analysis).alias("failureAnalysis")), path)
    back = readers.feedback(spark, path).filter("analysed")
    return back.select(F.col("task_id").cast("long").alias("event_id"), "primary_fix", "confidence", F.size("suspected_imports").cast("long").alias("imports"))


@query("S7_generation_log", "SELECT CAST(line_no AS VARCHAR) AS \"lineNo\", CASE WHEN compile_success THEN 'true' ELSE 'false' END AS compiled, method AS extra_key FROM v_traj", ("v_traj",))
def generation_log(spark, sf):
    path = shared_folder(spark, "results")
    t = v.v_traj(spark, sf)
    sinks.append_json(t.select(F.col("method").alias("extra_key"), F.col("compile_success").alias("compiled"), F.col("line_no").alias("lineNo")), path)
    return readers.generation_results(spark, path)


@query(
    "S8_suite_reports",
    "SELECT report_id // 100 AS report_no, count_if(killed OR live) AS mutants, count_if(killed) AS killed, count_if(live) AS live FROM v_suites GROUP BY 1 HAVING count_if(killed OR live) > 0",
    ("v_suites",),
)
def suite_reports(spark, sf):
    """A report per hundred rows, as JSON with another class key in half of them."""
    from ..operators.merge import suite_rows

    path = shared_folder(spark, "suite")
    name = F.col("report_id").cast("string")
    s = v.v_suites(spark, sf).groupBy(F.floor(F.col("report_id") / 100).alias("report_no")).agg(
        F.collect_list(F.when(F.col("killed"), name)).alias("k"), F.collect_list(F.when(F.col("live"), name)).alias("l")
    )
    even = F.col("report_no") % 2 == 0
    sinks.write_grouped_json(
        s.select(
            F.when(even, F.col("report_no").cast("string")).alias("targetClassName"), F.when(~even, F.col("report_no").cast("string")).alias("className"),
            F.col("k").alias("suiteKilledMutants"), F.col("l").alias("suiteLiveMutants"),
        ),
        path,
    )
    # report files hold one object each; here one file holds many, one per line
    reports = readers.shape_suite_reports(spark.read.schema(schemas.SUITE_REPORT).json(path))
    rows = suite_rows(reports.withColumn("report_no", F.col("class_name").cast("long")))
    return rows.groupBy("report_no").agg(F.count(F.lit(1)).alias("mutants"), F.count_if("killed").alias("killed"), F.count_if("live").alias("live"))


@query("S9_S10_target_entries", "SELECT row_no, mutant, test_set_name, mapping_status, compiled FROM v_entries", ("v_entries",))
def target_entries(spark, sf):
    """Entries of even classes as JSON arrays, all others as quoted CSV."""
    root = shared_folder(spark, "entries")
    e = v.v_entries(spark, sf)
    shaped = e.select(
        F.col("row_no").cast("string").alias("rowIndex"), F.col("project").alias("projectName"), F.concat(F.lit('quoted ", '), "class_name").alias("targetClassName"), F.col("method").alias("methodSignature"),
        F.col("mutant").alias("mutantName"), F.col("test_set_name").alias("testSetName"), F.col("compiled").cast("string").alias("compiled"), F.col("mapping_status").alias("mappingStatus"), "class_name",
    )
    as_json = F.substring("class_name", -1, 1).isin("0", "2", "4", "6", "8")
    arrays = shaped.filter(as_json).withColumn("pile", F.floor(F.col("rowIndex").cast("long") / 200))
    body = [c for c in shaped.columns if c != "class_name"]
    lists = arrays.groupBy("pile").agg(F.collect_list(F.struct(*body)).alias("entries"))
    sinks.write_grouped_json(lists.select("entries"), f"{root}/json")
    shaped.filter(~as_json).drop("class_name").write.option("header", True).option("quote", '"').option("escape", '"').csv(f"{root}/csv")
    text = spark.read.text(f"{root}/json")
    item = f"array<struct<{schemas.TARGET_ENTRY.replace(' string', ':string')}>>"
    from_json = text.select(F.explode(F.from_json(F.get_json_object("value", "$.entries"), item)).alias("e")).select("e.*")
    from_csv = readers.quoted_csv(spark, f"{root}/csv")
    columns = ["rowIndex", "mutantName", "testSetName", "mappingStatus", "compiled"]
    both = from_json.select(*columns).unionByName(from_csv.select(*columns))
    return both.select(
        F.col("rowIndex").cast("long").alias("row_no"), F.col("mutantName").alias("mutant"), F.col("testSetName").alias("test_set_name"), safe("mappingStatus").alias("mapping_status"),
        F.col("compiled").cast("boolean").alias("compiled"),
    )


@query("S11_delimited_log", "SELECT user_id, project, method, CASE WHEN user_id % 2 = 0 THEN operator ELSE '' END AS operator FROM (SELECT DISTINCT user_id, project, method, operator FROM v_traj)", ("v_traj",))
def delimited_log(spark, sf):
    path = shared_folder(spark, "hashlog")
    rows = v.v_traj(spark, sf).select("user_id", "project", "method", "operator").distinct()
    line = F.when(F.col("user_id") % 2 == 0, F.concat_ws("####", F.col("user_id").cast("string"), "project", "method", "operator")).otherwise(
        F.concat_ws("####", F.col("user_id").cast("string"), "project", "method")
    )
    rows.select(line.alias("value")).write.text(path)
    return readers.delimited_log(spark, path, ["user_id", "project", "method", "operator"]).withColumn("user_id", F.col("user_id").cast("long"))


_STAT_SQL = """SELECT file_no, count_if(killed) AS killed, count_if(NOT killed) AS live, count(*) AS mutants, sum(n) AS killing_tests, round(count_if(killed) / count(*), 6) AS mutant_score
FROM (SELECT mutant // 50 AS file_no, mutant, bool_or(kills) AS killed, count(DISTINCT CASE WHEN kills THEN test END) AS n FROM v_matrix GROUP BY ALL) GROUP BY 1"""


def _statistic_texts(spark, sf):
    """Kill-statistic texts of fifty mutants each; every second one leaves its lists empty."""
    per_mutant = v.v_matrix(spark, sf).groupBy("mutant").agg(F.collect_set(F.when(F.col("kills"), F.concat(F.lit("T"), F.col("test").cast("string"), F.lit("#t")))).alias("tests"))
    named = per_mutant.select(F.floor(F.col("mutant") / 50).alias("file_no"), F.concat(F.lit("AOIS_"), F.col("mutant").cast("string")).alias("name"), "tests")
    grouped = named.groupBy("file_no").agg(
        F.array_join(F.collect_list(F.concat("name", F.lit("="), F.array_join("tests", ", "))), ", ").alias("map"),
        F.array_join(F.collect_list(F.when(F.size("tests") > 0, F.col("name"))), ", ").alias("killed"),
        F.array_join(F.collect_list(F.when(F.size("tests") == 0, F.col("name"))), ", ").alias("live"),
        (F.count_if(F.size("tests") > 0) / F.count(F.lit(1))).alias("score"),
    )
    listed = F.col("file_no") % 2 == 0
    text = F.concat(
        F.lit("test_results={};\nmutant_results={"), "map", F.lit("};\nkilled_mutants=["), F.when(listed, F.col("killed")).otherwise(F.lit("")), F.lit("];\nlive_mutants=["),
        F.when(listed, F.col("live")).otherwise(F.lit("")), F.lit("];\nmutant_score="), F.col("score").cast("string"), F.lit(";\n"),
    )
    return grouped.select("file_no", text.alias("value"), "killed")


@query("S12_kill_statistics", _STAT_SQL, ("v_matrix",))
def kill_statistics(spark, sf):
    parsed = readers.parse_kill_statistics(_statistic_texts(spark, sf).select("file_no", "value"))
    return parsed.select(
        "file_no", F.size("killed_mutants").cast("long").alias("killed"), F.size("live_mutants").cast("long").alias("live"), F.size("mutant_results").cast("long").alias("mutants"),
        F.aggregate(F.map_values("mutant_results"), F.lit(0).cast("long"), lambda a, x: a + F.size(x)).alias("killing_tests"), F.round("mutant_score", 6).alias("mutant_score"),
    )


@query("S13_killed_list", "SELECT file_no, CASE WHEN file_no % 2 = 0 THEN killed ELSE 0 END AS listed, killed AS bare FROM " + f"({_STAT_SQL})", ("v_matrix",))
def killed_list(spark, sf):
    t = _statistic_texts(spark, sf)
    bare = F.concat(F.lit("\nhead=1\n"), "killed", F.lit("];\n"))
    return t.select("file_no", F.size(readers.killed_list(F.col("value"))).cast("long").alias("listed"), F.size(readers.killed_list(bare)).cast("long").alias("bare"))


@query("S14_matrix_file", "SELECT 'M' || p_brand AS mutant, 't' || s AS test, bool_or(p_size % 5 = s) AS kills FROM part, (SELECT unnest([0, 1, 2, 3, 4]) AS s) GROUP BY ALL")
def matrix_file(spark, sf):
    path = shared_folder(spark, "matrix")
    size = F.col("p_size") % 5
    wide = table(spark, sf, "part").groupBy(F.concat(F.lit("M"), "p_brand").alias("Mutant")).agg(
        *[F.when(F.bool_or(size == i), F.lit(" 1")).otherwise(F.lit("")).alias(f"t{i}") for i in range(5)], F.count(F.lit(1)).alias("Total"), F.lit("n").alias("Equiv?")
    )
    wide.write.option("header", True).csv(path)
    return unpivot_matrix(readers.result_matrix(spark, path)).select("mutant", "test", "kills")


@query("S15_S16_artifact_listing", "SELECT source, count(*) AS files FROM documents WHERE lower(source) <> 'src1' GROUP BY 1")
def artifact_listing(spark, sf):
    """File paths from the document table: listing rules without a file tree."""
    d = table(spark, sf, "documents")
    folder = F.when(F.col("source") == "src1", F.lit("Test")).otherwise(F.lit("main"))
    files = d.select(F.concat(F.lit("file:/data/root/"), folder, F.lit("/"), "source", F.lit("/F"), F.col("doc_id").cast("string"), F.lit(".java")).alias("path"), "source")
    return readers.without_excluded(files, "/data/root").groupBy("source").agg(F.count(F.lit(1)).alias("files"))


@query(
    "S1_index_file",
    """
SELECT 'f' || row_no AS file_path, operator, CASE WHEN row_no % 4 = 0 THEN -1 ELSE CAST(row_no AS INT) END AS line, method, class_name, project,
  CASE WHEN row_no % 3 = 0 THEN 'a "quoted", text' || chr(10) || 'of two lines' ELSE '' END AS mutation_statement, CASE WHEN row_no % 2 = 0 THEN 'y' ELSE '' END AS is_killed FROM v_index""",
    ("v_traj", "v_index"),
)
def index_file(spark, sf):
    """An index file with other header names, number forms, quoted lines and blank rows, read by the index reader."""
    path, row = shared_folder(spark, "index"), F.col("row_no")
    line = F.when(row % 4 == 0, "n/a").when(row % 4 == 1, F.concat(row.cast("string"), F.lit(".0"))).otherwise(row.cast("string"))
    index = v.v_index(v.v_traj(spark, sf)).select(
        F.concat(F.lit("f"), row.cast("string")).alias("File_Path"), F.col("operator").alias(" OPERATOR"), line.alias("Line_Number"), F.col("method").alias("method"),
        F.col("class_name").alias("Class"), F.col("project").alias("Project"), F.when(row % 3 == 0, 'a "quoted", text\nof two lines').alias("mutation_statement"),
        F.when(row % 2 == 0, "y").alias("is_kille"), F.lit("x").alias("unknown column"),
    )
    blank = index.select(*[F.lit(" ").alias(c) for c in index.columns])
    index.unionByName(blank).write.option("header", True).option("quote", '"').option("escape", '"').option("quoteAll", True).csv(path)
    return readers.mutant_index(spark, path).select("file_path", "operator", "line", "method", "class_name", "project", "mutation_statement", "is_killed")


@query(
    "S2_positional_index_file",
    "SELECT operator, method, class_name, project, 'f' || row_no AS file_path FROM v_index WHERE row_no % 5 <> 0 AND project IN ('proj1', 'proj2')",
    ("v_traj", "v_index"),
)
def positional_index_file(spark, sf):
    """An index file read by position, whatever its header says; rows without a full key and other projects go."""
    path, row = shared_folder(spark, "index"), F.col("row_no")
    values = {
        "operator": F.when(row % 5 != 0, F.col("operator")).otherwise(F.lit("  ")), "method": F.col("method"), "class_name": F.col("class_name"),
        "project": F.col("project"), "file_path": F.concat(F.lit("f"), row.cast("string")),
    }
    columns = [values.get(n, F.lit("")).alias(f"column {i}") for i, n in enumerate(readers.INDEX_HEADERS)]
    v.v_index(v.v_traj(spark, sf)).select(*columns).write.option("header", True).option("quoteAll", True).csv(path)
    return readers.positional_index(spark, path, ["proj1", "proj2"]).select("operator", "method", "class_name", "project", "file_path")


@query(
    "S9_target_entry_files",
    """
SELECT row_no, mutant, test_set_name, mapping_status, compiled, CASE WHEN row_no // 50 % 4 = 3 THEN 'csv' ELSE 'json' END AS origin FROM v_entries""",
    ("v_entries",),
)
def target_entry_files(spark, sf):
    """Fifty entries are of one kind: an array alone or under one of two names, with a CSV that must not be read; every fourth kind is a CSV only.

    A folder takes fifty lots of one kind: files far smaller than that cost more than their entries.
    """
    root = shared_folder(spark, "entries")
    lot = F.floor(F.col("row_no") / 50)
    e = v.v_entries(spark, sf).withColumn("pile", F.floor(lot / 200) * 4 + lot % 4)
    fields = {
        "rowIndex": F.col("row_no").cast("string"), "projectName": F.col("project"), "targetClassName": F.concat(F.lit('quoted ", '), "class_name"), "methodSignature": F.col("method"),
        "mutantName": F.col("mutant"), "testSetName": F.col("test_set_name"), "compiled": F.col("compiled").cast("string"), "mappingStatus": F.col("mapping_status"),
    }
    shaped = e.select("pile", *[c.alias(n) for n, c in fields.items()])
    kind = F.col("pile") % 4
    entry = lambda origin: F.struct(*[F.col(n) for n in fields if n != "projectName"], F.lit(origin).alias("projectName"))
    lists = shaped.filter(kind != 3).groupBy("pile").agg(F.to_json(F.collect_list(entry("json"))).alias("list"))
    named = lambda name: F.concat(F.lit(f'{{"other": 1, "{name}": '), "list", F.lit("}"))
    text = F.when(kind == 0, F.col("list")).when(kind == 1, named(readers.ENTRY_ARRAYS[0])).otherwise(named(readers.ENTRY_ARRAYS[2]))
    lists.select("pile", text.alias("value")).write.partitionBy("pile").mode("append").text(root)
    columns = [F.lit("csv").alias(n) if n == "projectName" else F.col(n) for n in fields]
    csv = shaped.select("pile", *columns).repartition("pile").write.partitionBy("pile").mode("append")
    csv.option("header", True).option("quote", '"').option("escape", '"').csv(root)
    back = readers.target_entries(spark, f"{root}/*/*.txt", f"{root}/*/*.csv")
    return back.select(
        F.col("rowIndex").cast("long").alias("row_no"), F.col("mutantName").alias("mutant"), F.col("testSetName").alias("test_set_name"), safe("mappingStatus").alias("mapping_status"),
        F.col("compiled").cast("boolean").alias("compiled"), F.col("projectName").alias("origin"),
    )


def _artifact_tree(spark, sf):
    """Files of documents: a folder per place and source, one JSON and one text file in each."""
    root = shared_folder(spark, "tree")
    d = table(spark, sf, "documents").select("doc_id", F.concat(F.lit("s"), F.coalesce("source", F.lit(""))).alias("source")).repartition("source")
    for i, place in enumerate(["main", "Test", "llm/deep", "src/evosuite-like"]):
        part = d.filter(F.col("doc_id") % 4 == i)
        part.write.partitionBy("source").json(f"{root}/{place}")
        part.select("source", F.col("doc_id").cast("string").alias("value")).write.partitionBy("source").text(f"{root}/{place}/texts")
    return root


_TREE_SQL = "SELECT DISTINCT ['main', 'Test', 'deep', 'evosuite-like'][doc_id % 4 + 1] AS place, 's' || coalesce(source, '') AS source FROM documents"


@query("S15_artifact_files", f"SELECT place, source, 1::BIGINT AS files, true AS filled FROM ({_TREE_SQL})")
def artifact_files(spark, sf):
    """JSON files that exist under a tree: a scan of names and lengths, by suffix."""
    found = readers.artifacts(spark, _artifact_tree(spark, sf), "*.json")
    parts = F.regexp_extract("path", r"/([^/]+)/source=([^/]*)/[^/]+$", 1), F.regexp_extract("path", r"/source=([^/]*)/[^/]+$", 1)
    rows = found.select(parts[0].alias("place"), parts[1].alias("source"), "length")
    return rows.groupBy("place", "source").agg(F.count(F.lit(1)).alias("files"), F.min(F.col("length") > 0).alias("filled"))


@query("S16_source_tree", f"SELECT source, count(*) AS files FROM ({_TREE_SQL}) WHERE place IN ('main', 'evosuite-like') GROUP BY 1")
def source_tree(spark, sf):
    """JSON files outside of folders with an excluded name, at any depth."""
    found = readers.source_files(spark, _artifact_tree(spark, sf), ".json")
    return found.groupBy(F.regexp_extract("path", r"/source=([^/]*)/[^/]+$", 1).alias("source")).agg(F.count(F.lit(1)).alias("files"))


@query(
    "S20_chunked_export",
    "SELECT count(*) AS rows, CAST(sum(o_orderkey) AS BIGINT) AS key_sum, true AS all_small, true AS enough_files FROM orders",
)
def chunked_export(spark, sf):
    """An export with a row limit, read back with the row count of every file."""
    root = shared_folder(spark, "chunks")
    sinks.write_chunked_csv(table(spark, sf, "orders").select("o_orderkey", "o_orderstatus"), root, 700)
    back = readers.quoted_csv(spark, root)
    per_file = back.groupBy(F.col("_metadata.file_path").alias("f")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("o_orderkey").cast("long")).alias("k"))
    return per_file.agg(
        F.sum("n").alias("rows"), F.sum("k").alias("key_sum"), (F.max("n") <= 700).alias("all_small"), (F.count(F.lit(1)) * 700 >= F.sum("n")).alias("enough_files")
    )


@query(
    "S21_grouped_failures",
    """
SELECT class_name || '::' || method AS group_key, class_name, count(*) AS mutants, CAST(count_if(compiled) AS BIGINT) AS java_exists, CAST(count_if(original_passed) AS BIGINT) AS error_exists, CAST(count_if(mutant_executed) AS BIGINT) AS graph_exists,
  arg_min(mutant, CASE WHEN compiled AND original_passed THEN 0 ELSE 1000000000 END + row_no) AS representative,
  array_to_string(list_slice(list(row_no || '=' || mutant ORDER BY row_no), 1, 4), ',') AS members, count(*) - least(4, count(*)) AS omitted, true AS small_file FROM v_entries GROUP BY class_name, method""",
    ("v_entries",),
)
def grouped_failures(spark, sf):
    """Nested failure groups written twenty to a file and read back."""
    root = shared_folder(spark, "failures")
    rows = v.v_entries(spark, sf).select(
        "class_name", "method", "mutant", "row_no", F.col("compiled").alias("java_exists"), F.col("compiled").alias("class_exists"),
        F.col("original_passed").alias("error_exists"), F.col("mutant_executed").alias("graph_exists"),
    )
    sinks.write_grouped_json(mg.nested_failures(rows, 4, ["class_name", "method"]), root, 20)
    back = readers.grouped_failures(spark, root)
    sizes = back.groupBy("file_path").agg((F.count(F.lit(1)) <= 20).alias("small_file"))
    members = F.array_join(F.transform("mutants", lambda m: F.concat_ws("=", m["rowIndex"].cast("string"), m["operator"])), ",")
    return back.join(sizes, "file_path").select(
        F.col("groupKey").alias("group_key"), F.col("className").alias("class_name"), F.col("stats.mutantCount").alias("mutants"), F.col("stats.javaExistsCount").alias("java_exists"),
        F.col("stats.selectedCompileErrorExistsCount").alias("error_exists"), F.col("stats.graphExistsCount").alias("graph_exists"), F.col("representative.operator").alias("representative"),
        members.alias("members"), F.col("omittedMutantCount").alias("omitted"), "small_file",
    )


@query("S17_timing_lines", "SELECT event_type AS phase, count(*) AS events, sum(CAST(floor(value * 100) AS BIGINT)) AS total_ms FROM events GROUP BY 1")
def timing_lines(spark, sf):
    path = shared_folder(spark, "timing")
    e = table(spark, sf, "events")
    line = F.concat(F.lit("[TIME] phase="), "event_type", F.lit(" elapsedMs="), F.floor(F.col("value") * 100).cast("string"), F.lit(" detail of "), F.col("event_id").cast("string"))
    e.select(line.alias("value")).write.text(path)
    return readers.phase_times(readers.timing_lines(spark, path)).drop("mean_ms")


@query("S18_run_summary", "SELECT o_orderkey AS row_no, CAST(o_orderkey % 3 AS INT) AS exit_code, CAST(floor(o_totalprice) AS BIGINT) AS duration_ms, o_orderstatus AS status FROM orders")
def run_summary(spark, sf):
    path = shared_folder(spark, "summary")
    o = table(spark, sf, "orders")
    rows = o.select(
        F.col("o_orderkey").alias("row_no"), (F.col("o_orderkey") % 3).cast("int").alias("exit_code"), F.floor("o_totalprice").cast("long").alias("duration_ms"), F.col("o_orderstatus").alias("status"),
        F.lit("out").alias("output"), F.lit("").alias("message"),
    )
    sinks.write_tsv(rows, path)
    return readers.run_summary(spark, path).select("row_no", "exit_code", "duration_ms", "status")


@query("S19_S20_report_csv", "SELECT mutant, killed_ever, final_kill FROM (SELECT mutant, bool_or(killed) AS killed_ever, CASE WHEN bool_or(killed) THEN 'KILLED' WHEN bool_or(live) THEN 'LIVE' ELSE 'NOT_REPORTED' END AS final_kill FROM v_suites GROUP BY 1)", ("v_suites",))
def report_csv(spark, sf):
    root = shared_folder(spark, "report")
    d = queries_merge._details(spark, sf)
    sinks.write_report_csv(d, f"{root}/sorted", ["project", "class_name", "method", "mutant"])
    sinks.write_chunked_csv(readers.quoted_csv(spark, f"{root}/sorted"), f"{root}/chunked", 500)
    back = readers.quoted_csv(spark, f"{root}/chunked")
    return back.select("mutant", F.col("killed_ever").cast("boolean").alias("killed_ever"), "final_kill")


@query("S23_tables", "SELECT 'methods' AS name, count(*) AS rows FROM v_methods UNION ALL SELECT 'types', count(*) FROM v_types", ("v_methods", "v_types"))
def tables(spark, sf):
    root = shared_folder(spark, "facts")
    sinks.write_tables({"methods": v.v_methods(spark, sf), "types": v.v_types(spark, sf)}, root, {"methods": ["visibility"]})
    counts = [spark.read.parquet(f"{root}/{n}").agg(F.count(F.lit(1)).alias("rows")).select(F.lit(n).alias("name"), "rows") for n in ("methods", "types")]
    return counts[0].unionByName(counts[1])


# --- streams ---------------------------------------------------------------------------
def _event_stream(spark, sf):
    return v.traj_of(jobs.table_stream(spark, sf, "events", table(spark, sf, "events")))


def _run(query_):
    query_.awaitTermination()
    if query_.exception():
        raise query_.exception()


@query("T1_T6_streamed_log", _LOG_SQL, ("v_traj",))
def streamed_log(spark, sf):
    """Log folder as a stream, in many small batches, through the append sink."""
    root = shared_folder(spark, "stream")
    _json_log(spark, sf).repartition(6).write.json(f"{root}/in")
    rows = jobs.json_stream(spark, f"{root}/in", schemas.TRAJECTORY, files_per_batch=2)
    for _ in range(2):  # the second start resumes from the checkpoint and finds nothing new
        _run(jobs.append_rows(rows, f"{root}/out", f"{root}/checkpoint"))
    return _log_columns(readers.trajectory(spark, f"{root}/out"))


@query(
    "T2_streamed_mutant_state",
    "SELECT mutant_id, arg_max(target_status, line_no) AS last_status, max(line_no) AS last_line_no, bool_or(killed) AS killed_ever FROM v_traj GROUP BY 1",
    ("v_traj",),
)
def streamed_mutant_state(spark, sf):
    root = shared_folder(spark, "stream")
    _run(jobs.write_updates(jobs.mutant_state(_event_stream(spark, sf)), f"{root}/out", f"{root}/checkpoint"))
    return jobs.read_state(spark, f"{root}/out", ["mutant_id"])


@query("T3_streamed_feedback", queries_facts.M7_SQL, ("v_traj", "v_feedback"))
def streamed_feedback(spark, sf):
    root = shared_folder(spark, "stream")
    events = jobs.table_stream(spark, sf, "events", table(spark, sf, "events"))
    rows = queries_facts.event_rows(v.v_feedback(events, Targets()))
    _run(jobs.write_updates(jobs.feedback_state(rows), f"{root}/out", f"{root}/checkpoint"))
    return queries_facts.event_columns(jobs.read_state(spark, f"{root}/out", up.EVENT_KEY))


@query("T4_streamed_bandit", "SELECT coarse_key, action, count(*) AS samples, CAST(sum(elapsed_ms) AS DOUBLE) AS reward_sum FROM v_traj GROUP BY ALL", ("v_traj",))
def streamed_bandit(spark, sf):
    root = shared_folder(spark, "stream")
    log = _event_stream(spark, sf).withColumn("reward", F.col("elapsed_ms").cast("double"))
    _run(jobs.write_updates(jobs.bandit_state(log, "coarse_key"), f"{root}/out", f"{root}/checkpoint"))
    return jobs.read_state(spark, f"{root}/out", ["coarse_key", "action"])


@query("T4_streamed_linear", queries_history.LINEAR_SQL, ("lin_log",))
def streamed_linear(spark, sf):
    qh = queries_history
    root = shared_folder(spark, "stream")
    source = jobs.table_stream(spark, sf, "embeddings", table(spark, sf, "embeddings"))
    rows = qh.bd.policy_rows(qh.linear_rows(source))
    _run(jobs.write_updates(rows, f"{root}/out", f"{root}/checkpoint", "append", jobs.linear_update(qh.DIM)))
    return jobs.summed_linear_state(spark, f"{root}/out", 1.0).withColumn("value", F.round("value", 6))


@query("T5_streamed_loop_statistics", queries_status.ROUND_SQL, ("v_traj",))
def streamed_loop_statistics(spark, sf):
    root = shared_folder(spark, "stream")
    by = ["run_id", "outer_loop_round"]
    _run(jobs.write_updates(jobs.task_state(_event_stream(spark, sf), by), f"{root}/out", f"{root}/checkpoint"))
    return tj.loop_statistics(jobs.read_state(spark, f"{root}/out", [*by, "task_id"]), by)


def _in_batches(spark, rows, batch, count):
    """A folder with one file per micro-batch, in batch order; batch numbers the rows from 0."""
    path = f"{shared_folder(spark, 'batches')}/in"
    numbered = rows.withColumn("_batch", batch)
    for i in range(count):
        numbered.filter(F.col("_batch") == i).drop("_batch").coalesce(1).write.mode("append").parquet(path)
    return path


def _stream_of(spark, path, like):
    return jobs.parquet_stream(spark, path, like, files_per_batch=1)


def _timed(log):
    """The log with its times as instants, whatever zone the session has."""
    since = "timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', generated_at)"
    return log.withColumn("generated_at", F.timestamp_micros(F.expr(since)))


def _five_days():
    """Micro-batch of an event: five days of the month each."""
    return F.least(F.lit(5), F.floor((F.dayofmonth("ts") - 1) / 5)).cast("int")


@query(
    "T2_expiring_mutant_state",
    "SELECT mutant_id, arg_max(target_status, line_no) AS last_status, max(line_no) AS last_line_no, bool_or(killed) AS killed_ever FROM v_traj GROUP BY 1",
    ("v_traj",),
)
def expiring_mutant_state(spark, sf):
    """Six micro-batches; killed mutants leave the state after a day without records."""
    events = table(spark, sf, "events")
    stream = _timed(v.traj_of(_stream_of(spark, _in_batches(spark, events, _five_days(), 6), events)))
    root = shared_folder(spark, "stream")
    statuses = mutants.mutant_status(stream, "generated_at", "1 hour", 86_400_000)
    _run(jobs.write_updates(statuses, f"{root}/out", f"{root}/checkpoint", state_store=mutants.STATE_STORE))
    return mutants.read_mutant_status(spark, f"{root}/out")


@query(
    "T5_closed_rounds",
    """
WITH rows AS (
  SELECT *, date_trunc('day', generated_at) AS day, user_id % 50 = 0 AND day(generated_at) <= 10 AS missed FROM v_traj
), latest AS (
  SELECT *, target_status IN ('KILLED', 'SURVIVED', 'ORIGINAL_FAILED') AS e FROM (
    SELECT *, row_number() OVER (PARTITION BY day, run_id, outer_loop_round, task_id ORDER BY line_no DESC) AS rn FROM rows WHERE NOT missed) WHERE rn = 1
), counts AS (
  SELECT day, run_id, outer_loop_round, count(*) FILTER (NOT missed) AS records, count(*) FILTER (missed) AS late FROM rows
  WHERE day + INTERVAL 1 DAY <= (SELECT max(generated_at) FROM v_traj) - INTERVAL 3 DAY GROUP BY ALL
)
SELECT strftime(day, '%Y-%m-%d') AS day, run_id, outer_loop_round, records, late, count(task_id) AS total_mutants, count_if(compile_success) AS compiled, count_if(e) AS executed, count_if(e AND killed) AS killed,
  count_if(e AND NOT killed AND target_status = 'SURVIVED') AS survived, count_if(false) AS equivalent_suspected, count_if(NOT e) AS not_executed
FROM counts LEFT JOIN latest USING (day, run_id, outer_loop_round) GROUP BY ALL""",
    ("v_traj",),
)
def closed_rounds(spark, sf):
    """Six micro-batches: one user in fifty's records of the first days come last, those of others near the end of a batch in the next one."""
    events = table(spark, sf, "events")
    day, user = F.dayofmonth("ts"), F.col("user_id") % 50
    soon = F.least(F.lit(5), _five_days() + 1)
    batch = F.when((user == 0) & (day <= 10), 5).when((user == 1) & (day % 5 == 0), soon).otherwise(_five_days())
    stream = _timed(v.traj_of(_stream_of(spark, _in_batches(spark, events, batch, 6), events)))
    root = shared_folder(spark, "stream")
    _run(jobs.write_updates(rounds.closed_rounds(stream, "generated_at", "3 days"), f"{root}/out", f"{root}/checkpoint", "append"))
    closed = spark.read.parquet(f"{root}/out").drop(jobs.BATCH)
    late = rounds.late_records(_timed(v.v_traj(spark, sf)), closed, "generated_at")
    counts = [c for c in closed.columns if c != "window"]
    met = closed.join(late, ["window", *rounds.ROUND], "full").fillna(0, [*counts[2:], "late"])
    day = F.date_from_unix_date(F.floor(F.unix_seconds("window.start") / 86_400).cast("int")).cast("string")
    return met.select(day.alias("day"), *counts, "late")


@query("T6_resumed_log", "SELECT line_no, mutant_id, target_status, killed FROM v_traj", ("v_traj",))
def resumed_log(spark, sf):
    """Six micro-batches; the third fails after its rows are written and before it is listed, then the stream starts again."""
    events = table(spark, sf, "events")
    path = _in_batches(spark, events, _five_days(), 6)
    root = shared_folder(spark, "stream")
    columns = ["line_no", "mutant_id", "target_status", "killed"]

    def start(before_commit=None):
        rows = v.traj_of(_stream_of(spark, path, events)).select(*columns)
        _run(commits.write_committed(rows, f"{root}/out", f"{root}/checkpoint", before_commit=before_commit))

    def fail(batch_id):
        if batch_id == 2:
            raise RuntimeError("stopped between writing and listing")

    try:
        start(fail)
    except StreamingQueryException:
        start()
    return commits.read_committed(spark, f"{root}/out", "line_no long, mutant_id string, target_status string, killed boolean")
