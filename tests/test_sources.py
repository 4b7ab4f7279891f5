"""Readers on real files; streams that stop and go on."""

import json

from pyspark.sql import functions as F

from mutspan.operators.merge import suite_rows
from mutspan.sources import readers, sinks
from mutspan.streaming import jobs


def test_index_by_header_and_by_position(spark, tmp_path):
    path = tmp_path / "index.csv"
    path.write_text(
        "operator,line,method,class,class_f,mutation_statement,package,project,file_path,original_graph_path,mutant_graph_path,is_kille\n"
        'ROR_1,12,m(),C,C.java,"a, ""b""",pk,p,f,o,g,1\n,,,,,,,,,,,\nSDL_1,x,m(),C,C.java,s,pk,q,f,o,g,0\n'
    )
    rows = readers.mutant_index(spark, str(path)).orderBy("operator").collect()
    assert [(r["operator"], r["line"], r["is_killed"], r["equivalent"]) for r in rows] == [("ROR_1", 12, "1", ""), ("SDL_1", -1, "0", "")]
    assert rows[0]["mutation_statement"] == 'a, "b"'
    assert [r["project"] for r in readers.positional_index(spark, str(path), ["q"]).collect()] == ["q"]


def test_suite_reports_and_entries(spark, tmp_path):
    (tmp_path / "s").mkdir()
    report = {"className": "C", "suiteKilledMutants": ["A_1"], "suiteLiveMutants": ["A_2"], "suiteMutantResults": {"A_1": "T#t", "A_3": ""}}
    (tmp_path / "s" / "r.json").write_text(json.dumps(report, indent=2))
    rows = {r["mutant"]: r for r in suite_rows(readers.suite_reports(spark, str(tmp_path / "s"))).collect()}
    assert rows["A_1"]["killed"] and rows["A_2"]["live"] and rows["A_1"]["tests"] == "T#t" and set(rows) == {"A_1", "A_2", "A_3"}
    for folder in "ab":
        (tmp_path / "e" / folder).mkdir(parents=True)
        (tmp_path / "e" / folder / "t.csv").write_text(f"rowIndex,mutantName\n1,csv_{folder}\n")
    (tmp_path / "e" / "a" / "t.json").write_text(json.dumps({"testEntries": [{"rowIndex": "1", "mutantName": "json_a"}]}))
    got = readers.target_entries(spark, f"{tmp_path}/e/*/t.json", f"{tmp_path}/e/*/t.csv")
    assert sorted(r["mutantName"] for r in got.collect()) == ["csv_b", "json_a"]


def test_kill_statistic_text(spark, tmp_path):
    (tmp_path / "k.txt").write_text(
        "test_results={a.T#t1=ROR_1, ROR_2, a.T#t2=};\nmutant_results={ROR_1=a.T#t1, ROR_2=a.T#t1, SDL_3=};\nkilled_mutants=[];\nlive_mutants=[];\nmutant_score=66.5;\n"
    )
    row = readers.kill_statistics(spark, str(tmp_path)).collect()[0]
    assert row["test_results"] == {"a.T#t1": ["ROR_1", "ROR_2"], "a.T#t2": []}
    assert sorted(row["killed_mutants"]) == ["ROR_1", "ROR_2"] and row["live_mutants"] == ["SDL_3"] and row["mutant_score"] == 66.5


def test_artifacts_and_sources(spark, tmp_path):
    for name in ("main/A.java", "Test/B.java", "main/llm/C.java", "main/D.class"):
        path = tmp_path / "root" / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text("x")
    assert readers.artifacts(spark, str(tmp_path / "root"), "*.class").collect()[0]["length"] == 1
    assert [r["file_name"] for r in readers.source_files(spark, str(tmp_path / "root")).collect()] == ["A.java"]


def test_chunked_export(spark, tmp_path):
    sinks.write_chunked_csv(spark.range(25).coalesce(1).select("id", F.array("id").alias("a")), str(tmp_path / "out"), 10)
    assert len(list((tmp_path / "out").glob("*.csv"))) == 3


def test_file_order(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text("".join(f'{{"i": {i}}}\n' for i in range(50)))
    df = readers.with_file_order(spark.read.schema("i long").json(str(tmp_path)))
    assert [r["i"] for r in df.orderBy("file_path", "block_start", "read_order").collect()] == list(range(50))


def test_stream_resumes_without_loss_or_repeats(spark, tmp_path):
    source, out, checkpoint = (str(tmp_path / n) for n in ("in", "out", "cp"))
    schema = "mutant_id string, line_no long, target_status string, killed boolean"

    def write(first, last):
        spark.range(first, last).select(
            F.concat(F.lit("m"), (F.col("id") % 5).cast("string")).alias("mutant_id"), F.col("id").alias("line_no"),
            F.concat(F.lit("S"), F.col("id").cast("string")).alias("target_status"), (F.col("id") % 7 == 0).alias("killed"),
        ).write.mode("append").json(source)

    def run():
        state = jobs.mutant_state(jobs.json_stream(spark, source, schema, 1))
        jobs.write_updates(state, out, checkpoint).awaitTermination()
        return sorted(jobs.read_state(spark, out, ["mutant_id"]).collect())

    write(0, 20)
    run()
    write(20, 33)
    got = run()
    assert got == run()
    batch = jobs.mutant_state(spark.read.schema(schema).json(source))
    assert got == sorted(batch.select(*jobs.read_state(spark, out, ["mutant_id"]).columns).collect())
    jobs.compact_state(spark, out, ["mutant_id"], str(tmp_path / "small"))
    assert got == sorted(jobs.read_state(spark, str(tmp_path / "small"), ["mutant_id"]).collect())
