"""Streams over several micro-batches: expiring state, closed rounds, a failed batch."""

import datetime

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from mutspan.streaming import commits, jobs, mutants, rounds

LOG = "line_no long, mutant_id string, task_id string, operator string, run_id string, outer_loop_round int, target_status string, killed boolean, compile_success boolean, at timestamp"
START = datetime.datetime(2024, 1, 1, tzinfo=datetime.timezone.utc)


def record(line, mutant, hours, status="SURVIVED", run="r"):
    return (line, mutant, mutant, "", run, 1, status, status == "KILLED", True, START + datetime.timedelta(hours=hours))


def stream(spark, path, batches):
    for rows in batches:
        spark.createDataFrame(rows, LOG).coalesce(1).write.mode("append").parquet(path)
    return jobs.parquet_stream(spark, path, spark.createDataFrame([], LOG), files_per_batch=1)


def finish(query):
    query.awaitTermination()
    return query


def test_state_holds_unfinished_mutants_only_and_a_late_comer_keeps_its_kill(spark, tmp_path):
    hour = 3_600_000
    batches = [
        [record(i, f"m{i}", 0, "KILLED" if i % 2 else "SURVIVED") for i in range(20)],
        [record(100, "m0", 10)],
        [record(101, "m0", 30), record(102, "m2", 30, "KILLED")],
        [record(103, "m1", 31, "COMPILE_FAILED_AFTER_REPAIR"), record(104, "m2", 32)],
        [record(105, "m4", 60)],
    ]
    source = stream(spark, str(tmp_path / "in"), batches)
    query = jobs.write_updates(mutants.mutant_status(source, "at", "1 hour", 5 * hour), str(tmp_path / "out"), str(tmp_path / "cp"))
    finish(query)
    sizes = [p.stateOperators[0].numRowsTotal for p in query.recentProgress if p.stateOperators]
    every = [r for rows in batches for r in rows]
    want = {}
    for line, mutant, _, _, _, _, status, killed, _, _ in sorted(every):
        want[mutant] = (status, line, want.get(mutant, (0, 0, False))[2] or killed)
    got = {r.mutant_id: (r.last_status, r.last_line_no, r.killed_ever) for r in mutants.read_mutant_status(spark, str(tmp_path / "out")).collect()}
    assert got == want and got["m1"] == ("COMPILE_FAILED_AFTER_REPAIR", 103, True)
    assert max(sizes) >= 20 and sizes[-1] < max(sizes) - 8  # the ten killed ones have left, with their timers


def test_rounds_close_once_and_late_records_are_reported(spark, tmp_path):
    batches = [
        [record(1, "a", 1, "KILLED"), record(2, "a", 2), record(3, "b", 3)],
        [record(4, "c", 30), record(5, "a", 5, "KILLED")],  # the second one is late within the bound
        [record(6, "d", 100)],
        [record(7, "e", 101)],
        [record(8, "f", 4), record(9, "g", 200, run="q")],  # the first one is too late
    ]
    path, out = str(tmp_path / "in"), str(tmp_path / "out")
    source = stream(spark, path, batches)
    finish(jobs.write_updates(rounds.closed_rounds(source, "at", "12 hours"), out, str(tmp_path / "cp"), "append"))
    closed = spark.read.parquet(out)
    day = F.floor(F.unix_seconds("window.start") / 86_400) - 19_723
    got = sorted(tuple(r) for r in closed.select(day, "run_id", "records", "total_mutants", "killed", "survived").collect())
    assert got == [(0, "r", 4, 2, 1, 1), (1, "r", 1, 1, 0, 1), (4, "r", 2, 2, 0, 2)]  # the day of the last record is open
    late = rounds.late_records(spark.read.parquet(path), closed, "at")
    assert [tuple(r) for r in late.select(day, "run_id", "late").collect()] == [(0, "r", 1)]


def test_a_batch_that_fails_before_it_is_listed_is_run_again(spark, tmp_path):
    path, out, checkpoint = (str(tmp_path / n) for n in ("in", "out", "cp"))
    batches = [[record(10 * b + i, f"m{i}", b) for i in range(5)] for b in range(4)]
    rows = stream(spark, path, batches).select("line_no", "mutant_id")
    seen = []

    def fail_once(batch_id):
        seen.append(batch_id)
        if batch_id == 1:
            raise RuntimeError("stopped")

    assert commits.manifest(spark, out).count() == 0
    with pytest.raises(StreamingQueryException):
        finish(commits.write_committed(rows, out, checkpoint, before_commit=fail_once))
    assert seen == [0, 1]
    assert commits.read_committed(spark, out, "line_no long, mutant_id string").count() == 5
    finish(commits.write_committed(rows, out, checkpoint))
    got = commits.read_committed(spark, out, "line_no long, mutant_id string")
    assert sorted(r.line_no for r in got.collect()) == sorted(r[0] for b in batches for r in b)
    assert sorted((r.batch_id, r.rows) for r in commits.manifest(spark, out).collect()) == [(b, 5) for b in range(4)]
    assert commits.uncommitted(spark, out).count() == 1


def test_a_listed_batch_is_not_written_again(spark, tmp_path):
    path, out = str(tmp_path / "in"), str(tmp_path / "out")
    rows = stream(spark, path, [[record(1, "a", 1)], [record(2, "b", 2)]]).select("line_no")
    finish(commits.write_committed(rows, out, str(tmp_path / "cp1")))
    finish(commits.write_committed(rows, out, str(tmp_path / "cp2")))  # the commits of the first checkpoint were lost
    assert sorted(r.line_no for r in commits.read_committed(spark, out, "line_no long").collect()) == [1, 2]


def test_a_folder_that_lost_rows_is_an_error(spark, tmp_path):
    path, out = str(tmp_path / "in"), str(tmp_path / "out")
    rows = stream(spark, path, [[record(1, "a", 1), record(2, "b", 1)]]).select("line_no")
    finish(commits.write_committed(rows, out, str(tmp_path / "cp")))
    folder = commits.manifest(spark, out).first().folder
    spark.range(1).select(F.lit(1).cast("long").alias("line_no")).write.mode("overwrite").parquet(f"{out}/{folder}")
    with pytest.raises(ValueError, match="1 rows in the listed folders, 2 in the manifest"):
        commits.read_committed(spark, out, "line_no long")


def test_expiring_state_needs_no_setting_of_the_session(spark, tmp_path):
    plain = "org.apache.spark.sql.execution.streaming.state.HDFSBackedStateStoreProvider"
    before = spark.conf.get(jobs.PROVIDER)
    spark.conf.set(jobs.PROVIDER, plain)
    try:
        source = stream(spark, str(tmp_path / "in"), [[record(1, "a", 0, "KILLED"), record(2, "a", 1)], [record(3, "b", 2)]])
        statuses = mutants.mutant_status(source, "at", "1 hour", 3_600_000)
        finish(jobs.write_updates(statuses, str(tmp_path / "out"), str(tmp_path / "cp"), state_store=mutants.STATE_STORE))
        assert spark.conf.get(jobs.PROVIDER) == plain
    finally:
        spark.conf.set(jobs.PROVIDER, before)
    got = {tuple(r) for r in mutants.read_mutant_status(spark, str(tmp_path / "out")).collect()}
    assert got == {("a", "SURVIVED", 2, True), ("b", "SURVIVED", 3, False)}


@pytest.mark.parametrize("parts", [0, 3])
def test_a_table_streams_as_one_file_or_as_a_folder(spark, tmp_path, parts):
    rows = [(i, i * i) for i in range(20)]
    frame = spark.createDataFrame(rows, "a long, b long")
    frame.repartition(parts or 1).write.parquet(str(tmp_path / ("t.parquet" if parts else "folder")))
    if not parts:
        (next((tmp_path / "folder").glob("*.parquet"))).rename(tmp_path / "t.parquet")
    spark.createDataFrame([(-1, -1)], "a long, b long").write.parquet(str(tmp_path / "other.parquet"))
    finish(jobs.write_updates(jobs.table_stream(spark, str(tmp_path), "t", frame, 1), str(tmp_path / "out"), str(tmp_path / "cp"), "append"))
    assert sorted((r.a, r.b) for r in spark.read.parquet(str(tmp_path / "out")).collect()) == rows
