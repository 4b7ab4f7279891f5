"""Steps that several parts of a result read are taken once."""

from mutspan.operators import facts, killmatrix

REQUESTS = "request_id long, mutant_id string"
MUTANTS = "mutant_row_id long, mutant_id string, project string, class_name string, method string, operator string"


def joins(df):
    return df._jdf.queryExecution().optimizedPlan().toString().count("Join ")


def test_names_of_a_request_meet_one_table_each(spark):
    mutants = spark.createDataFrame(
        [
            (5, "p::a.K::m::AOIS_1", "p", "a.K", "m", "AOIS_1"), (6, "AOIS_2", "p", "K", "m", "x"), (7, "AOIS_2", "p", "K", "m", "x"),
            (8, "other", "p", "a.K", "m", "AOIS_3"), (9, "AOIS_3", "q", "Z", "n", "y"), (10, None, "p", "K", "m", None),
        ],
        MUTANTS,
    )
    asked = [(1, "p::a.K::m::AOIS_1"), (2, "p::a.K::m::AOIS_2"), (3, "p::a.K::m::AOIS_3"), (4, "z::a.K::m::AOIS_3"), (5, "z::a.K::m::AOIS_9"), (6, None), (2, "p::a.K::m::AOIS_2")]
    found = facts.find_mutants(spark.createDataFrame(asked, REQUESTS), mutants)
    got = sorted((r["request_id"], r["mutant_row_id"], r["tier"]) for r in found.collect())
    # exact id; simple class name, smallest row; operator of the full class name; bare name alone
    assert got == [(1, 5, 1), (2, 6, 2), (3, 8, 2), (4, 9, 3)]
    assert joins(found) == 2


def test_recorded_results_are_counted_once(spark):
    originals = spark.createDataFrame([("C", "a", "pass"), ("C", "b", "x"), ("C", "c", None)], "class_name string, test string, original_result string")
    results = spark.createDataFrame([("C", 1, "a", "pass"), ("C", 2, "b", "y"), ("C", 4, "c", "z")], "class_name string, mutant int, test string, mutant_result string")
    runs = spark.createDataFrame([("C", i, i != 2, False, "lost") for i in (1, 2, 3, 4)], "class_name string, mutant int, succeeded boolean, timed_out boolean, message string")
    full = killmatrix.complete_results(originals, results, runs, 3000)
    got = sorted(((r["mutant"], r["original_result"] or "", r["mutant_result"], r["tests"]) for r in full.collect()))
    lost = [(i, o, "worker_error: lost", 1) for i in (2, 3) for o in ("pass", "x")]
    assert got == sorted([(1, "pass", "pass", 1), (1, "x", "pass", 1), (4, "", "z", 1), (4, "pass", "pass", 1), (4, "x", "pass", 1), *lost])
    # tests meet their original results once, not in each part
    assert joins(full) <= 7
