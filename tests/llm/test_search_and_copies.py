"""Merge of digest runs and the first scores of the vector search, beside brute force."""

import numpy as np
import pytest

from mutspan.llm import ball_tree, exact_dedup

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def test_runs_are_merged_in_order_without_hashing(spark):
    docs = spark.createDataFrame([(i, "same" if i % 3 else f"t{i}", None, "s", 4) for i in range(60)], COLUMNS)
    plan = exact_dedup.without_copies(docs)._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" in plan and "HashAggregate" not in plan
    assert plan.count("hashpartitioning(slot") == 1 + 6 // exact_dedup.FAN_IN_BITS


@pytest.mark.parametrize("keep", ["smallest", "largest"])
def test_every_partner_takes_its_digests(spark, keep):
    docs = spark.createDataFrame([(i * 7919 % 501, f"T{i % 40}", None, "s", 2) for i in range(500)], COLUMNS)
    rows = exact_dedup.dealt(docs, 6, "doc_id", "text", exact_dedup.F.lit(0))
    levels = exact_dedup.merge_levels(rows, 6, keep)
    sizes = [[(r.slot, r.text_sha256) for r in level.collect()] for level in levels]
    assert all(len(set(s)) == len(s) for s in sizes) and sizes[0] and len(sizes[-1]) == 40
    assert len(sizes[0]) >= len(sizes[1]) >= len(sizes[2])
    last = levels[-1].selectExpr("slot", "text_hash", "group_size").collect()
    assert all(r.slot == r.text_hash & 63 for r in last) and sum(r.group_size for r in last) == 500


def test_copies_with_one_id_keep_the_same_row(spark):
    rows = [(1, "A", "en", "s", 1), (1, "a", "de", "s", 1), (1, "a", "de", "s", 1), (None, "b", None, None, None), (None, "B", None, None, None)]
    first = exact_dedup.without_copies(spark.createDataFrame(rows, COLUMNS)).collect()
    again = exact_dedup.without_copies(spark.createDataFrame(rows[::-1], COLUMNS).repartition(3)).collect()
    assert sorted(map(repr, first)) == sorted(map(repr, again)) and len(first) == 2


def test_empty_documents(spark):
    docs = spark.createDataFrame([], COLUMNS)
    assert exact_dedup.duplicate_groups(docs).count() == 0 and exact_dedup.without_copies(docs).count() == 0


def test_first_scores_are_bounds():
    rng = np.random.default_rng(2)
    v = rng.integers(-50, 50, (60, 5))
    ids = np.arange(60)
    ids[1] = 0  # two rows of one id: neither is a candidate of query 0
    first = ball_tree.first_scores(ids, v, (ids[:30], v[:30]), 10)
    for i in range(60):
        scores = np.sort((v @ v[i])[ids != ids[i]])[::-1]
        sampled = np.sort((v[:30] @ v[i])[ids[:30] != ids[i]])[::-1]
        assert first[i] == sampled[9] <= scores[9]
    assert set(ball_tree.first_scores(ids, v, (ids[:5], v[:5]), 10)) == {ball_tree.NONE}
    assert set(ball_tree.first_scores(ids[:2], v[:2], (ids[:10], v[:10]), 10)) == {ball_tree.NONE}


@pytest.mark.parametrize("seed_rows", [4, 64])
def test_top_k_of_equal_ids_and_many_cells(spark, monkeypatch, seed_rows):
    monkeypatch.setattr(ball_tree, "SEED_ROWS", seed_rows)
    monkeypatch.setattr(ball_tree, "FEWEST_QUERIES", 2)
    rng = np.random.default_rng(8)
    v = rng.integers(-3, 4, (400, 4))
    ids = np.arange(400)
    ids[399] = 7
    frame = spark.createDataFrame([(int(i), [x / 1024 for x in r.tolist()]) for i, r in zip(ids, v)], "vec_id long, embedding array<double>")
    found = ball_tree.top_k(frame, frame.where("vec_id % 100 = 0"), 10, rows_per_shard=40).collect()
    for query in (0, 100, 200, 300):
        scores = v @ v[query]
        want = sorted((-int(s), int(i)) for s, i in zip(scores, ids) if i != query)[:10]
        assert [(-r.score, r.vec_id) for r in sorted(found, key=lambda r: r["rank"]) if r.query_id == query] == want
