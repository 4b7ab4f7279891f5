"""Registered operator queries beside their SQL, and the pipeline."""

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__
import corpus_pipeline
from mutspan.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module", autouse=True)
def shared_folder(spark, tmp_path_factory):
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("shared")))


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "labels", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    want = con.execute(queries.ORACLES[name])
    columns = [c[0] for c in want.description]
    want = sorted(map(repr, want.fetchall()))
    got = sorted(repr(tuple(r[c] for c in columns)) for r in queries.QUERIES[name](spark, SF).collect())
    assert got == want


def test_registered():
    assert set(queries.QUERIES) <= set(__spark_entry__.queries())
    assert "pipeline" in __spark_entry__.queries()


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    sizes = [docs.count()]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF).cache()
        assert docs.columns == columns
        assert docs.where(F.length("text") != F.col("n_chars")).count() == 0
        sizes.append(docs.count())
    assert sizes == sorted(sizes, reverse=True) and sizes[0] > sizes[-1] > 0
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert packed.select("doc_id").distinct().count() == docs.select("doc_id").distinct().count()


def test_near_copies_of_the_pipeline_share_four_fifths_of_five_word_shingles(spark):
    base = [[f"{name}{i}" for i in range(200)] for name in "abc"]
    texts = []
    for words, changes in zip(base, ((0, 4), (0, 5), (0, 4, 20))):
        for n in changes:
            texts.append(" ".join(f"new{n}" if i % 10 == 5 and i < 10 * n else w for i, w in enumerate(words)))
    shingles = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in map(str.split, texts)]
    share = lambda a, b: len(shingles[a] & shingles[b]) / len(shingles[a] | shingles[b])
    assert 0.80 < share(0, 1) < 0.82 and share(2, 3) < 0.8
    component = list(range(len(texts)))
    for a in range(len(texts)):
        for b in range(a):
            if share(a, b) >= 0.8:
                component = [min(component[a], component[b]) if c in (component[a], component[b]) else c for c in component]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    kept = corpus_pipeline.drop_near_copies(spark, docs, SF).collect()
    assert sorted((r.doc_id, r.text) for r in kept) == [(i, t) for i, t in enumerate(texts) if component[i] == i]
