"""Steps that used to shuffle or gather more than their work needs."""

from collections import Counter

import numpy as np
import pandas as pd
import pytest

from plumbline.operators import lexical, vectors
from plumbline.plans import registry_retrieval, retrieval
from plumbline.sources import runs as rn


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_texts_with_an_id_of_their_own_are_counted_without_a_shuffle(spark):
    texts = [(1, "red cars and red car"), (2, None), (3, ""), (4, "the of"), (None, "blue car")]
    got = lexical.tokenize(spark.createDataFrame(texts, "id int, text string"))
    assert "Exchange" not in _plan(got)
    rows = sorted(map(tuple, got.collect()), key=repr)
    assert rows == sorted([(1, "red", 2, 4), (1, "car", 2, 4), (None, "blue", 1, 2), (None, "car", 1, 2)], key=repr)


def test_texts_that_share_an_id_count_together_by_length(spark):
    texts = [(1, "red car"), (1, "car red"), (1, "red red car"), (2, "red"), (None, "sky"), (None, "sky")]
    got = sorted(map(tuple, lexical.tokenize(spark.createDataFrame(texts, "id int, text string")).collect()), key=repr)
    want = [(1, "red", 2, 2), (1, "car", 2, 2), (1, "red", 2, 3), (1, "car", 1, 3), (2, "red", 1, 1), (None, "sky", 2, 1)]
    assert got == sorted(want, key=repr)


def test_few_questions_leave_postings_in_place(spark, tmp_path):
    index = lexical.build_index(spark.createDataFrame([(i, f"w{i % 5} x") for i in range(20)], "id int, text string"), str(tmp_path / "i"))
    asked = spark.createDataFrame([(7, "w1"), (7, "x")], "question_id int, term string")
    found = lexical.lexical_topk(asked, index, limit=4)
    assert "BroadcastHashJoin" in _plan(found) and "SortMergeJoin" not in _plan(found)
    assert [r["id"] for r in sorted(found.collect(), key=lambda r: r["rank"])] == [1, 6, 11, 16]


def test_vectors_need_no_python_worker(spark):
    hashed = spark.createDataFrame([(1, 0, 3), (1, 3, 4), (2, 1, 1)], "id int, bucket int, tf long")
    idf = spark.createDataFrame([(0, 1.0), (3, 1.0), (1, 0.0)], "bucket int, idf double")
    got = vectors.text_vectors(hashed, idf, 4)
    assert "ArrowEvalPython" not in _plan(got)
    assert {r["id"]: r["embedding"] for r in got.collect()} == {1: [0.6, 0.0, 0.0, 0.8], 2: [0.0] * 4}


def test_questions_of_a_crowded_cell_are_split(spark, monkeypatch):
    rows = [(i, [1.0, i / 100.0]) for i in range(60)]
    asked = spark.createDataFrame(rows, "question_id int, embedding array<double>")
    items = spark.createDataFrame(rows, "id int, embedding array<double>")
    largest = spark.sparkContext.accumulator(0)
    real = vectors._block_product

    def counted(limit):
        product = real(limit)

        def checked(key, left, right):
            if max(len(left), len(right)) > 24:  # 60 rows in blocks of about ten
                largest.add(1)
            return product(key, left, right)

        return checked

    monkeypatch.setattr(vectors, "_block_product", counted)
    model = vectors.fit_cells(items, n_cells=2)
    found = vectors.dense_topk_approx(asked, items, limit=3, model=model, n_probe=2, block_bytes=8 * 2 * 10)
    exact = vectors.dense_topk(asked, items, limit=3)
    keys = lambda df: {(r["question_id"], r["id"], r["rank"]) for r in df.collect()}
    assert keys(found) == keys(exact)
    assert largest.value == 0


def test_every_fiftieth_vector_asks(spark, tmp_path):
    spark.createDataFrame([(i, [1.0, float(i)]) for i in range(101)], "vec_id long, embedding array<double>").write.parquet(
        str(tmp_path / "embeddings.parquet")
    )
    asked, items = retrieval.all_vectors(spark, str(tmp_path))
    assert sorted(r["question_id"] for r in asked.collect()) == [0, 50, 100]
    assert items.count() == 101


@pytest.mark.parametrize("name", ["dense_topk", "dense_topk_blocked"])
def test_every_vector_asks_the_exact_searches(spark, tmp_path, name):
    rows = [(i, [1.0, float(i)]) for i in range(61)]
    spark.createDataFrame(rows, "vec_id long, embedding array<double>").write.parquet(str(tmp_path / "embeddings.parquet"))
    found = registry_retrieval.queries()[name](spark, str(tmp_path)).collect()
    assert Counter(r["question_id"] for r in found) == {i: 30 for i in range(61)}
    # Angles grow with the id, so the neighbours of a vector are runs of ids.
    assert all(r["id"] == r["question_id"] for r in found if r["rank"] == 1 and r["question_id"] < 30)


def test_more_questions_than_are_taken_at_once(spark, monkeypatch):
    monkeypatch.setattr(vectors, "QUESTIONS_AT_ONCE", 3)
    monkeypatch.setattr(vectors, "DISTANCES_AT_ONCE", 12)
    asked = pd.DataFrame({"question_id": range(8), "embedding": [[1.0, i / 10] for i in range(8)]})
    matrix = vectors._unit(asked["embedding"])
    found = vectors._product(asked, np.arange(8), matrix, 2)
    assert len(found) == 16 and sorted(found["question_id"].unique()) == list(range(8))
    assert (found[found["dist"] == 0.0]["id"] == found[found["dist"] == 0.0]["question_id"]).all()


@pytest.mark.parametrize("at_once", [2**16, 4])
def test_distances_that_floats_cannot_tell_apart(monkeypatch, at_once):
    monkeypatch.setattr(vectors, "EXACT_AT_ONCE", at_once)
    rng = np.random.default_rng(3)
    base = rng.normal(size=(4, 16))[rng.integers(0, 4, 600)]
    points = base + rng.normal(size=base.shape) * rng.choice([1e-8, 1e-4, 0.3], size=(600, 1))
    points[200:260] = points[200]
    unit = points / np.linalg.norm(points, axis=1, keepdims=True)
    best = vectors._Nearest(unit[:90], 7)
    likely = 0
    for start in range(0, 600, 50):
        likely += best._likely(unit[start : start + 50]) is not None
        best.add(np.arange(start, start + 50), unit[start : start + 50])
    dist = np.round(1 - unit[:90] @ unit.T, 9)
    want = [sorted(range(600), key=lambda j: (dist[i, j], j))[:7] for i in range(90)]  # noqa: B023
    found = best.frame(np.arange(90))
    assert [found[found["question_id"] == i]["id"].tolist() for i in range(90)] == want
    assert (likely == 11) == (at_once > 4)


def test_documents_of_a_run_are_compressed_and_not_joined_by_run(spark):
    heads = spark.createDataFrame([("a", "f", "{}"), ("b", "g", "{}")], "tag string, file string, config string")
    bodies = spark.createDataFrame([("a", 0, "x"), ("a", 1, "y")], "tag string, chunk int, body string")
    made = rn._documents_of(heads, bodies, bodies.select("tag").distinct(), ["tag"], rn.F.coalesce("body", rn.F.lit("")))
    assert sorted(map(tuple, made.collect())) == [("a", "f", "x"), ("a", "f", "y"), ("b", "g", "")]
    # The bodies' side of the union, which holds nearly everything, is joined in place.
    assert "BroadcastHashJoin [tag" in _plan(made)
