"""Nearest neighbours, word search, fusion and expansion against brute force."""

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.functions.text import STOP_WORDS
from plumbline.operators import blockmax, fusion, lexical, vectors


@pytest.fixture(scope="module")
def points(spark):
    rng = np.random.default_rng(0)
    base = rng.normal(size=(120, 8))
    base[40:80] = base[40]  # a third are copies
    base[7] = 0.0  # no direction
    asked = rng.normal(size=(25, 8))
    asked[3] = base[40]
    q = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(asked)], "question_id long, embedding array<double>")
    c = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(base)], "id long, embedding array<double>")
    want = {}
    with np.errstate(invalid="ignore"):
        unit = lambda m: m / np.linalg.norm(m, axis=1, keepdims=True)
        dist = np.round(1 - unit(asked) @ unit(base).T, 9)
    for i in range(len(asked)):
        order = sorted(range(len(base)), key=lambda j: (math.inf if np.isnan(dist[i, j]) else dist[i, j], j))
        want[i] = order[:30]
    return q, c, want


def _ids(df):
    got = defaultdict(list)
    for r in df.orderBy("question_id", "rank").collect():
        got[r["question_id"]].append(r["id"])
    return dict(got)


def test_all_forms_agree(points):
    q, c, want = points
    assert _ids(vectors.dense_topk(q, c)) == want
    # Items too large to send, questions small enough; then neither.
    assert _ids(vectors.dense_topk(q, c, broadcast_bytes=8 * 8 * 60)) == want
    assert _ids(vectors.dense_topk(q, c, broadcast_bytes=8 * 8 * 10)) == want
    assert _ids(vectors.dense_topk_blocked(q, c, block_bytes=8 * 8 * 9)) == want


def test_approximate_search(points):
    q, c, want = points
    c = c.filter("id <> 7")
    exact = vectors.dense_topk(q, c)
    model = vectors.fit_cells(c, n_cells=4)
    everything = vectors.dense_topk_approx(q, c, model=model, n_probe=4, block_bytes=8 * 8 * 9)
    assert vectors.recall(everything, exact).agg(F.min("recall")).collect()[0][0] == 1.0
    some = vectors.recall(vectors.dense_topk_approx(q, c, model=model, n_probe=2), exact)
    assert 0.3 < some.agg(F.avg("recall")).collect()[0][0] <= 1.0


def test_text_vectors_are_unit(spark):
    terms = spark.createDataFrame([(1, "a", 2), (1, "b", 1), (2, "a", 1), (2, "c", 5), (3, "a", 1)], "id int, term string, tf long")
    hashed = vectors.hashed_terms(terms, 16)
    rows = {r["id"]: r["embedding"] for r in vectors.text_vectors(hashed, vectors.fit_idf(hashed), 16).collect()}
    assert all(len(v) == 16 for v in rows.values())
    assert sum(x * x for x in rows[1]) == pytest.approx(1.0)
    assert rows[3] == [0.0] * 16  # its only term is in every text


def test_word_search(spark, tmp_path):
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(60)] + ["common"] * 40 + ["the"]
    docs = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(1, 40)))) for i in range(200)]
    asked = [(i, " ".join(rng.choice(vocabulary) for _ in range(5)) + " unheard") for i in range(15)]
    corpus = spark.createDataFrame(docs, "id int, text string")
    index = lexical.build_index(corpus, f"{tmp_path}/index")
    terms = lexical.tokenize(spark.createDataFrame(asked, "id int, text string")).withColumnRenamed("id", "question_id")

    stop = set(STOP_WORDS)
    words = {i: [w for w in t.split() if w not in stop] for i, t in docs}
    words = {i: w for i, w in words.items() if w}
    df = Counter(t for w in words.values() for t in set(w))
    mean = sum(map(len, words.values())) / len(words)
    want = {}
    for q, t in asked:
        scores = {}
        for i, w in words.items():
            tf = Counter(w)
            score = sum(
                math.log(1 + (len(words) - df[x] + 0.5) / (df[x] + 0.5)) * tf[x] * 2.2 / (tf[x] + 1.2 * (0.25 + 0.75 * len(w) / mean))
                for x in set(t.split()) - stop
                if tf[x]
            )
            if score:
                scores[i] = round(score, 9)
        want[q] = sorted(scores, key=lambda i: (-scores[i], i))[:30]
    plain = lexical.lexical_topk(terms, index)
    assert _ids(plain) == want
    # The common word is spread over salts; the result is the same.
    assert _ids(lexical.lexical_topk(terms, index, rows_per_salt=10, max_hot=1000)) == want


def _ranking(spark, items):
    return spark.createDataFrame([(1, x, i + 1) for i, x in enumerate(items)], "question_id int, id string, rank int")


def test_rrf_by_hand(spark):
    scores = {r["id"]: r["score"] for r in fusion.rrf({"dense": _ranking(spark, "ab"), "lexical": _ranking(spark, "bc")}).collect()}
    assert scores == {"a": 1 / 61, "b": 1 / 62 + 1 / 61, "c": 1 / 62}
    other = {r["id"]: r["score"] for r in fusion.rrf({"dense": _ranking(spark, "bc"), "lexical": _ranking(spark, "ab")}).collect()}
    assert scores == other


def test_hybrid_ties_keep_dense_order(spark):
    hits = fusion.hybrid_topk(_ranking(spark, "ax"), _ranking(spark, "by"), top_k=4).orderBy("pos").collect()
    assert [h["id"] for h in hits] == ["a", "b", "x", "y"]
    assert hits[0]["lexical_rank"] is None and hits[1]["dense_rank"] is None


def test_expansion(spark):
    hits = fusion.hybrid_topk(_ranking(spark, "ab"), _ranking(spark, "b"), top_k=10)
    fk = spark.createDataFrame(
        [("a", "z", "id"), ("m", "a", "id"), ("b", "c", "id"), ("a", "b", "id")], "table string, references_table string, references_column string"
    )
    edges = fusion.fk_edges(fk)
    assert edges.count() == 8

    def names(total):
        return [r["id"] for r in fusion.expand_fk(hits, edges, total).orderBy("pos").collect()]

    assert names(2) == ["b", "a"]
    assert names(3) == ["b", "a", "c"]
    assert names(10) == ["b", "a", "c", "m", "z"]
    added = fusion.expand_fk(hits, edges, 10).filter("id = 'm'").collect()[0]
    assert (added["score"], added["dense_rank"], added["lexical_rank"]) == (0.0, None, None)


def test_selection_and_recall(spark):
    asked = spark.createDataFrame([(1,), (2,)], "question_id int")
    every = fusion.select_tables("baseline", asked, ["b", "a"])
    assert sorted(map(tuple, every.collect())) == [(1, "a", 1), (1, "b", 2), (2, "a", 1), (2, "b", 2)]
    hits = fusion.hybrid_topk(_ranking(spark, "ab"), _ranking(spark, "bq"), top_k=10)
    chosen = fusion.select_tables("hybrid", asked, ["a", "b"], hits)
    assert {r["table"] for r in chosen.collect()} == {"a", "b"}
    gold = spark.createDataFrame([(1, "a"), (1, "z"), (2, "b")], "question_id int, table string")
    recalls = fusion.retrieval_recall(chosen, gold)
    assert {r["question_id"]: r["recall"] for r in recalls.collect()} == {1: 0.5, 2: 0.0}
    assert fusion.mean_recall(recalls).collect()[0]["mean_recall"] == 0.25
    with pytest.raises(ValueError):
        fusion.select_tables("other", asked, [])


@pytest.mark.parametrize("block_rows,limit", [(4, 3), (16, 30), (1, 5)])
def test_blocks_give_the_same_hits(spark, tmp_path, block_rows, limit):
    """Equal to scoring every posting; blocks are skipped, also with a term in most texts and salted terms."""
    rng = random.Random(block_rows)
    vocabulary = [f"w{i}" for i in range(300)]
    docs = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(1, 30))) + (" common" if i % 3 else "")) for i in range(400)]
    docs += [(500 + i, docs[7][1]) for i in range(5)] + [(600, ""), (601, None)]
    asked = [(i, docs[i * 9][1] + " common unheard") for i in range(20)] + [(50, "unheard"), (51, "common")]
    index = lexical.build_index(spark.createDataFrame(docs, "id int, text string"), f"{tmp_path}/index")
    blocks = blockmax.build_blocks(index, f"{tmp_path}/blocks", block_rows)
    questions = lexical.tokenize(spark.createDataFrame(asked, "id int, text string")).withColumnRenamed("id", "question_id")
    want = sorted(map(tuple, lexical.lexical_topk(questions, index, limit).collect()))
    hits, report = blockmax.block_topk(questions, blocks, limit, rows_per_salt=2, max_hot=50)
    assert sorted(map(tuple, hits.select("question_id", "id", "score", "rank").collect())) == want
    counts = report.collect()
    assert {r.question_id for r in counts} == {q for q, _ in asked if q != 50}
    assert all(r.n_first + r.n_opened + r.n_skipped == r.n_blocks and r.n_first <= max(2, limit) for r in counts)
    if limit < 30:
        assert sum(r.n_skipped for r in counts) > sum(r.n_blocks for r in counts) / 4
    assert blocks.terms.agg(F.sum("df")).first()[0] == index.postings.count()
