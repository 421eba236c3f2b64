"""Files, stored logs, query runs, samples and attempt logs."""

import json
import tempfile

import pytest
from pyspark.sql import functions as F

from plumbline.operators import evaluate as ev
from plumbline.operators import querylog, runs
from plumbline.sources import predictions as pr
from plumbline.sources import questions as qs
from plumbline.sources import reports as rp
from plumbline.streaming import progress


@pytest.fixture(scope="module")
def folder():
    return tempfile.mkdtemp(prefix="run-")


def test_questions_file(spark, folder):
    items = [
        {"question_id": 1, "db_id": "d", "question": "q1", "evidence": "e", "SQL": "SELECT 1", "difficulty": "simple"},
        {"question_id": 2, "db_id": "d", "question": "q2", "SQL": "SELECT 2"},
    ]
    path = f"{folder}/questions.json"
    with open(path, "w", encoding="utf-8") as f:
        json.dump(items, f, indent=2)
    rows = {r["question_id"]: r for r in qs.load_questions(spark, path).collect()}
    assert rows[1]["gold_sql"] == "SELECT 1" and rows[1]["difficulty"] == "simple"
    assert (rows[2]["evidence"], rows[2]["difficulty"]) == ("", "unknown")


def _prediction(i, predicted, gold, **more):
    return {
        "question_id": i, "db_id": "d", "difficulty": "simple", "question": "q", "evidence": "", "predicted_sql": "SELECT 1",
        "predicted_rows": predicted, "execution_error": None, "gold_sql": "SELECT 1", "gold_rows": gold, "gold_error": None,
        "prompt_tokens": 10, "completion_tokens": 5, "latency_s": 0.5, "attempts": 0, **more,
    }


def test_prediction_file_round_trip(spark, folder):
    rows = [["Apple", 325, 1.5, None, True], ["Quo\"te, é", 1.0, 2, "null", False]]
    document = {
        "config": {"tag": "t", "model": "m", "generated_at": "20240101-000000", "tables_in_prompt": 10},
        "predictions": [
            _prediction(1, rows, rows[::-1]),
            _prediction(2, None, [], execution_error="boom"),
            _prediction(3, [], []),
            _prediction(4, [[[1, 2]]], [[[1, 2]]]),
            _prediction(5, [["12.5"]], [[12.5]]),
        ],
    }
    path = f"{folder}/predictions-1.json"
    with open(path, "w", encoding="utf-8") as f:
        json.dump(document, f, indent=2, ensure_ascii=False)
    config, predictions, cells = pr.load_predictions(spark, path)
    assert config.collect()[0]["tables_in_prompt"] == 10
    first = cells.filter("question_id = 1 AND side = 'pred'").orderBy("pos").collect()
    assert first[0]["cells"] == ["S:Apple", "D:325", "D:1.5", "N", "D:1"]
    assert first[1]["cells"] == ['S:Quo"te, é', "D:1", "D:2", "S:null", "D:0"]
    results = {r["question_id"]: r for r in ev.evaluate_questions(predictions, cells).collect()}
    assert [results[i]["correct"] for i in range(1, 6)] == [True, False, True, False, False]
    assert results[2]["soft_f1"] == 1.0 and results[2]["category"] == "sql_error"

    # To JSON and back, and through the stored log.
    nested = pr.prediction_json(predictions, cells).filter("question_id <> 4").collect()
    again = {r["question_id"]: json.loads(r["json"]) for r in nested}
    assert again[2]["predicted_rows"] is None and again[3]["gold_rows"] == []
    assert again[1]["predicted_rows"] == [["Apple", 325, 1.5, None, 1], ['Quo"te, é', 1, 2, "null", 0]]
    pr.write_predictions(config, predictions, cells, f"{folder}/log")
    _, stored, stored_cells = pr.read_log(spark, f"{folder}/log")
    assert stored.count() == 5 and stored_cells.count() == cells.count()


def test_evaluation_store_and_comparison(spark, folder):
    results = spark.createDataFrame(
        [("a", i, "d", "simple", i % 2 == 0, 0.5, "correct" if i % 2 == 0 else "wrong_result", True, 100, 7, 1.25) for i in range(4)],
        "tag string, question_id long, db_id string, difficulty string, correct boolean, soft_f1 double, category string, "
        "executed boolean, prompt_tokens int, completion_tokens int, latency_s double",
    )
    config = spark.createDataFrame([("a", "m", 10, "s")], "tag string, model string, tables_in_prompt int, generated_at string")
    rp.write_evaluation(config, results, f"{folder}/evaluation")
    stored_config, totals, stored = rp.read_evaluation(spark, f"{folder}/evaluation")
    lines = runs.compare_runs(stored_config, totals, ev.token_usage(stored))
    assert lines.collect()[0]["line"] == "| a | m | 10 | **0.5** | 0.5 | 100 | 1.25s |"
    runs.write_comparison(lines, f"{folder}/comparison")
    text = [r["value"] for r in spark.read.text(f"{folder}/comparison").collect()]
    assert text[0].startswith("| Run |") and text[2] == "| a | m | 10 | **0.5** | 0.5 | 100 | 1.25s |"


def test_latest_and_descriptions(spark, folder):
    for tag, stamp in (("a", 1), ("a", 3), ("b", 2)):
        spark.range(1).write.json(f"{folder}/reports/{tag}/predictions-2024010{stamp}.json")
    found = {r["tag"]: r["path"].rsplit("/", 1)[1] for r in rp.latest_file(spark, f"{folder}/reports").collect()}
    assert found == {"a": "predictions-20240103.json", "b": "predictions-20240102.json"}
    assert rp.latest_file(spark, f"{folder}/reports", tag="b").count() == 1
    path = f"{folder}/descriptions.json"
    with open(path, "w", encoding="utf-8") as f:
        json.dump({"a": "first", "b": "sécond"}, f, indent=2, ensure_ascii=False)
    known = rp.load_descriptions(spark, path)
    assert sorted(map(tuple, known.collect())) == [("a", "first"), ("b", "sécond")]
    tables = spark.createDataFrame([("a",), ("c",)], "table string")
    assert [r["table"] for r in rp.missing_descriptions(tables, known).collect()] == ["c"]
    assert rp.missing_descriptions(tables, known, refresh=True).count() == 2


def test_query_log(spark):
    spark.createDataFrame([(i, i % 3) for i in range(30)], "a int, b int").createOrReplaceTempView("log_source")
    log = [
        ("sorted", "SELECT a, a FROM log_source ORDER BY a DESC"),
        ("cte", "WITH x AS (SELECT b FROM log_source) SELECT count(*) FROM x -- all"),
        ("short", "SELECT a FROM log_source ORDER BY a LIMIT 2"),
        ("drop", "DROP VIEW log_source"),
        ("two", "SELECT 1; SELECT 2"),
        ("insert", "INSERT INTO log_source VALUES (1, 1)"),
        ("set", "SET a = 1"),
        ("zero", "SELECT 1 / (a - a) FROM log_source"),
    ]
    cells, outcomes = querylog.run_query_log(spark, spark.createDataFrame(log, "query_id string, sql string"), limit=10)
    state = {r["query_id"]: r for r in outcomes.collect()}
    assert {q for q, r in state.items() if r["error"]} == {"drop", "two", "insert", "set", "zero"}
    assert state["sorted"]["truncated"] and not state["short"]["truncated"]
    whole, said = querylog.run_query_log(
        spark, spark.createDataFrame([("many", "SELECT id FROM RANGE(5000) ORDER BY id DESC LIMIT 2500")], "query_id string, sql string")
    )
    assert [(r["pos"], r["cells"]) for r in whole.orderBy("pos").collect()] == [(i, [f"D:{4999 - i}"]) for i in range(2500)]
    assert [(r["error"], r["truncated"]) for r in said.collect()] == [(None, False)]
    rows = [r["cells"] for r in cells.filter("query_id = 'sorted'").orderBy("pos").collect()]
    assert rows == [[f"D:{i}", f"D:{i}"] for i in range(29, 19, -1)]
    assert cells.filter("query_id = 'cte'").collect()[0]["cells"] == ["D:30"]


def test_serialized_types(spark):
    df = spark.sql(
        "SELECT 1 AS k, CAST(12.50 AS DECIMAL(5,2)) AS d, DATE'2024-01-02' AS t, CAST(0.1 AS FLOAT) AS f, 2.0D AS w, NULL AS n, true AS b, 'x' AS s"
    )
    row = pr.serialize_rows(df, ["k"]).collect()[0]
    assert row["cells"] == ["D:1", "S:12.50", "S:2024-01-02", "D:0.1", "D:2", "N", "D:1", "S:x"]


@pytest.mark.parametrize("n", [0, 1, 7, 50, 99, 100, 500])
def test_sample_size_is_exact(spark, n):
    asked = spark.createDataFrame([(i, "hard" if i % 3 == 0 else f"d{i % 4}") for i in range(100)], "question_id int, difficulty string")
    picked = runs.stratified_sample(asked, n).collect()
    assert len(picked) == len({r["question_id"] for r in picked}) == min(n, 100)
    if 0 < n < 100:
        hard = sum(r["difficulty"] == "hard" for r in picked)
        assert hard >= n * 34 // 100
        again = {r["question_id"] for r in runs.stratified_sample(asked.repartition(3), n).collect()}
        assert again == {r["question_id"] for r in picked}


def test_attempts(spark):
    rows = [
        (1, 0, "a", [], False, "boom", 10, 1, 0.5),
        (1, 1, "b", [], False, None, 10, 1, 0.25),
        (2, 0, "c", ["no", "nope"], True, None, 10, 1, 0.5),
        *[(3, i, f"t{i}", [], False, "boom", 10, 1, 0.5) for i in range(4)],
        (4, 0, "d", ["bad"], False, None, 10, 1, 0.5),
    ]
    df = spark.createDataFrame(
        rows,
        "question_id int, attempt_no int, sql string, validation_errors array<string>, blocked boolean, execution_error string, "
        "prompt_tokens int, completion_tokens int, latency_s double",
    )
    got = {r["question_id"]: r for r in runs.attempt_rollup(df).collect()}
    assert (got[1]["end_state"], got[1]["error"], got[1]["repairs"], got[1]["history"]) == ("done", None, 1, ["a", "b"])
    assert (got[2]["end_state"], got[2]["error"]) == ("blocked", "VALIDATION: no; nope")
    assert (got[3]["end_state"], got[3]["prompt_tokens"], got[3]["latency_s"]) == ("exhausted", 40, 2.0)
    assert got[4]["end_state"] == "open"


def test_run_checks(spark):
    listing = spark.createDataFrame(
        [("a", "2", "p1"), ("a", "3", "p3"), ("a", "3", "p2"), ("b", "1", "p4")], "tag string, generated_at string, path string"
    )
    assert {r["tag"]: r["path"] for r in runs.latest_runs(listing).collect()} == {"a": "p2", "b": "p4"}
    assert [r["tag"] for r in runs.latest_runs(listing, ["b"]).collect()] == ["b"]
    covered = spark.createDataFrame([("a", 1), ("a", 2), ("b", 1)], "tag string, question_id int")
    assert [tuple(r) for r in runs.same_questions_check(covered).collect()] == [(2, "b")]
    totals = spark.createDataFrame([("a", 4, 0.5)], "tag string, questions long, soft_f1 double")
    frozen = spark.createDataFrame([("a", "questions", 4.0), ("a", "soft_f1", 0.4), ("a", "gone", 1.0)], "tag string, metric string, value double")
    moved = {r["metric"]: (r["expected"], r["actual"]) for r in runs.metric_drift(totals, frozen).collect()}
    assert moved == {"soft_f1": (0.4, 0.5), "gone": (1.0, None)}


def test_fixture_is_cut(spark):
    predictions = spark.createDataFrame([("t", i) for i in range(9)], "tag string, question_id long")
    cells = spark.createDataFrame(
        [("t", q, "pred", p * 2, [f"D:{p}"]) for q in range(9) for p in range(30)], "tag string, question_id long, side string, pos long, cells array<string>"
    )
    kept, cut = runs.freeze_fixture(predictions, cells, n=4, max_rows=20, width=8)
    assert sorted(r["question_id"] for r in kept.collect()) == [0, 1, 2, 3]
    sizes = cut.groupBy("question_id").agg(F.count("*").alias("n"), F.max("pos").alias("last")).collect()
    assert {(r["n"], r["last"]) for r in sizes} == {(20, 38)}


def test_progress_of_a_growing_log(spark):
    folder = tempfile.mkdtemp(prefix="run-")

    def add(rows):
        spark.createDataFrame(rows, progress.SCHEMA).write.mode("append").json(f"{folder}/log")

    def counts():
        progress.follow(spark, f"{folder}/log", f"{folder}/counts", f"{folder}/checkpoint")
        return {r["tag"]: (r["questions"], r["failed"], r["repaired"]) for r in progress.current(spark, f"{folder}/counts").collect()}

    add([("a", 1, "boom", 0), ("a", 2, None, 2), ("b", 1, "", 0)])
    assert counts() == {"a": (2, 1, 1), "b": (1, 0, 0)}
    add([("a", 3, "boom", 1)])
    assert counts() == {"a": (3, 2, 2), "b": (1, 0, 0)}
