"""Result comparison: one question per case, all scored in one job."""

import pytest
from pyspark.sql import functions as F

from plumbline.operators import evaluate as ev

A, B = ("Apple", 325), ("Orange", 191)
# name: (predicted, gold, match, soft F1); None in the last two is not asserted.
CASES = {
    "identical": ([A, B], [A, B], True, 1.0),
    "row_order": ([(2,), (1,)], [(1,), (2,)], True, None),
    "duplicates": ([(1,), (1,), (2,)], [(1,), (2,)], True, 1.0),
    "column_order": ([(325, "Apple")], [A], False, 1.0),
    "different_value": ([(12,)], [(1847,)], False, 0.0),
    "missing_row": ([A], [A, B], False, None),
    "float_exact": ([(1847.2999999,)], [(1847.3,)], False, None),
    "int_equals_float": ([(1.0,)], [(1,)], True, 1.0),
    "bool_equals_one": ([(True,)], [(1,)], True, 1.0),
    "text_is_not_number": ([("1",)], [(1,)], False, 0.0),
    "null_equals_null": ([(None, 1)], [(None, 1)], True, 1.0),
    "width_matters": ([(1, 2)], [(1,)], False, None),
    "no_prediction": (None, [(1,)], False, 0.0),
    "no_gold": ([(1,)], None, False, 0.0),
    "neither": (None, None, False, 1.0),
    "both_empty": ([], [], True, 1.0),
    "failed_against_empty": (None, [], False, 1.0),
    "empty_against_failed": ([], None, False, 1.0),
    "empty_against_rows": ([], [(1,)], False, 0.0),
    "nothing_shared": ([(1, 2)], [(9, 9)], False, 0.0),
    "worked_example": (
        [(325, "Apple"), (191, "Orange"), (None, "Banana")],
        [("Apple", 325), ("Orange", None), ("Banana", 119)],
        False,
        0.6667,
    ),
    "nested_cell": ([([1, 2],)], [([1, 2],)], False, None),
}


def encode(value):
    if value is None:
        return "N"
    if isinstance(value, (bool, int)):
        return f"D:{int(value)}"
    if isinstance(value, float):
        return f"D:{int(value)}" if value.is_integer() else f"D:{value!r}"
    if isinstance(value, list):
        return f"U:{value}"
    return f"S:{value}"


def frames(spark, cases):
    predictions, cells = [], []
    for i, (pred, gold) in enumerate(cases):
        predictions.append(("t", i, "db", "simple", pred is None, gold is None, None, None, 1, 1, 0.5))
        for side, rows in (("pred", pred), ("gold", gold)):
            cells += [("t", i, side, pos, [encode(v) for v in row]) for pos, row in enumerate(rows or [])]
    return (
        spark.createDataFrame(
            predictions,
            "tag string, question_id long, db_id string, difficulty string, pred_is_null boolean, gold_is_null boolean, "
            "execution_error string, gold_error string, prompt_tokens int, completion_tokens int, latency_s double",
        ),
        spark.createDataFrame(cells, "tag string, question_id long, side string, pos long, cells array<string>"),
    )


def python_f1(pred, gold):
    """Straight from the definition, row by row."""
    if not pred and not gold:
        return 1.0
    if pred is None or gold is None:
        return 0.0
    p, g = list(dict.fromkeys(pred)), list(dict.fromkeys(gold))
    tp = sum(sum(v in y for v in x) / len(y) for x, y in zip(p, g))
    fp = sum(sum(v not in y for v in x) / len(y) for x, y in zip(p, g)) + max(0, len(p) - len(g))
    fn = sum(sum(v not in x for v in y) / len(y) for x, y in zip(p, g)) + max(0, len(g) - len(p))
    return 2 * tp / (2 * tp + fp + fn) if tp else 0.0


@pytest.fixture(scope="module")
def scored(spark):
    predictions, cells = frames(spark, [c[:2] for c in CASES.values()])
    both = ev.execution_match(predictions, cells).join(ev.soft_f1(predictions, cells, width=2), ev.RUN)
    names = list(CASES)
    return {names[r["question_id"]]: (r["correct"], round(r["soft_f1"], 4)) for r in both.collect()}


@pytest.mark.parametrize("name", CASES)
def test_case(scored, name):
    _, _, match, f1 = CASES[name]
    assert scored[name][0] is match
    if f1 is not None:
        assert scored[name][1] == f1


def test_partial_scores(spark, scored):
    predictions, cells = frames(spark, [([B, A], [A, B]), ([A, B], [A])])
    reversed_rows, extra = [r["soft_f1"] for r in ev.soft_f1(predictions, cells).orderBy("question_id").collect()]
    assert reversed_rows < 1 and 0 < extra < 1


def test_one_question_with_most_rows(spark):
    """A third of all rows and more in one question, positions cut into buckets of 7."""
    import random

    rng = random.Random(3)
    big = [(rng.randrange(40), rng.randrange(5)) for _ in range(900)]
    other = [(a, b if rng.random() < 0.8 else 9) for a, b in big]
    cases = [(other, big), (big, list(reversed(big)))] + [([(i, 1)], [(i, 1)]) for i in range(20)]
    predictions, cells = frames(spark, cases)
    found = ev.soft_f1(predictions, cells, width=7).join(ev.execution_match(predictions, cells), ev.RUN).collect()
    for row in found:
        pred, gold = cases[row["question_id"]]
        assert row["soft_f1"] == pytest.approx(python_f1(pred, gold))
        assert row["correct"] == (set(pred) == set(gold))


def test_records_and_summary(spark):
    predictions, cells = frames(spark, [([A], [A]), ([A], [B]), (None, [A]), ([A], [A])])
    failed = F.when(F.col("question_id") == 2, "boom")
    gold_failed = F.when(F.col("question_id") == 3, "timeout")
    predictions = predictions.withColumns({"execution_error": failed, "gold_error": gold_failed})
    results = ev.evaluate_questions(predictions, cells)
    rows = {r["question_id"]: r for r in results.collect()}
    assert [rows[i]["category"] for i in range(4)] == ["correct", "wrong_result", "sql_error", "gold_failed"]
    assert [rows[i]["executed"] for i in range(4)] == [True, True, False, True]
    assert rows[3]["soft_f1"] == 0.0 and rows[3]["correct"] is False
    total = ev.summary(results).collect()[0]
    assert (total["questions"], total["execution_accuracy"], total["valid_sql_rate"]) == (4, 0.25, 0.75)
    assert ev.breakdown(results).collect()[0].asDict() == {
        "tag": "t", "correct": 1, "wrong_result": 1, "sql_error": 1, "gold_failed": 1,
    }
    broken = ev.eval_invariants(results).collect()[0]
    assert (broken["uncategorised"], broken["correct_not_executed"]) == (0, 0)


def test_empty_error_text_is_no_error(spark):
    df = spark.createDataFrame([(False, "", "")], "c boolean, g string, e string")
    assert df.select(ev.categorize(F.col("c"), F.col("g"), F.col("e")).alias("x")).collect()[0]["x"] == "wrong_result"
