"""Files as runs: provenance, two runs of one tag, stored evaluations."""

import json

import pytest

from plumbline.operators import evaluate as ev
from plumbline.operators import runs
from plumbline.sources import predictions as pr
from plumbline.sources import runs as rn

CONFIG = {
    "provider": "p", "model": "m", "mode": "agent", "evidence": True, "tables_in_prompt": 3, "max_attempts": 2, "wall_time_s": 1.5,
}


def entry(question, predicted, gold, **more):
    return {
        "question_id": question, "db_id": "d", "difficulty": "simple", "question": "q", "evidence": "", "predicted_sql": "s",
        "predicted_rows": predicted, "execution_error": None, "gold_sql": "g", "gold_rows": gold, "gold_error": None,
        "prompt_tokens": 10, "completion_tokens": 4, "latency_s": 0.5, "attempts": 0, **more,
    }


@pytest.fixture
def root(tmp_path):
    """Indented files by tag, as one process writes them: two of tag a, one of b without questions."""

    def put(tag, stamp, entries):
        (tmp_path / tag).mkdir(exist_ok=True)
        body = {"config": {"tag": tag, "generated_at": stamp, "questions": len(entries), **CONFIG}, "predictions": entries}
        (tmp_path / tag / f"predictions-{stamp}.json").write_text(json.dumps(body, indent=2))

    put("a", "20240101-000000", [entry(1, [[1]], [[1.0]]), entry(2, None, [["x"]], execution_error="no"), entry(3, [[None, 2]], [[2, 5]])])
    put("a", "20240102-000000", [entry(1, [[2]], [[1]]), entry(2, [], [], difficulty="hard")])
    put("b", "20240101-000000", [])
    (tmp_path / "a" / "notes-predictions.json").write_text("{}")
    return str(tmp_path)


def by_file(df):
    return {r["run"].rsplit("/", 2)[-2] + "/" + r["run"].rsplit("-", 2)[-2]: r for r in df.collect()}


def test_two_files_of_a_tag_are_two_runs(spark, root):
    config, predictions, cells = rn.read_runs(spark, root)
    assert {k: (r.tag, r.model, r.questions) for k, r in by_file(config).items()} == {
        "a/20240101": ("a", "m", 3), "a/20240102": ("a", "m", 2), "b/20240101": ("b", "m", 0),
    }
    assert predictions.count() == 5 and sorted(map(tuple, cells.filter("question_id = 3").select("side", "pos", "cells").collect())) == [
        ("gold", 0, ["D:2", "D:5"]), ("pred", 0, ["N", "D:2"]),
    ]
    scored = ev.evaluate_questions(predictions, cells, run=rn.RUN)
    summary = by_file(ev.summary(scored, rn.RUN))
    assert {k: (r.questions, r.execution_accuracy, r.executed_ok) for k, r in summary.items()} == {
        "a/20240101": (3, 0.3333, 2), "a/20240102": (2, 0.5, 2),
    }
    # By tag alone the same files would be one run, in which questions meet foreign rows.
    assert ev.summary(ev.evaluate_questions(predictions, cells)).count() == 1


def test_evaluations_round_trip(spark, root, tmp_path):
    config, predictions, cells = rn.read_runs(spark, root)
    scored = ev.evaluate_questions(predictions, cells, run=rn.RUN)
    out = str(tmp_path / "out")
    rn.write_evaluations(config, scored, out, rn.RUN, per_document=1)
    kept = rn.read_evaluations(spark, out, multi_line=False)
    assert kept.config.count() == 3
    newest = {r.tag: r for r in runs.latest_runs(kept.config).collect()}
    assert newest["a"].generated_at == "20240102-000000" and newest["a"].path == newest["a"].run and "evaluation-20240102" in newest["a"].path
    summary = {r.run: r for r in kept.summary.collect()}
    last = summary[newest["a"].run]
    assert (last.questions, last.correct, last.wrong_result, last.prompt_total, last.latency_mean_s) == (2, 1, 1, 20, 0.5)
    assert summary[newest["b"].run].questions is None
    levels = {(r.difficulty, r.total) for r in kept.by_difficulty.filter(f"run = '{newest['a'].run}'").collect()}
    assert levels == {("simple", 1), ("hard", 1)}
    key = ["question_id", "category", "soft_f1", "executed"]
    assert sorted(map(tuple, kept.results.select(*key).collect())) == sorted(map(tuple, scored.select(*key).collect()))


def test_files_of_others_are_read(spark, tmp_path):
    """One indented document, with the summary as a single process writes it."""
    (tmp_path / "t").mkdir()
    body = {
        "config": {"tag": "t", "generated_at": "20240105-000000", **CONFIG},
        "summary": {
            "questions": 1, "execution_accuracy": 1.0, "soft_f1": 1.0, "valid_sql_rate": 1.0, "executed_ok": 1,
            "breakdown": {"correct": 1, "wrong_result": 0, "sql_error": 0, "gold_failed": 0},
            "by_difficulty": {"simple": {"total": 1, "correct": 1, "execution_accuracy": 1.0, "soft_f1": 1.0}},
            "latency_mean_s": 0.5,
            "tokens": {"prompt_total": 9, "completion_total": 1, "total": 10, "prompt_per_question": 9, "completion_per_question": 1},
        },
        "results": [{"question_id": 7, "correct": True, "soft_f1": 1.0, "category": "correct", "executed": True}],
    }
    (tmp_path / "t" / "evaluation-20240105-000000.json").write_text(json.dumps(body, indent=2))
    kept = rn.read_evaluations(spark, str(tmp_path))
    row = kept.summary.first()
    assert (row.tag, row.total, row.correct, row.soft_f1) == ("t", 10, 1, 1.0)
    assert kept.results.first().question_id == 7 and kept.by_difficulty.first().difficulty == "simple"


def test_writing_runs(spark, root, tmp_path):
    """Documents of few questions each, whatever the ids, give the same tables; names that clash are refused."""
    config, predictions, cells = rn.read_runs(spark, root)
    out = str(tmp_path / "again")
    rn.write_runs(config, predictions, cells, out, rn.RUN, per_document=2)
    again = rn.read_runs(spark, out, multi_line=False)
    assert again[0].count() == 3
    for before, after in ((predictions, again[1]), (cells, again[2])):
        strip = [c for c in before.columns if c != "run"]
        assert sorted(map(str, after.select(*strip).collect())) == sorted(map(str, before.select(*strip).collect()))
    with pytest.raises(ValueError, match="2 runs of tag a"):
        rn.write_runs(config.withColumn("generated_at", config.model), predictions, cells, str(tmp_path / "clash"), rn.RUN)
    tables = str(tmp_path / "tables")
    pr.write_predictions(config, predictions, cells, tables, ["tag", "run"])
    assert pr.read_log(spark, tables, ["tag", "run"])[1].select("run").distinct().count() == 2


def odd_entries(root):
    """Questions that come twice in a run or lack an id, rows that come twice, hold marks, nothing or arrays, are null or don't exist."""
    long = [[i % 7, f"t{i}"] for i in range(30)]
    entries = [
        entry(1, [[1], [1], [2]], [[2], [1]]), entry(1, [[3]], [[3]]), entry(2, long, long[::-1]), entry(3, None, []), entry(4, [], []),
        entry(5, [["\u0001a", None], []], [["\u0001a", None], []]), entry(6, [[[1]]], [[[1]]]), entry(None, [[1]], [[2]]), entry(None, None, [[2]]),
        entry(7, [None, [1, "x]\"["]], [[1, "x]\"["]]), entry(8, [[1]], None, gold_error="late"), entry(9, [[True, 1.5]], [[1, "1.5"]]),
    ]
    (root / "a").mkdir()
    for stamp, some in (("20240101-000000", entries), ("20240102-000000", entries[1:])):
        body = {"config": {"tag": "a", "generated_at": stamp, "questions": len(some), **CONFIG}, "predictions": some}
        (root / "a" / f"predictions-{stamp}.json").write_text(json.dumps(body))
    return str(root)


def test_rows_at_hand_score_like_cells(spark, tmp_path, monkeypatch):
    root = odd_entries(tmp_path)
    monkeypatch.setattr(ev, "LIST_WIDTH", 40)  # question 2 has 60 rows
    by_cells = ev.evaluate_questions(*rn.read_runs(spark, root)[1:], run=rn.RUN)
    by_rows = ev.evaluate_questions(*rn.read_runs(spark, root, with_rows=True)[1:], run=rn.RUN)
    assert by_rows.dtypes == by_cells.dtypes
    got, want = (sorted(map(repr, df.collect())) for df in (by_rows, by_cells))
    assert len(got) == 23 and got == want


def test_rows_at_hand_are_not_shuffled(spark, root):
    _, predictions, cells = rn.read_runs(spark, root, with_rows=True)
    scored = ev.evaluate_questions(predictions, cells, run=rn.RUN)
    assert "Exchange" not in scored._jdf.queryExecution().executedPlan().toString()
    assert scored.count() == 5


def test_bodies_hold_the_entries_of_predictions(spark, tmp_path):
    _, predictions, cells = rn.read_runs(spark, odd_entries(tmp_path))
    predictions = predictions.unionByName(predictions.filter("question_id = 4"))
    cells = cells.unionByName(cells.filter("question_id = 9").withColumn("question_id", cells.question_id + 90))  # rows that nobody asked for
    bodies = pr.prediction_bodies(predictions, cells, rn.F.coalesce("question_id", rn.F.lit(0)) % 3, rn.RUN)
    got = [e for r in bodies.collect() for e in json.loads(f"[{r.body}]")]
    want = [json.loads(r.json) for r in pr.prediction_json(predictions, cells, rn.RUN).collect()]
    plain = lambda entries: sorted(json.dumps(e, sort_keys=True) for e in entries)
    assert len(got) == 25 and plain(got) == plain(want)
    # Texts with their rows stay in the chunk: its rows come from one shuffle, over which no text is joined.
    plan = bodies._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.index("Window") < plan.index("REPARTITION_BY_COL")


def test_only_the_first_entry_of_a_document_repeats_its_config(spark, root, monkeypatch):
    kept = {}
    real = rn.stored
    monkeypatch.setattr(rn, "stored", lambda df, name, *more: kept.setdefault(name, real(df, name, *more)))
    config, _, _ = rn.read_runs(spark, root)
    assert config.count() == 3
    assert kept["run-entries"].filter("config IS NOT NULL").count() == 3 and kept["run-entries"].count() == 6
