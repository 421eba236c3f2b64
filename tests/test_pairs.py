"""Pairs of result rows: one shuffle by question, and buckets for large ones, against plain Python."""

from pyspark.sql import functions as F

from plumbline.operators import evaluate as ev

SCHEMA = "tag string, question_id long, side string, pos long, cells array<string>"


def _rows(question, n_pred, n_gold, tag="a"):
    pred = [(tag, question, "pred", n_pred - i, [f"D:{i % 7}", f"S:{i}"]) for i in range(n_pred)]
    return pred + [(tag, question, "gold", i, [f"D:{i % 7}", f"S:{i}"]) for i in range(n_gold)] + pred[:2]


def _wanted(rows):
    first = {}
    for tag, q, side, pos, cells in rows:
        at = first.setdefault((tag, q, side), {})
        at[tuple(cells)] = min(pos, at.get(tuple(cells), pos))
    return {k: sorted(v, key=v.get) for k, v in first.items()}


def _pairs(rows):
    sides, got = _wanted(rows), []
    for tag, q in {(t, q) for t, q, *_ in rows}:
        p, g = sides.get((tag, q, "pred"), []), sides.get((tag, q, "gold"), [])
        if q is None:  # a question without an id pairs with nothing
            got += [(tag, q, i, x, None) for i, x in enumerate(p)] + [(tag, q, i, None, x) for i, x in enumerate(g)]
        else:
            got += [(tag, q, i, p[i] if i < len(p) else None, g[i] if i < len(g) else None) for i in range(max(len(p), len(g)))]
    return sorted(got, key=repr)


def test_pairs_and_positions_of_small_large_and_unnamed_questions(spark):
    rows = _rows(1, 5, 3) + _rows(2, 40, 45) + _rows(None, 4, 6) + _rows(1, 2, 9, "b") + _rows(3, 0, 2) + _rows(4, 30, 0)
    cells = spark.createDataFrame(rows, SCHEMA)
    want, places = _pairs(rows), sorted(((*k, i, x) for k, v in _wanted(rows).items() for i, x in enumerate(v)), key=repr)
    for width in (65_536, 20):
        got = [
            (r["tag"], r["question_id"], r["pos"], r["pred"] and tuple(r["pred"]), r["gold"] and tuple(r["gold"]))
            for r in ev.paired_rows(cells, width).collect()
        ]
        assert sorted(got, key=repr) == want
        kept = [(r["tag"], r["question_id"], r["side"], r["pos"], tuple(r["cells"])) for r in ev.dedupe_rows(cells, width).collect()]
        assert sorted(kept, key=repr) == places


def test_result_rows_are_shuffled_once(spark):
    cells = spark.createDataFrame(_rows(1, 5, 3), SCHEMA)
    for made in (ev.paired_rows(cells), ev.dedupe_rows(cells), ev._row_sums(cells, 65_536, ev.TAG)):
        plan = made._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == 1, plan


def test_scores_of_large_questions_equal_those_in_place(spark):
    rows = _rows(1, 5, 3) + _rows(2, 40, 45)
    cells = spark.createDataFrame(rows, SCHEMA)
    asked = cells.select("tag", "question_id").distinct().withColumns({"pred_is_null": F.lit(False), "gold_is_null": F.lit(False)})
    whole, cut = ({(r["question_id"], round(r["soft_f1"], 9)) for r in ev.soft_f1(asked, cells, w).collect()} for w in (65_536, 10))
    assert whole == cut


def _odd_rows():
    """Rows in which a mark, a null, nothing, nested values or repeats occur, and questions of one side."""
    texts = [["D:1", "S:a"], ["D:1\x01S:a"], ["\x01"], ["S:", ""], [""], [], ["D:2", None], [None], ["D:2", "-"], ["X", "N"], ["N"], ["é\x01", "D:1"], ["S:a,b", "\x01"]]
    plain = [["D:1", "S:a"], ["D:2", "S:b"], ["D:3", "S:c"], ["D:4", "S:d"]]

    def side(question, name, cells, start=0):
        return [("a", question, name, start + i, c) for i, c in enumerate(cells)]

    rows = side(1, "pred", texts) + side(1, "gold", texts)
    rows += side(2, "pred", texts[::-1]) + side(2, "gold", texts)
    rows += side(3, "pred", plain + plain) + side(3, "gold", plain)
    rows += side(4, "pred", plain[::-1]) + side(4, "gold", plain) + side(5, "pred", plain[1:]) + side(5, "gold", plain)
    rows += side(6, "pred", [["U:[1]"]]) + side(6, "gold", [["U:[1]"]]) + side(7, "pred", [["\x01", "U:{}"]]) + side(7, "gold", [["\x01", "U:{}"]])
    rows += side(8, "pred", plain) + side(9, "gold", plain) + side(10, "pred", [None, *plain]) + side(10, "gold", plain)
    rows += [("a", 11, "pred", None, ["D:1"]), ("a", 11, "gold", 1, ["D:1"]), ("a", 12, "pred", None, ["D:1"]), ("a", 12, "other", 1, ["D:1"])]
    rows += side(13, "pred", [["D:1", "D:1", "D:2"], ["S:U:"]]) + side(13, "gold", [["D:2", "D:1"], ["S:U:"]])
    return rows + side(None, "pred", plain) + side(None, "gold", plain)


def test_sums_held_as_lists_equal_those_of_pairs(spark):
    cells = spark.createDataFrame(_odd_rows(), SCHEMA)
    key = ev.question_key(ev.TAG)

    def sums(df):
        got = {r["question_id"]: tuple(r[c] for c in ("tp", "fp", "fn", "has_pred", "has_gold", "differs")) for r in df.collect()}
        return {q: (*[round(v, 9) for v in t[:3]], *t[3:]) for q, t in got.items() if q is not None}

    lists = sums(ev._sums_in_place(cells, key))
    assert lists == sums(ev._sums_of_pairs(ev._paired_in_place(cells, key), key))
    # A row that is null instead of a list of cells counts as differing there.
    known = cells.filter("cells IS NOT NULL")
    assert sums(ev._sums_in_place(known, key)) == sums(ev._sums_of_pairs(ev._paired_by_buckets(known, key, 65_536), key))
    assert lists[3] == (4.0, 0.0, 0.0, 1, 1, False) and lists[4][5] is False and lists[5][5] is True and lists[6][5] is True


def test_rows_as_texts_come_back_and_stay_apart(spark):
    rows = [c for _, _, _, _, c in _odd_rows()]
    got = spark.createDataFrame([(c,) for c in rows], "cells array<string>").select("cells", ev._row_text(F.col("cells")).alias("text"))
    back = got.withColumn("back", ev._text_row(F.col("text"))).collect()
    assert all(r["back"] == r["cells"] for r in back)
    assert len({r["text"] for r in back}) == len({repr(r["cells"]) for r in back})


def test_scoring_sorts_questions_by_id_and_no_window(spark):
    """Rows were sorted once per side and once more for their pairs."""
    plan = ev._row_sums(spark.createDataFrame(_rows(1, 5, 3), SCHEMA), 65_536, ev.TAG)._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "SortAggregate" not in plan, plan


def test_scored_log_gathers_lines_once(spark, tmp_path):
    from plumbline.plans import derived, registry_eval

    spark.createDataFrame([(1, 1, 5.0), (1, 1, 20.0), (2, 1, 3.0), (None, 1, 1.0), (3, None, None)], "l_orderkey long, l_linenumber int, l_quantity double").write.parquet(
        str(tmp_path / "lineitem.parquet")
    )
    spark.createDataFrame([(1, "1-URGENT", "O"), (2, "2-HIGH", "F"), (2, "5-LOW", "F")], "o_orderkey long, o_orderpriority string, o_orderstatus string").write.parquet(
        str(tmp_path / "orders.parquet")
    )
    _, cells = registry_eval._scored_log(spark, str(tmp_path))
    assert "l_quantity" not in cells._jdf.queryExecution().executedPlan().toString()
    rows = lambda df: sorted(map(repr, df.collect()))
    assert rows(cells) == rows(derived.result_cells(spark, str(tmp_path)))
