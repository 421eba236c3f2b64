"""Scoring of result sets: execution match, soft F1, categories, summaries.

Inputs are long tables:

    predictions   one row per (tag, question_id): scalars, execution_error,
                  gold_error, pred_is_null, gold_is_null
    result_cells  one row per result row: (tag, question_id, side, pos, cells);
                  side is 'pred' or 'gold', pos orders the rows of a result and
                  cells holds the encoded values

Rows are grouped on the whole row value; only scoring holds the rows of a
question as lists, and only of questions of at most `LIST_WIDTH` rows. A run is
what the columns `run` say, the tag alone unless stated otherwise.
"""

from __future__ import annotations

from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plumbline.functions.ranking import BUCKET_WIDTH, dense_positions, large_groups, split_groups
from plumbline.functions.rounding import round_half_even
from plumbline.session import stored

# The columns that tell runs apart; where files of one tag are several runs, pass their path as well.
TAG = ["tag"]
RUN = ["question_id", *TAG]
# A question of more rows is not held as a list.
LIST_WIDTH = 16_384
# Before each cell of a row written as text; a row without cells at all.
MARK = "\u0001"
NO_ROW = "N"
CATEGORIES = ["correct", "wrong_result", "sql_error", "gold_failed"]


def question_key(run: list[str]) -> list[str]:
    """The long key first: sorts compare it by prefix, which few distinct tags would defeat."""
    return ["question_id", *run]


def _sides(cells: DataFrame, key: list[str]) -> DataFrame:
    """One row per distinct result row, with its first position on each side."""
    position = F.col("pos").cast("bigint")
    return cells.groupBy(*key, "cells").agg(
        F.min(F.when(F.col("side") == "pred", position)).alias("pred_pos"),
        F.min(F.when(F.col("side") == "gold", position)).alias("gold_pos"),
    )


def _nested(cells: Column) -> Column:
    return F.exists(cells, lambda c: c.startswith("U:"))


def execution_match(predictions: DataFrame, cells: DataFrame, run: list[str] = TAG) -> DataFrame:
    """Whether both results hold the same set of rows: (run, question_id, correct)."""
    key = question_key(run)
    differing = (
        _sides(cells, key)
        .filter(F.col("pred_pos").isNull() | F.col("gold_pos").isNull() | _nested(F.col("cells")))
        .groupBy(*key)
        .agg(F.count("*").alias("n_differing"))
    )
    same = ~F.col("pred_is_null") & ~F.col("gold_is_null") & F.col("n_differing").isNull()
    return predictions.join(differing, key, "left").select(*key, same.alias("correct"))


def dedupe_rows(cells: DataFrame, width: int = BUCKET_WIDTH, run: list[str] = TAG) -> DataFrame:
    """Distinct rows of each result in first-seen order, renumbered from 0.

    A result of at most `width` rows is numbered where it was shuffled to.
    """
    key = [*question_key(run), "side"]

    def distinct(rows: DataFrame) -> DataFrame:
        return rows.groupBy(*key, "cells").agg(F.min(F.col("pos").cast("bigint")).alias("first_pos"))

    def numbered(rows: DataFrame) -> DataFrame:
        nth = F.row_number().over(W.partitionBy(*key).orderBy("first_pos"))
        return distinct(rows.repartition(*key)).select(*key, "cells", (nth.cast("bigint") - 1).alias("pos"))

    large = large_groups(cells, key, width)
    if large is None:
        return numbered(cells)
    few, many = split_groups(cells, key, large)
    placed = dense_positions(stored(distinct(many), "distinct-rows"), key, "first_pos", "pos", width).drop("first_pos")
    return numbered(few).unionByName(placed)


def row_similarity(pred: Column, gold: Column) -> dict[str, Column]:
    """Matching, prediction-only and gold-only cells over the gold width."""
    width = F.size(gold)
    hits = F.size(F.filter(pred, lambda c: F.array_contains(gold, c)))
    extra = F.size(pred) - hits
    lost = width - F.size(F.filter(gold, lambda c: F.array_contains(pred, c)))
    empty = width == 0
    return {
        name: F.when(empty, F.lit(0.0)).otherwise(n / width)
        for name, n in {"matches": hits, "pred_only": extra, "gold_only": lost}.items()
    }


def _differing(sides: DataFrame) -> DataFrame:
    return sides.withColumn(
        "differs", F.col("pred_pos").isNull() | F.col("gold_pos").isNull() | _nested(F.col("cells"))
    )


def _paired_in_place(cells: DataFrame, key: list[str]) -> DataFrame:
    """Pairs of questions that one task each can sort: rows are shuffled once, by question."""
    sides = _differing(_sides(cells.repartition(*key), key))

    def nth(side: str) -> Column:
        at = F.row_number().over(W.partitionBy(*key).orderBy(F.asc_nulls_last(f"{side}_pos"))).cast("bigint") - 1
        return F.when(F.col(f"{side}_pos").isNotNull(), at)

    def half(side: str) -> Column:
        def put(name: str, value: Column) -> Column:
            kept = value if name == side else F.when(F.lit(False), value)
            return kept.alias(name)

        # Questions without an id pair with nothing.
        alone = F.when(reduce(or_, [F.col(k).isNull() for k in key]), F.lit(side))
        return F.struct(F.col(f"{side}_at").alias("pos"), alone.alias("alone"), put("pred", F.col("cells")), put("gold", F.col("cells")), "differs")

    placed = sides.withColumn("pred_at", nth("pred")).withColumn("gold_at", nth("gold"))
    halves = placed.select(*key, F.explode(F.array(half("pred"), half("gold"))).alias("h")).filter("h.pos IS NOT NULL")
    given = {side: F.col(f"h.{side}").isNotNull() for side in ("pred", "gold")}
    return (
        halves.groupBy(*key, F.col("h.pos").alias("pos"), F.col("h.alone").alias("alone"))
        .agg(
            F.max("h.pred").alias("pred"),
            F.max("h.gold").alias("gold"),
            *[F.max(F.when(g, F.col("h.differs"))).alias(f"{side}_differs") for side, g in given.items()],
        )
        .select(*key, "pos", "pred", "pred_differs", "gold", "gold_differs")
    )


def _paired_by_buckets(cells: DataFrame, key: list[str], width: int) -> DataFrame:
    """Pairs of questions with more rows than one task should sort."""
    # Read four times below, twice of them without the cells, hence stored.
    sides = stored(_differing(_sides(cells, key)), "result-rows")

    def numbered(side: str) -> DataFrame:
        rows = sides.filter(F.col(f"{side}_pos").isNotNull()).select(
            *key, F.col(f"{side}_pos").alias("at"), F.col("cells").alias(side), F.col("differs").alias(f"{side}_differs")
        )
        return dense_positions(rows, key, "at", "pos", width).drop("at")

    return numbered("pred").join(numbered("gold"), [*key, "pos"], "full_outer")


def paired_rows(cells: DataFrame, width: int = BUCKET_WIDTH, run: list[str] = TAG) -> DataFrame:
    """Deduplicated rows of both sides paired by position.

    (run, question_id, pos, pred, gold, pred_differs, gold_differs); a side
    without a row at that position is null. `cells` is read twice, so it should
    be stored where it is dear.
    """
    key = question_key(run)
    large = large_groups(cells, key, width)
    if large is None:
        return _paired_in_place(cells, key)
    few, many = split_groups(cells, key, large)
    return _paired_in_place(few, key).unionByName(_paired_by_buckets(many, key, width))


def _row_text(cells: Column) -> Column:
    """A row as one text that no other row has: texts are hashed and compared as a whole, arrays of arrays aren't.

    Cells follow a mark each; rows that hold the mark, a null or nothing are
    written in hex instead.
    """
    digits = F.transform(cells, lambda c: F.coalesce(F.hex(c), F.lit("-")))
    return (
        F.when(cells.isNull(), F.lit(NO_ROW))
        .when((F.size(cells) == 0) | F.array_join(cells, "", MARK).contains(MARK), F.concat(F.lit("X"), F.array_join(digits, ",")))
        .otherwise(F.concat(F.lit(MARK), F.array_join(cells, MARK)))
    )


def _text_row(text: Column) -> Column:
    """The cells of a `_row_text`."""
    digits = F.split(F.substring(text, 2, 2**31 - 1), ",")
    return (
        F.when(text.startswith(MARK), F.split(F.substring(text, 2, 2**31 - 1), MARK))
        .when(text == "X", F.array().cast("array<string>"))
        .when(text.startswith("X"), F.transform(digits, lambda d: F.when(d != "-", F.unhex(d).cast("string"))))
    )


def _pair_sums(pred: Column, gold: Column) -> dict[str, Column]:
    """Shares of true positives, false positives and false negatives of one pair of rows."""
    shares = row_similarity(pred, gold)
    both = pred.isNotNull() & gold.isNotNull()
    return {
        "tp": F.when(both, shares["matches"]).otherwise(F.lit(0.0)),
        "fp": F.when(both, shares["pred_only"]).when(gold.isNull(), F.lit(1.0)).otherwise(F.lit(0.0)),
        "fn": F.when(both, shares["gold_only"]).when(pred.isNull(), F.lit(1.0)).otherwise(F.lit(0.0)),
    }


def _sums_in_place(cells: DataFrame, key: list[str]) -> DataFrame:
    """Sums of questions of which a task can hold the rows: shuffled once and sorted once, by question."""
    known = reduce(and_, [F.col(k).isNotNull() for k in key])  # others meet no prediction
    rows = cells.filter(known & F.col("pos").isNotNull() & F.col("side").isin("pred", "gold")).select(
        *key, (F.col("side") == "pred").alias("of_pred"), F.col("pos").cast("bigint").alias("pos"), _row_text(F.col("cells")).alias("text")
    )

    def side(of_pred: Column) -> Column:
        return F.collect_list(F.when(of_pred, F.struct("pos", "text")))

    def first_seen(name: str) -> Column:
        return F.array_distinct(F.transform(F.sort_array(name), lambda r: r["text"])).alias(name)

    lists = (
        rows.repartition(*key)
        .groupBy(*key)
        .agg(side(F.col("of_pred")).alias("pred"), side(~F.col("of_pred")).alias("gold"))
        .select(*key, first_seen("pred"), first_seen("gold"))
    )
    return _sums_of_lists(lists, key)


def _sums_of_lists(lists: DataFrame, kept: list[str]) -> DataFrame:
    """The columns `kept` and the sums of questions with their distinct rows as lists of texts, `pred` and `gold`."""
    pred, gold = F.col("pred"), F.col("gold")
    plain = F.forall(pred, lambda t: t.startswith(MARK))
    # Equal rows in equal order are whole matches and need no look at their cells.
    shares = F.when(
        ~((pred == gold) & plain),
        F.zip_with(
            F.transform(pred, _text_row),
            F.transform(gold, _text_row),
            lambda p, g: F.struct(*[v.alias(n) for n, v in _pair_sums(p, g).items()]),
        ),
    )

    def total(name: str, same: Column) -> Column:
        added = F.aggregate("shares", F.lit(0.0), lambda n, s: n + s[name])
        return F.when(F.col("shares").isNull(), same).otherwise(added).alias(name)

    known_pred, known_gold = F.array_remove(pred, NO_ROW), F.array_remove(gold, NO_ROW)
    other = (F.size(known_pred) != F.size(known_gold)) | (F.size(F.array_except(known_pred, known_gold)) > 0)
    nested = F.exists(pred, lambda t: F.when(t.startswith(MARK), t.contains(f"{MARK}U:")).otherwise(F.coalesce(_nested(_text_row(t)), F.lit(False))))
    return lists.withColumn("shares", shares).select(
        *kept,
        total("tp", F.size(pred).cast("double")),
        total("fp", F.lit(0.0)),
        total("fn", F.lit(0.0)),
        (F.size(known_pred) > 0).cast("int").alias("has_pred"),
        (F.size(known_gold) > 0).cast("int").alias("has_gold"),
        (F.when(pred == gold, F.lit(False)).otherwise(other) | nested).alias("differs"),
    )


def _sums_of_pairs(pairs: DataFrame, key: list[str]) -> DataFrame:
    """Sums of questions with more rows than one task should hold."""
    pred, gold = F.col("pred"), F.col("gold")
    return (
        pairs.select(
            *key,
            (F.coalesce("pred_differs", F.lit(False)) | F.coalesce("gold_differs", F.lit(False))).alias("differs"),
            *[v.alias(n) for n, v in _pair_sums(pred, gold).items()],
            pred.isNotNull().cast("int").alias("has_pred"),
            gold.isNotNull().cast("int").alias("has_gold"),
        )
        .groupBy(*key)
        .agg(
            F.sum("tp").alias("tp"),
            F.sum("fp").alias("fp"),
            F.sum("fn").alias("fn"),
            F.max("has_pred").alias("has_pred"),
            F.max("has_gold").alias("has_gold"),
            F.bool_or("differs").alias("differs"),
        )
    )


def _row_sums(cells: DataFrame, width: int, run: list[str]) -> DataFrame:
    """Per question: true/false positives and negatives, and whether the row sets differ."""
    key = question_key(run)
    large = large_groups(cells, key, min(width, LIST_WIDTH))
    if large is None:
        return _sums_in_place(cells, key)
    few, many = split_groups(cells, key, large)
    return _sums_in_place(few, key).unionByName(_sums_of_pairs(_paired_by_buckets(many, key, width), key))


def _scores(predictions: DataFrame, cells: DataFrame, width: int, run: list[str]) -> DataFrame:
    """Match flag and unrounded soft F1 from one pass over the cells."""
    sums = predictions.join(_row_sums(cells, width, run), question_key(run), "left")
    return _scored(sums, [predictions[c] for c in predictions.columns])


def _scored(sums: DataFrame, kept: list[Column]) -> DataFrame:
    tp, fp, fn = (F.coalesce(F.col(c), F.lit(0.0)) for c in ("tp", "fp", "fn"))
    precision, recall = tp / (tp + fp), tp / (tp + fn)
    no_pred = F.coalesce(F.col("has_pred"), F.lit(0)) == 0
    no_gold = F.coalesce(F.col("has_gold"), F.lit(0)) == 0
    # Nothing on either side scores 1, and that is decided before a missing
    # result is: a failed query against an empty gold result scores 1.
    f1 = (
        F.when(no_pred & no_gold, F.lit(1.0))
        .when(F.col("pred_is_null") | F.col("gold_is_null") | (tp == 0), F.lit(0.0))
        .otherwise(2 * precision * recall / (precision + recall))
    )
    same = ~F.col("pred_is_null") & ~F.col("gold_is_null") & ~F.coalesce(F.col("differs"), F.lit(False))
    return sums.select(*kept, same.alias("_match"), f1.alias("_f1"))


def _scores_in_place(predictions: DataFrame, cells: DataFrame, width: int, run: list[str]) -> DataFrame:
    """`_scores` of predictions that hold their rows as lists, too: nothing but the keys is shuffled.

    Questions that come more than once, whose rows count together, and those of
    too many rows go by their cells.
    """
    key = question_key(run)
    scalars = [c for c in predictions.columns if c not in ("pred", "gold")]
    known = reduce(and_, [F.col(k).isNotNull() for k in key])

    def rows(side: str) -> Column:
        # A question without an id has no rows, as none meet it.
        return F.when(known & F.col(side).isNotNull(), F.col(side)).otherwise(F.array().cast("array<array<string>>"))

    n_rows = F.size(rows("pred")) + F.size(rows("gold"))

    def gathered(some: DataFrame, by: list[str]) -> DataFrame:
        found = some.groupBy(*by).agg(F.count("*").alias("_n"), F.max("_rows").alias("_rows"))
        return found.filter((F.col("_n") > 1) | (F.col("_rows") > min(width, LIST_WIDTH))).select(*by)

    # Counted by a hash of the run first, whose names are long; only what that finds is counted on its own.
    sizes = predictions.filter(known).select(*key, F.xxhash64(*run).alias("_run"), n_rows.alias("_rows"))
    found = stored(gathered(sizes, ["question_id", "_run"]), "gathered-questions")

    def in_place(some: DataFrame) -> DataFrame:
        lists = [F.array_distinct(F.transform(rows(side), _row_text)).alias(side) for side in ("pred", "gold")]
        return _scored(_sums_of_lists(some.select(*scalars, *lists), scalars), [F.col(c) for c in scalars])

    if found.isEmpty():
        return in_place(predictions)
    long = stored(gathered(sizes.join(found, ["question_id", "_run"], "left_semi"), key), "long-questions")
    few, many = split_groups(predictions, key, long)
    other = _scores(many.select(*scalars), split_groups(cells, key, long)[1], width, run)
    return in_place(few).unionByName(other)


def soft_f1(predictions: DataFrame, cells: DataFrame, width: int = BUCKET_WIDTH, run: list[str] = TAG) -> DataFrame:
    """Cell-level F1 with rows paired by position: (run, question_id, soft_f1)."""
    return _scores(predictions, cells, width, run).select(*question_key(run), F.col("_f1").alias("soft_f1"))


def categorize(correct: Column, gold_error: Column, execution_error: Column) -> Column:
    """One of the four categories; an empty error text counts as no error."""
    return (
        F.when(correct, "correct")
        .when(F.coalesce(gold_error, F.lit("")) != "", "gold_failed")
        .when(F.coalesce(execution_error, F.lit("")) != "", "sql_error")
        .otherwise("wrong_result")
    )


def evaluate_questions(
    predictions: DataFrame, cells: DataFrame, width: int = BUCKET_WIDTH, run: list[str] = TAG
) -> DataFrame:
    """One scored record per (run, question_id).

    Predictions that come with their rows, as lists `pred` and `gold` of which
    `cells` are the rows, are scored where they lie.
    """
    gold_ok = F.coalesce(F.col("gold_error"), F.lit("")) == ""
    correct = gold_ok & F.col("_match")
    scores = _scores_in_place if {"pred", "gold"} <= {*predictions.columns} else _scores
    return scores(predictions, cells, width, run).select(
        *question_key(run),
        "db_id",
        "difficulty",
        correct.alias("correct"),
        F.when(gold_ok, round_half_even(F.col("_f1"), 4)).otherwise(F.lit(0.0)).alias("soft_f1"),
        categorize(correct, F.col("gold_error"), F.col("execution_error")).alias("category"),
        F.col("execution_error").isNull().alias("executed"),
        "prompt_tokens",
        "completion_tokens",
        "latency_s",
    )


def _rate(n: Column, total: Column, digits: int = 4) -> Column:
    """n / total, rounded; null for an empty run."""
    return F.when(total > 0, round_half_even(n / total, digits))


def _exact_sum(column: str, digits: int) -> Column:
    """A decimal sum: the same whatever the order in which partitions arrive."""
    return F.sum(F.col(column).cast(f"decimal(20,{digits})")).cast("double")


def summary(results: DataFrame, run: list[str] = TAG) -> DataFrame:
    """One row per run: accuracy, soft F1, share of queries that ran, latency."""
    n = F.col("questions")
    return (
        results.groupBy(*run)
        .agg(
            F.count("*").alias("questions"),
            F.count_if("correct").alias("n_correct"),
            _exact_sum("soft_f1", 4).alias("f1_sum"),
            F.count_if("executed").alias("executed_ok"),
            _exact_sum("latency_s", 9).alias("latency_sum"),
        )
        .select(
            *run,
            "questions",
            _rate(F.col("n_correct"), n).alias("execution_accuracy"),
            _rate(F.col("f1_sum"), n).alias("soft_f1"),
            _rate(F.col("executed_ok"), n).alias("valid_sql_rate"),
            "executed_ok",
            _rate(F.col("latency_sum"), n, 3).alias("latency_mean_s"),
        )
    )


def breakdown(results: DataFrame, run: list[str] = TAG) -> DataFrame:
    """Questions per category, one column each, zero where none."""
    return results.groupBy(*run).agg(
        *[F.count_if(F.col("category") == c).alias(c) for c in CATEGORIES]
    )


def by_difficulty(results: DataFrame, with_total: bool = False, run: list[str] = TAG) -> DataFrame:
    """Accuracy and soft F1 per difficulty; `with_total` adds the run total as 'all'."""
    grouped = results.rollup(*run, "difficulty") if with_total else results.groupBy(*run, "difficulty")
    level = F.grouping("difficulty") if with_total else F.lit(0)
    # Coarser levels than a run are left out; a run whose own columns are null is not one of them.
    above = F.grouping(run[-1]) if with_total else F.lit(0)
    n = F.col("total")
    counted = grouped.agg(
        level.alias("_level"),
        above.alias("_above"),
        F.count("*").alias("total"),
        F.count_if("correct").alias("n_correct"),
        _exact_sum("soft_f1", 4).alias("f1_sum"),
    ).filter("_above = 0")
    return counted.select(
        *run,
        F.when(F.col("_level") == 1, "all").otherwise(F.col("difficulty")).alias("difficulty"),
        "total",
        F.col("n_correct").alias("correct"),
        _rate(F.col("n_correct"), n).alias("execution_accuracy"),
        _rate(F.col("f1_sum"), n).alias("soft_f1"),
    )


def token_usage(results: DataFrame, run: list[str] = TAG) -> DataFrame:
    """Token totals and rounded means per question."""
    prompt, completion = F.col("prompt_total"), F.col("completion_total")
    return (
        results.groupBy(*run)
        .agg(
            F.sum("prompt_tokens").alias("prompt_total"),
            F.sum("completion_tokens").alias("completion_total"),
            F.count("*").alias("n"),
        )
        .select(
            *run,
            prompt.alias("prompt_total"),
            completion.alias("completion_total"),
            (prompt + completion).alias("total"),
            F.bround(prompt / F.col("n")).cast("bigint").alias("prompt_per_question"),
            F.bround(completion / F.col("n")).cast("bigint").alias("completion_per_question"),
        )
    )


def eval_invariants(results: DataFrame, run: list[str] = TAG) -> DataFrame:
    """Violations per run: uncategorised questions and correct ones that never ran."""
    return results.groupBy(*run).agg(
        F.count("*").alias("questions"),
        F.count_if(~F.coalesce(F.col("category"), F.lit("")).isin(CATEGORIES)).alias("uncategorised"),
        F.count_if(F.col("correct") & ~F.col("executed")).alias("correct_not_executed"),
    )
