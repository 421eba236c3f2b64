"""Registered queries: evaluation and runs, on the derived prediction log."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions.frames import union_all
from plumbline.operators import evaluate as ev
from plumbline.operators import runs
from plumbline.plans import derived
from plumbline.plans.tables import load
from plumbline.session import cut, stored

Query = Callable[[SparkSession, str], DataFrame]


def _row_text(df: DataFrame) -> DataFrame:
    return df.withColumn("row_text", F.array_join("cells", "|")).drop("cells")


def _log(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    return derived.predictions(spark, sf), derived.result_cells(spark, sf)


def _scored_log(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """The log for scoring, which reads the cells twice: the lines behind them are gathered once."""
    lines = stored(derived.result_lines(spark, sf), "result-lines")
    return derived.predictions(spark, sf), derived.result_cells(spark, sf, lines=lines)


def results(spark: SparkSession, sf: str) -> DataFrame:
    return ev.evaluate_questions(*_scored_log(spark, sf))


def _row_similarity(spark: SparkSession, sf: str) -> DataFrame:
    pairs = ev.paired_rows(derived.result_cells(spark, sf))
    shares = ev.row_similarity(F.col("pred"), F.col("gold"))
    return pairs.filter("pred IS NOT NULL AND gold IS NOT NULL").select(
        *ev.RUN, "pos", *[c.alias(n) for n, c in shares.items()]
    )


def _soft_f1(spark: SparkSession, sf: str) -> DataFrame:
    return ev.soft_f1(*_scored_log(spark, sf)).withColumn("soft_f1", F.round("soft_f1", 9))


def _categories(spark: SparkSession, sf: str) -> DataFrame:
    scored = derived.predictions(spark, sf).join(ev.execution_match(*_log(spark, sf)), ev.RUN)
    correct = F.col("gold_error").isNull() & F.col("correct")
    category = ev.categorize(correct, F.col("gold_error"), F.col("execution_error"))
    return scored.groupBy("tag", category.alias("category")).agg(F.count("*").alias("n"))


def _compare_runs(spark: SparkSession, sf: str) -> DataFrame:
    # Read twice below.
    scored = stored(results(spark, sf), "scored")
    return runs.compare_runs(derived.run_config(spark, sf), ev.summary(scored), ev.token_usage(scored))


def _latest_runs(spark: SparkSession, sf: str) -> DataFrame:
    listing = load(spark, sf, "orders").select(
        F.col("o_orderstatus").alias("tag"),
        F.date_format("o_orderdate", "yyyyMMdd-HHmmss").alias("generated_at"),
        F.concat(F.lit("reports/"), "o_orderstatus", F.lit("/evaluation-"), "o_orderkey", F.lit(".json")).alias("path"),
    )
    return runs.latest_runs(listing)


def _same_questions(spark: SparkSession, sf: str) -> DataFrame:
    covered = [
        load(spark, sf, t).select(F.lit(t).alias("tag"), F.col("doc_id").alias("question_id"))
        for t in ("documents", "labels")
    ]
    return runs.same_questions_check(union_all(covered))


def _metric_drift(spark: SparkSession, sf: str) -> DataFrame:
    totals = cut(ev.summary(results(spark, sf)))
    metrics = [c for c in totals.columns if c != "tag"]
    frozen = (
        totals.filter("tag = 'baseline'")
        .withColumns({m: F.col(m).cast("double") for m in metrics})
        .unpivot("tag", metrics, "metric", "value")
        .withColumn("tag", F.lit("agent"))
    )
    return runs.metric_drift(totals, frozen)


def _freeze_fixture(spark: SparkSession, sf: str) -> DataFrame:
    _, cells = runs.freeze_fixture(*_log(spark, sf), n=50, max_rows=20)
    return _row_text(cells)


def _sample(spark: SparkSession, sf: str) -> DataFrame:
    return runs.stratified_sample(derived.questions(spark, sf), n=500).select("question_id", "difficulty")


def _attempts(spark: SparkSession, sf: str) -> DataFrame:
    """An attempt log of the agent run: its repairs, and why each try failed."""
    key, made, no = F.col("question_id"), F.col("attempts"), F.col("attempt_no")
    blocked = key % 13 == 0
    tries = F.when(blocked, 0).otherwise(made)
    errors = F.array(
        F.lit("la table orderz n'existe pas"),
        F.lit("la colonne total n'appartient à aucune table de la requête"),
    )
    return (
        derived.predictions(spark, sf)
        .filter("tag = 'agent'")
        .withColumn("attempt_no", F.explode(F.sequence(F.lit(0), tries)))
        .select(
            key,
            no,
            F.concat(F.lit("SELECT "), no.cast("string"), F.lit(" AS try_"), key.cast("string")).alias("sql"),
            F.when(blocked, F.array(F.lit("opération interdite : DELETE")))
            .when((no < made) & (no % 2 == 0), errors)
            .otherwise(F.array().cast("array<string>"))
            .alias("validation_errors"),
            blocked.alias("blocked"),
            F.when(
                ~blocked & (((no < made) & (no % 2 == 1)) | ((made == 3) & (no == 3))), "division by zero"
            ).alias("execution_error"),
            "prompt_tokens",
            "completion_tokens",
            "latency_s",
        )
    )


def _attempt_rollup(spark: SparkSession, sf: str) -> DataFrame:
    folded = runs.attempt_rollup(_attempts(spark, sf))
    return folded.withColumn("history", F.array_join("history", " ; "))


def queries() -> dict[str, Query]:
    return {
        "derived_predictions": derived.predictions,
        "derived_result_cells": lambda s, d: _row_text(derived.result_cells(s, d)),
        "execution_match": lambda s, d: ev.execution_match(*_log(s, d)),
        "dedupe_rows": lambda s, d: _row_text(ev.dedupe_rows(derived.result_cells(s, d))),
        "row_similarity": _row_similarity,
        "soft_f1": _soft_f1,
        "categorize": _categories,
        "evaluate_questions": results,
        "summary": lambda s, d: ev.summary(results(s, d)),
        "breakdown": lambda s, d: ev.breakdown(results(s, d)),
        "by_difficulty": lambda s, d: ev.by_difficulty(results(s, d)),
        "by_difficulty_with_total": lambda s, d: ev.by_difficulty(results(s, d), with_total=True),
        "token_usage": lambda s, d: ev.token_usage(results(s, d)),
        "eval_invariants": lambda s, d: ev.eval_invariants(results(s, d)),
        "compare_runs": _compare_runs,
        "latest_runs": _latest_runs,
        "same_questions_check": _same_questions,
        "metric_drift": _metric_drift,
        "freeze_fixture": _freeze_fixture,
        "stratified_sample": _sample,
        "attempt_rollup": _attempt_rollup,
        "failure_counts": lambda s, d: runs.failure_counts(derived.predictions(s, d)),
        "running_failures": lambda s, d: runs.running_failures(derived.predictions(s, d)),
    }
