"""A prediction log derived from the given tables.

Every order is a question whose gold answer lists its lines: line number,
total quantity and size class. Two runs answer each question; the order key
decides in which way an answer deviates, so all categories occur and the log
grows with the tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions.cells import encode_cell
from plumbline.plans.tables import load
from plumbline.session import spread

# (tag, shift of the deviation pattern, tables in the prompt)
RUNS = [("baseline", 0, 14), ("agent", 2, 10)]
STAMP = "20240101-000000"
# The same tags run once more, with other answers.
LATER_RUNS = [("baseline", 5, 14), ("agent", 9, 10)]
LATER_STAMP = "20240301-120000"
Runs = list[tuple[str, int, int]]


def _runs(runs: Runs) -> Column:
    return F.array(
        *[F.struct(F.lit(tag).alias("tag"), F.lit(shift).alias("shift")) for tag, shift, _ in runs]
    )


def _failed(key: Column, shift: Column) -> Column:
    return (key + shift) % 17 == 0


def _gold_failed(key: Column) -> Column:
    return key % 101 == 0


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(question_id, db_id, question, evidence, gold_sql, difficulty), one per order."""
    key = F.col("o_orderkey")
    rank = F.substring("o_orderpriority", 1, 1)
    return load(spark, sf_dir, "orders").select(
        key.alias("question_id"),
        F.lit("sales").alias("db_id"),
        F.concat(F.lit("Which lines has order "), key.cast("string"), F.lit("?")).alias("question"),
        F.when(key % 2 == 0, F.concat(F.lit("status is "), F.col("o_orderstatus"))).otherwise("").alias("evidence"),
        F.concat(
            F.lit("SELECT l_linenumber, CAST(SUM(l_quantity) AS BIGINT), CASE WHEN SUM(l_quantity) < 25 THEN 'small' ELSE 'large' END FROM lineitem WHERE l_orderkey = "),
            key.cast("string"),
            F.lit(" GROUP BY l_linenumber ORDER BY l_linenumber"),
        ).alias("gold_sql"),
        F.when(rank == "1", "challenging").when(rank.isin("2", "3"), "moderate").otherwise("simple").alias("difficulty"),
    )


def predictions(spark: SparkSession, sf_dir: str, runs: Runs = RUNS) -> DataFrame:
    key = F.col("question_id")
    failed = _failed(key, F.col("run.shift"))
    gold_failed = _gold_failed(key)
    return (
        questions(spark, sf_dir)
        .withColumn("run", F.explode(_runs(runs)))
        .select(
            F.col("run.tag").alias("tag"),
            "question_id",
            "db_id",
            "difficulty",
            "question",
            "evidence",
            F.when(failed, F.lit("SELECT 1 / 0")).otherwise(F.col("gold_sql")).alias("predicted_sql"),
            F.when(failed, F.lit("division by zero")).alias("execution_error"),
            "gold_sql",
            F.when(gold_failed, F.lit("statement timeout")).alias("gold_error"),
            (2000 + key % 700 + 7 * F.col("run.shift")).cast("int").alias("prompt_tokens"),
            (100 + key % 90).cast("int").alias("completion_tokens"),
            ((key % 3000) / F.lit(1000.0)).alias("latency_s"),
            F.when(F.col("run.shift") > 0, key % 4).otherwise(0).cast("int").alias("attempts"),
            failed.alias("pred_is_null"),
            gold_failed.alias("gold_is_null"),
        )
    )


def result_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(l_orderkey, l_linenumber, qty), one per line of an answer."""
    return (
        spread(load(spark, sf_dir, "lineitem"))
        # The aggregate combines map-side, so a huge order shrinks to its line numbers.
        .groupBy("l_orderkey", "l_linenumber")
        .agg(F.sum("l_quantity").cast("bigint").alias("qty"))
    )


def result_cells(spark: SparkSession, sf_dir: str, runs: Runs = RUNS, lines: DataFrame | None = None) -> DataFrame:
    """(tag, question_id, side, pos, cells) of both sides of every question with lines.

    `lines` are the `result_lines`, if the caller has stored them.
    """
    lines = result_lines(spark, sf_dir) if lines is None else lines
    lines = lines.withColumn("flag", F.when(F.col("qty") < 25, "small").otherwise("large"))
    big, text = T.LongType(), T.StringType()
    number = encode_cell(F.col("l_linenumber"), big)
    qty = encode_cell(F.col("qty"), big)
    more = encode_cell(F.col("qty") + 1, big)
    flag = encode_cell(F.col("flag"), text)
    pos = F.col("l_linenumber").cast("bigint")
    key, shift = F.col("l_orderkey"), F.col("run.shift")
    case = (key + shift) % 7
    answered, known = ~_failed(key, shift), ~_gold_failed(key)
    same = F.array(number, qty, flag)

    def row(side: str, present: Column, at: Column, cells: Column) -> Column:
        return F.struct(F.lit(side).alias("side"), F.when(present, at).alias("pos"), cells.alias("cells"))

    first = row(
        "pred",
        answered & ~((case == 2) & (pos == 1)),  # a line is missing
        F.when(case == 1, 1000 - pos).when(case == 5, 2 * pos).otherwise(pos),  # reversed; every row twice
        F.when(case == 3, F.array(qty, number, flag)).when(case == 4, F.array(number, more, flag)).otherwise(same),
    )
    second = row(
        "pred",
        answered & ((case == 5) | ((case == 6) & (pos == 1))),  # the second copy; a surplus row
        F.when(case == 5, 2 * pos + 1).otherwise(pos + 500),
        F.when(case == 5, same).otherwise(F.array(number, F.lit("N"), F.lit("N"))),
    )
    gold = row("gold", known, pos, same)
    return (
        lines.withColumn("run", F.explode(_runs(runs)))
        .select(F.col("run.tag").alias("tag"), key.alias("question_id"), F.explode(F.array(first, second, gold)).alias("r"))
        .select("tag", "question_id", "r.side", "r.pos", "r.cells")
        .filter(F.col("pos").isNotNull())
    )


def run_config(spark: SparkSession, sf_dir: str, runs: Runs = RUNS, stamp: str = STAMP) -> DataFrame:
    """One config row per run; the question count comes from the orders."""
    configs = F.array(
        *[
            F.struct(
                F.lit(tag).alias("tag"),
                F.lit("local").alias("provider"),
                F.lit("model-a").alias("model"),
                F.lit(tag).alias("mode"),
                F.lit(True).alias("evidence"),
                F.lit(tables).alias("tables_in_prompt"),
                F.lit(3 if shift else 0).alias("max_attempts"),
            )
            for tag, shift, tables in runs
        ]
    )
    return (
        load(spark, sf_dir, "orders")
        .agg(F.count("*").alias("questions"))
        .select(F.explode(configs).alias("r"), "questions")
        .select("r.*", "questions", F.lit(stamp).alias("generated_at"), F.lit(0.0).alias("wall_time_s"))
    )
