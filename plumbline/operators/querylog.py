"""Running the queries of a log and assembling predictions from them."""

from __future__ import annotations

import uuid
from concurrent.futures import ThreadPoolExecutor
from itertools import islice

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plumbline.functions.cells import cells_of
from plumbline.session import scratch_path

ROW_LIMIT = 1000
JOBS_AT_A_TIME = 4
BATCH = 256
# Signs that the cluster failed, not the query.
CLUSTER_FAULTS = ("ExecutorLostFailure", "FetchFailed", "No space left on device", "OutOfMemoryError", "SparkContext was shut down")
_CELLS = "query_id string, pos bigint, cells array<string>"
_OUTCOMES = "query_id string, error string"


def row_cap(df: DataFrame, n: int = ROW_LIMIT) -> DataFrame:
    """At most n rows; a smaller limit of the query stays in force."""
    return df.limit(n)


def subquery(spark: SparkSession, sql: str) -> DataFrame:
    """The query as a subquery, in which only a single SELECT parses."""
    return spark.sql(f"SELECT * FROM (\n{sql}\n) AS q")


def _cap(df: DataFrame, limit: int | None) -> DataFrame:
    """One row more than the limit shows that the result goes on."""
    return df if limit is None else row_cap(df, limit + 1)


def _run_one(spark: SparkSession, query_id: str, sql: str, limit: int | None, target: str) -> str | None:
    """Write the result of one query; its error, if it has one of its own."""
    try:
        found = subquery(spark, sql)
        # Result columns may share a name.
        named = _cap(found.toDF(*[f"c{i}" for i in range(len(found.columns))]), limit)
        named.select(
            F.lit(query_id).alias("query_id"), F.monotonically_increasing_id().alias("pos"), cells_of(named).alias("cells")
        ).write.parquet(f"{target}/run={uuid.uuid4().hex}")
        return None
    except Exception as error:  # noqa: BLE001 - a failing query is data
        text = str(error).strip()
        if any(sign in text for sign in CLUSTER_FAULTS):
            raise
        return text


def run_query_log(
    spark: SparkSession, queries: DataFrame, limit: int | None = None, path: str | None = None
) -> tuple[DataFrame, DataFrame]:
    """Run every query (query_id, sql) over the session's tables.

    Gives (result_cells, outcomes): the rows of each query with their position,
    and (query_id, error, truncated), errors being data. Results are whole
    unless the caller sets a limit; a lost executor or a full disk is no error
    of a query and is raised. A few jobs run at a time, each distributed; rows
    and outcomes go to files, not to the driver.
    """
    target = path or scratch_path(spark, "query-log")
    outcomes = scratch_path(spark, "query-outcomes")
    # Jobs that run side by side must not share an output folder.
    spark.createDataFrame([], _CELLS).write.mode("append").parquet(f"{target}/run=none")
    spark.createDataFrame([], _OUTCOMES).write.mode("append").parquet(outcomes)
    log = queries.select(F.col("query_id").cast("string").alias("query_id"), "sql").toLocalIterator()
    with ThreadPoolExecutor(JOBS_AT_A_TIME) as jobs:
        while batch := list(islice(log, BATCH)):
            errors = jobs.map(lambda r: _run_one(spark, r["query_id"], r["sql"], limit, target), batch)
            done = [(r["query_id"], e) for r, e in zip(batch, errors)]
            spark.createDataFrame(done, _OUTCOMES).coalesce(1).write.mode("append").parquet(outcomes)
    cells = _dense(spark.read.schema(_CELLS).parquet(target).select("query_id", "pos", "cells"))
    status = spark.read.schema(_OUTCOMES).parquet(outcomes)
    if limit is None:
        return cells, status.select("query_id", "error", F.lit(False).alias("truncated"))
    cut = cells.filter(F.col("pos") >= limit).select("query_id").distinct().withColumn("cut", F.lit(True))
    return (
        cells.filter(F.col("pos") < limit),
        status.join(cut, "query_id", "left").select(
            "query_id", "error", F.coalesce("cut", F.lit(False)).alias("truncated")
        ),
    )


def _dense(cells: DataFrame) -> DataFrame:
    """Positions 0, 1, 2, ... from ids that count within each partition of a result, in its upper bits."""
    part = F.shiftright("pos", 33)
    sizes = cells.groupBy("query_id", part.alias("part")).agg(F.count("*").alias("n"))
    # One row for each task that wrote rows of the query.
    before = W.partitionBy("query_id").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.select("query_id", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    inside = F.col("pos").bitwiseAND(F.lit((1 << 33) - 1))
    return (
        cells.withColumn("part", part)
        .join(offsets, ["query_id", "part"])
        .select("query_id", (inside + F.col("offset")).alias("pos"), "cells")
    )


def gold_once(
    spark: SparkSession, questions: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """Run the gold query of each question id once, whole, however many runs ask it.

    Gives (question_id, pos, cells) and (question_id, error, truncated).
    """
    once = questions.dropDuplicates(["question_id"]).select(F.col("question_id").alias("query_id"), F.col("gold_sql").alias("sql"))
    cells, outcomes = run_query_log(spark, once)
    key = F.col("query_id").cast(questions.schema["question_id"].dataType).alias("question_id")
    return cells.select(key, "pos", "cells"), outcomes.select(key, "error", "truncated")


def prediction_log(
    questions: DataFrame,
    completions: DataFrame,
    run_cells: DataFrame,
    run_outcomes: DataFrame,
    gold_cells: DataFrame,
    gold_outcomes: DataFrame,
) -> tuple[DataFrame, DataFrame]:
    """(predictions, result_cells) from what was asked, answered, run and expected.

    completions: (tag, question_id, query_id, predicted_sql, prompt_tokens,
    completion_tokens, latency_s, attempts); run_* are keyed by query_id and
    gold_* by question_id, so gold results are shared by all runs.
    """
    ran = run_outcomes.select("query_id", F.col("error").alias("execution_error"), F.col("truncated").alias("pred_truncated"))
    gold = gold_outcomes.select("question_id", F.col("error").alias("gold_error"), F.col("truncated").alias("gold_truncated"))
    predictions = (
        completions.join(questions, "question_id")
        .join(ran, "query_id", "left")
        .join(gold, "question_id", "left")
        .select(
            "tag",
            "question_id",
            "db_id",
            "difficulty",
            "question",
            "evidence",
            "predicted_sql",
            "execution_error",
            "gold_sql",
            "gold_error",
            "prompt_tokens",
            "completion_tokens",
            "latency_s",
            "attempts",
            F.col("execution_error").isNotNull().alias("pred_is_null"),
            F.col("gold_error").isNotNull().alias("gold_is_null"),
            "pred_truncated",
            "gold_truncated",
        )
    )
    asked = completions.select("tag", "question_id", "query_id")
    pred = asked.join(run_cells, "query_id").select("tag", "question_id", F.lit("pred").alias("side"), "pos", "cells")
    right = asked.join(gold_cells, "question_id").select("tag", "question_id", F.lit("gold").alias("side"), "pos", "cells")
    return predictions, pred.unionByName(right)
