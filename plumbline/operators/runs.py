"""Operators over whole runs: comparison, drift, fixtures, samples, attempt logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plumbline.functions.ranking import BUCKET_WIDTH, dense_positions, running_sum, smallest_by_hash
from plumbline.functions.rounding import decimal_text
from plumbline.operators.evaluate import RUN
from plumbline.session import cut

# Header of the comparison table and the prefix of an error that
# comes from validation rather than execution.
COMPARISON_HEADER = "| Run | Modèle | Tables | EX | Soft F1 | Tokens/q | Latence |"
COMPARISON_RULE = "|---|---|---|---|---|---|---|"
VALIDATION_PREFIX = "VALIDATION: "


def latest_runs(runs: DataFrame, tags: list[str] | None = None) -> DataFrame:
    """The newest run per tag; on equal stamps the first path. `tags` filters."""
    newest = W.partitionBy("tag").orderBy(F.desc("generated_at"), F.asc("path"))
    kept = runs if tags is None else runs.filter(F.col("tag").isin(tags))
    return kept.withColumn("_nth", F.row_number().over(newest)).filter("_nth = 1").drop("_nth")


def compare_runs(config: DataFrame, summary: DataFrame, tokens: DataFrame) -> DataFrame:
    """(tag, line): one formatted line per run."""
    joined = config.join(summary.drop("questions"), "tag").join(
        tokens.select("tag", "prompt_per_question"), "tag"
    )
    ex = F.concat(F.lit("**"), decimal_text(F.col("execution_accuracy"), 4), F.lit("**"))
    latency = F.concat(decimal_text(F.col("latency_mean_s"), 3), F.lit("s"))
    fields: list[Column] = [
        F.col("tag"),
        F.col("model"),
        F.col("tables_in_prompt").cast("string"),
        ex,
        decimal_text(F.col("soft_f1"), 4),
        F.col("prompt_per_question").cast("string"),
        latency,
    ]
    line = F.concat(F.lit("| "), F.concat_ws(" | ", *fields), F.lit(" |"))
    return joined.select("tag", line.alias("line"))


def write_comparison(lines: DataFrame, path: str) -> None:
    """Write the comparison as a Markdown text table, runs in tag order."""
    spark = lines.sparkSession
    head = spark.createDataFrame(
        [(0, "", COMPARISON_HEADER), (1, "", COMPARISON_RULE)], "part int, tag string, line string"
    )
    body = lines.select(F.lit(2).alias("part"), "tag", "line")
    ordered = head.unionByName(body).orderBy("part", "tag").select("line")
    # One line per run, so a single file is small.
    ordered.coalesce(1).write.mode("overwrite").text(path)


def same_questions_check(results: DataFrame) -> DataFrame:
    """(question_id, missing_from): questions some run of the comparison lacks."""
    tags = results.select("tag").distinct()
    wanted = tags.agg(F.array_sort(F.collect_set("tag")).alias("tags")).scalar()
    return (
        results.groupBy("question_id")
        # At most one entry per run.
        .agg(F.collect_set("tag").alias("seen"))
        .select("question_id", F.explode(F.array_except(wanted, F.col("seen"))).alias("missing_from"))
    )


def metric_drift(summary: DataFrame, expected: DataFrame) -> DataFrame:
    """Metrics that moved. `expected` is (tag, metric, value); a lost metric counts as moved."""
    metrics = [c for c in summary.columns if c != "tag"]
    pairs = F.array(
        *[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics]
    )
    actual = summary.select("tag", F.explode(pairs).alias("m")).select("tag", "m.metric", "m.value")
    return (
        expected.select("tag", "metric", F.col("value").cast("double").alias("expected"))
        .join(actual, ["tag", "metric"], "left")
        .filter(~F.col("expected").eqNullSafe(F.col("value")))
        .select("tag", "metric", "expected", F.col("value").alias("actual"))
    )


def freeze_fixture(
    predictions: DataFrame, cells: DataFrame, n: int = 50, max_rows: int = 20, width: int = BUCKET_WIDTH
) -> tuple[DataFrame, DataFrame]:
    """The first n predictions of each run by question id, results cut to max_rows rows."""
    order = W.partitionBy("tag").orderBy("question_id")
    chosen = (
        predictions.withColumn("_nth", F.row_number().over(order)).filter(F.col("_nth") <= n).drop("_nth")
    )
    few = cells.join(chosen.select(*RUN), RUN, "left_semi")
    numbered = dense_positions(few, [*RUN, "side"], "pos", "_row", width)
    return chosen, numbered.filter(F.col("_row") < max_rows).drop("_row")


def stratified_sample(
    questions: DataFrame, n: int, seed: int = 42, stratum: str = "difficulty", key: str = "question_id"
) -> DataFrame:
    """Exactly n rows: floor(n * group / total) per stratum, the rest from what is left.

    The smallest digests of seed and key win, so the choice is reproducible.
    With n at or above the number of rows everything is returned.
    """
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")))
    total = questions.agg(F.count("*").alias("n")).scalar()
    sizes = questions.groupBy(stratum).agg(F.count("*").alias("_size"))
    share = F.least(F.floor(F.lit(n) * F.col("_size") / total), F.col("_size")).cast("bigint")
    shares = cut(sizes.select(stratum, share.alias("quota")))
    hashed = questions.withColumn("_digest", digest)
    picked = smallest_by_hash(hashed, [stratum], "_digest", shares, [key])
    rest = hashed.join(picked.select(key), key, "left_anti").withColumn("_all", F.lit(0))
    left_over = F.least(F.lit(n).cast("bigint"), total) - F.coalesce(
        shares.agg(F.sum("quota").alias("s")).scalar(), F.lit(0)
    )
    one = questions.sparkSession.range(1).select(F.lit(0).alias("_all"), left_over.alias("quota"))
    extra = smallest_by_hash(rest, ["_all"], "_digest", one, [key])
    columns = questions.columns
    return picked.select(*columns).unionByName(extra.select(*columns))


def attempt_rollup(attempts: DataFrame, max_repairs: int = 3) -> DataFrame:
    """Fold an attempt log to one record per question.

    `attempts` holds one row per generation: (question_id, attempt_no from 0,
    sql, validation_errors array<string>, blocked, execution_error,
    prompt_tokens, completion_tokens, latency_s). The loop makes at most
    1 + max_repairs generations, which bounds `history`.
    """
    last = F.max_by(
        F.struct("sql", "validation_errors", "blocked", "execution_error", "attempt_no"), F.col("attempt_no")
    )
    folded = attempts.groupBy("question_id").agg(
        last.alias("last"),
        F.sum("prompt_tokens").alias("prompt_tokens"),
        F.sum("completion_tokens").alias("completion_tokens"),
        F.sum("latency_s").alias("latency_sum"),
        F.array_sort(F.collect_list(F.struct("attempt_no", "sql"))).alias("log"),
    )
    failed_run = F.coalesce(F.col("last.execution_error"), F.lit("")) != ""
    invalid = F.size(F.coalesce(F.col("last.validation_errors"), F.array().cast("array<string>"))) > 0
    error = F.when(failed_run, F.col("last.execution_error")).when(
        invalid, F.concat(F.lit(VALIDATION_PREFIX), F.array_join("last.validation_errors", "; "))
    )
    state = (
        F.when(~failed_run & ~invalid, "done")
        .when(F.col("last.blocked"), "blocked")
        .when(F.col("last.attempt_no") >= max_repairs, "exhausted")
        .otherwise("open")
    )
    return folded.select(
        "question_id",
        F.col("last.sql").alias("sql"),
        error.alias("error"),
        F.col("last.attempt_no").cast("int").alias("repairs"),
        "prompt_tokens",
        "completion_tokens",
        F.bround("latency_sum", 3).alias("latency_s"),
        F.transform("log", lambda e: e.sql).alias("history"),
        state.alias("end_state"),
    )


def failure_counts(predictions: DataFrame) -> DataFrame:
    """Failed and repaired questions per run, and the repairs spent."""
    return predictions.groupBy("tag").agg(
        F.count("*").alias("questions"),
        F.count_if(F.coalesce(F.col("execution_error"), F.lit("")) != "").alias("failed"),
        F.count_if(F.col("attempts") > 0).alias("repaired"),
        F.sum("attempts").alias("repairs"),
    )


def running_failures(predictions: DataFrame, width: int = BUCKET_WIDTH) -> DataFrame:
    """The same counts as they stood after each question, in question order."""
    failed = (F.coalesce(F.col("execution_error"), F.lit("")) != "").cast("bigint")
    base = predictions.select("tag", "question_id", failed.alias("is_failed"), (F.col("attempts") > 0).cast("bigint").alias("is_repaired"))
    return running_sum(
        base,
        ["tag"],
        "question_id",
        {"done": F.lit(1).cast("bigint"), "failed": F.col("is_failed"), "repaired": F.col("is_repaired")},
        width,
    ).drop("is_failed", "is_repaired")
