"""Registered queries: files, query logs and the SQL workload."""

from __future__ import annotations

from functools import partial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.operators import evaluate as ev
from plumbline.operators import profile, querylog, runs
from plumbline.plans import catalog, derived, workload
from plumbline.plans.registry_eval import Query, _row_text, results
from plumbline.plans.tables import TABLES, load, load_all
from plumbline.session import scratch_path, stored
from plumbline.sources import predictions as pr
from plumbline.sources import questions as qs
from plumbline.sources import reports as rp
from plumbline.sources import runs as rn

QUESTIONS_PER_FILE = 500


def _load_questions(spark: SparkSession, sf: str) -> DataFrame:
    """Questions written as a file and read back; some lack evidence or difficulty."""
    path = scratch_path(spark, "questions")
    key = F.col("question_id")
    partly = derived.questions(spark, sf).select(
        "question_id",
        "db_id",
        "question",
        F.when(F.col("evidence") != "", F.col("evidence")).alias("evidence"),
        "gold_sql",
        F.when(key % 10 != 0, F.col("difficulty")).alias("difficulty"),
    )
    qs.write_questions(partly, path)
    return qs.load_questions(spark, path, multi_line=False)


def write_prediction_files(spark: SparkSession, sf: str, path: str) -> None:
    """Prediction documents of five hundred questions each, one per line."""
    entries = pr.prediction_json(derived.predictions(spark, sf), derived.result_cells(spark, sf))
    chunk = F.floor(F.col("question_id") / QUESTIONS_PER_FILE)
    config = derived.run_config(spark, sf)
    documents = (
        entries.groupBy("tag", chunk.alias("chunk"))
        # At most QUESTIONS_PER_FILE entries by construction of the chunk.
        .agg(F.array_join(F.array_sort(F.collect_list("json")), ",").alias("body"))
        # One row per run.
        .join(F.broadcast(config.select("tag", F.to_json(F.struct(*config.columns)).alias("config"))), "tag")
        .select(F.concat(F.lit('{"config":'), "config", F.lit(',"predictions":['), "body", F.lit("]}")).alias("value"))
    )
    documents.write.option("compression", rn.COMPRESSION).text(path)


def _load_predictions(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "prediction-files")
    write_prediction_files(spark, sf, path)
    _, predictions, cells = pr.load_predictions(spark, path, multi_line=False)
    counted = cells.groupBy(*ev.RUN).agg(F.count("*").alias("n_rows"), F.sum(F.size("cells")).alias("n_cells"))
    return predictions.join(ev.evaluate_questions(predictions, cells).select(*ev.RUN, "category", "soft_f1"), ev.RUN).join(
        counted, ev.RUN, "left"
    ).select(*ev.RUN, "predicted_sql", "execution_error", "gold_error", "latency_s", "attempts", "n_rows", "n_cells", "category", "soft_f1")


def _write_predictions(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "prediction-log")
    pr.write_predictions(derived.run_config(spark, sf), derived.predictions(spark, sf), derived.result_cells(spark, sf), path)
    _, _, cells = pr.read_log(spark, path)
    return _row_text(cells)


def _write_evaluation(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "evaluation")
    rp.write_evaluation(derived.run_config(spark, sf), results(spark, sf), path)
    config, summary, stored = rp.read_evaluation(spark, path)
    per_tag = stored.groupBy("tag").agg(F.count("*").alias("n_results"))
    return summary.join(config.select("tag", "model", "tables_in_prompt"), "tag").join(per_tag, "tag")


def _run_files(spark: SparkSession, sf: str) -> str:
    """Two prediction files of every tag."""
    root = scratch_path(spark, "runs")
    # The lines behind the answers of all runs are gathered once.
    lines = stored(derived.result_lines(spark, sf), "result-lines")
    # Those of a question lie together; a line grows to many rows, so parts aren't joined by the size of their lines.
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    for made, stamp in ((derived.RUNS, derived.STAMP), (derived.LATER_RUNS, derived.LATER_STAMP)):
        config = derived.run_config(spark, sf, made, stamp)
        rn.write_runs(config, derived.predictions(spark, sf, made), derived.result_cells(spark, sf, made, lines.repartition(parts, "l_orderkey")), root)
    return root


def _file(column: str) -> Column:
    return F.regexp_extract(column, r"([^/=]+)$", 1).alias("file")


def _scored_runs(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """(config, results) of the prediction files, each file a run of its own."""
    config, predictions, cells = rn.read_runs(spark, _run_files(spark, sf), multi_line=False, with_rows=True)
    return config, ev.evaluate_questions(predictions, cells, run=rn.RUN)


def _run_summaries(spark: SparkSession, sf: str) -> DataFrame:
    config, scored = _scored_runs(spark, sf)
    return ev.summary(scored, rn.RUN).join(config.select("run", "generated_at"), "run").select("*", _file("run")).drop("run")


def _stored_runs(spark: SparkSession, sf: str) -> DataFrame:
    """The newest stored evaluation of each tag, with its comparison line and figures."""
    config, scored = _scored_runs(spark, sf)
    root = scratch_path(spark, "evaluations")
    rn.write_evaluations(config, scored, root, rn.RUN)
    kept = rn.read_evaluations(spark, root, multi_line=False)
    newest = runs.latest_runs(kept.config)
    figures = kept.summary.join(newest.select("run"), "run", "left_semi")
    levels = kept.by_difficulty.groupBy("run").agg(F.sum("total").alias("n_levels_total"), F.max("soft_f1").alias("best_soft_f1"))
    stored_rows = kept.results.groupBy("run").agg(F.count("*").alias("n_results"), F.count_if("correct").alias("n_correct"))
    lines = runs.compare_runs(newest, figures.drop("prompt_per_question"), figures)
    return (
        newest.select("run", "tag", "generated_at", _file("path"))
        .join(lines, "tag")
        .join(figures.select("run", "wrong_result", "sql_error", "gold_failed", F.col("total").alias("tokens")), "run")
        .join(levels, "run")
        .join(stored_rows, "run")
        .drop("run")
    )


def _latest_file(spark: SparkSession, sf: str) -> DataFrame:
    """Two stored logs per run; the newer one is found."""
    root = scratch_path(spark, "reports")
    for tag, _, _ in derived.RUNS:
        log = derived.predictions(spark, sf).filter(F.col("tag") == tag).drop("tag")
        for stamp in ("20240101-000000", "20240301-120000"):
            log.select("question_id", "execution_error").write.json(f"{root}/{tag}/predictions-{stamp}.json")
    newest = rp.latest_file(spark, root)
    return newest.select("tag", F.regexp_extract("path", r"([^/]+)$", 1).alias("file"))


def _load_descriptions(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "descriptions")
    rp.write_descriptions(catalog.descriptions(profile.row_counts(load_all(spark, sf))), path)
    return rp.load_descriptions(spark, path)


def _missing_descriptions(spark: SparkSession, sf: str) -> DataFrame:
    counts = profile.row_counts(load_all(spark, sf))
    return rp.missing_descriptions(counts, catalog.descriptions(counts))


def _serialize_rows(spark: SparkSession, sf: str) -> DataFrame:
    lines = load(spark, sf, "lineitem").withColumn("l_early", F.col("l_shipdate") < F.lit("1997-01-01").cast("timestamp_ntz"))
    return _row_text(pr.serialize_rows(lines, ["l_orderkey"], F.col("l_linenumber"))).drop("pos")


# One query per shape: aggregate, many rows, join, CTE, and three failures.
LOGGED = [
    ("by_priority", "SELECT o_orderpriority, COUNT(*) AS n FROM orders GROUP BY o_orderpriority ORDER BY o_orderpriority"),
    ("many_rows", "SELECT o_orderkey, o_orderstatus FROM orders ORDER BY o_orderkey DESC"),
    ("by_nation", "SELECT n.n_name, COUNT(*) FROM nation n JOIN customer c ON n.n_nationkey = c.c_nationkey GROUP BY n.n_name ORDER BY 1"),
    ("with_cte", "WITH big AS (SELECT l_orderkey FROM lineitem WHERE l_quantity > 25) -- large\nSELECT COUNT(*), COUNT(DISTINCT l_orderkey) FROM big"),
    ("unknown_column", "SELECT nope FROM orders"),
    ("write", "DROP TABLE orders"),
    ("runtime", "SELECT o_orderkey, ASSERT_TRUE(o_orderkey < 0) FROM orders"),
]


def _views(spark: SparkSession, sf: str) -> None:
    for name in TABLES:
        load(spark, sf, name).createOrReplaceTempView(name)


def _run(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    _views(spark, sf)
    return querylog.run_query_log(spark, spark.createDataFrame(LOGGED, "query_id string, sql string"))


def _outcomes(spark: SparkSession, sf: str) -> DataFrame:
    return _run(spark, sf)[1].select("query_id", F.col("error").isNotNull().alias("failed"), "truncated")


def _row_cap(spark: SparkSession, sf: str) -> DataFrame:
    ranked = load(spark, sf, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return querylog.row_cap(ranked, 1000)


def priority_questions(spark: SparkSession, sf: str) -> DataFrame:
    """One question per order priority, asked by both runs."""
    first = F.substring("o_orderpriority", 1, 1)
    text = F.concat(F.lit("SELECT o_orderstatus, COUNT(*) AS n FROM orders WHERE o_orderpriority = '"), "o_orderpriority", F.lit("'"))
    return load(spark, sf, "orders").select("o_orderpriority").distinct().select(
        first.cast("bigint").alias("question_id"),
        F.lit("sales").alias("db_id"),
        F.concat(F.lit("How many orders with priority "), "o_orderpriority", F.lit(" per status?")).alias("question"),
        F.lit("").alias("evidence"),
        F.concat(text, F.lit(" GROUP BY o_orderstatus ORDER BY o_orderstatus")).alias("gold_sql"),
        F.lit("simple").alias("difficulty"),
        text.alias("stem"),
    )


def _prediction_log(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    _views(spark, sf)
    asked = priority_questions(spark, sf)
    key = F.col("question_id")
    runs = F.array(*[F.struct(F.lit(t).alias("tag"), F.lit(s).alias("shift")) for t, s, _ in derived.RUNS])
    case = (key + F.col("run.shift")) % 4
    answered = asked.withColumn("run", F.explode(runs)).select(
        F.col("run.tag").alias("tag"),
        "question_id",
        F.concat_ws(":", "run.tag", key.cast("string")).alias("query_id"),
        F.when(case == 0, F.concat("stem", F.lit(" AND o_orderstatus <> 'P' GROUP BY o_orderstatus ORDER BY o_orderstatus")))
        .when(case == 1, F.concat("stem", F.lit(" GROUP BY status")))
        .otherwise(F.concat("stem", F.lit(" GROUP BY o_orderstatus ORDER BY o_orderstatus DESC")))
        .alias("predicted_sql"),
        (key * 100).cast("int").alias("prompt_tokens"),
        (key * 10).cast("int").alias("completion_tokens"),
        (key / 10).alias("latency_s"),
        F.lit(0).alias("attempts"),
    )
    questions = asked.drop("stem")
    ran = querylog.run_query_log(spark, answered.select("query_id", F.col("predicted_sql").alias("sql")))
    gold = querylog.gold_once(spark, questions)
    return querylog.prediction_log(questions, answered, *ran, *gold)


def _scored_log(spark: SparkSession, sf: str) -> DataFrame:
    predictions, cells = _prediction_log(spark, sf)
    return ev.evaluate_questions(predictions, cells).select(*ev.RUN, "category", "executed", "prompt_tokens")


def _gold_once(spark: SparkSession, sf: str) -> DataFrame:
    _views(spark, sf)
    asked = priority_questions(spark, sf)
    twice = asked.unionByName(asked)
    return _row_text(querylog.gold_once(spark, twice)[0])


def queries() -> dict[str, Query]:
    return {
        "load_questions": _load_questions,
        "load_predictions": _load_predictions,
        "write_predictions": _write_predictions,
        "write_evaluation": _write_evaluation,
        "run_summaries": _run_summaries,
        "stored_runs": _stored_runs,
        "latest_file": _latest_file,
        "load_descriptions": _load_descriptions,
        "missing_descriptions": _missing_descriptions,
        "serialize_rows": _serialize_rows,
        "run_query_log": lambda s, d: _row_text(_run(s, d)[0]),
        "query_log_outcomes": _outcomes,
        "row_cap": _row_cap,
        "gold_once": _gold_once,
        "prediction_log": _scored_log,
        **{name: partial(workload.run, name=name) for name in workload.WORKLOAD},
    }
