"""Question files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The fields of a question file.
SCHEMA = "question_id bigint, db_id string, question string, evidence string, SQL string, difficulty string"


def load_questions(spark: SparkSession, path: str | list[str], multi_line: bool = True) -> DataFrame:
    """(question_id, db_id, question, evidence, gold_sql, difficulty).

    A JSON array per file, or one object per line with multi_line=False, which
    splits over tasks. Without evidence it is '', without difficulty 'unknown'.
    """
    raw = spark.read.schema(SCHEMA).option("multiLine", multi_line).json(path)
    return raw.select(
        "question_id",
        "db_id",
        "question",
        F.coalesce("evidence", F.lit("")).alias("evidence"),
        F.col("SQL").alias("gold_sql"),
        F.coalesce("difficulty", F.lit("unknown")).alias("difficulty"),
    )


def write_questions(questions: DataFrame, path: str) -> None:
    """One JSON object per line."""
    questions.withColumnRenamed("gold_sql", "SQL").write.mode("errorifexists").json(path)
