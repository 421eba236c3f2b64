"""The catalog of the given tables, and questions asked of it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.operators import profile, render
from plumbline.plans.tables import FOREIGN_KEYS, PRIMARY_KEYS, load, load_all
from plumbline.session import cut


def profiles(spark: SparkSession, sf_dir: str, with_samples: bool = True) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Profiles are made once and read often: one row per column and per table."""
    columns, counts, fk = profile.catalog_profile(load_all(spark, sf_dir), PRIMARY_KEYS, FOREIGN_KEYS, with_samples)
    return cut(columns), cut(counts), fk


def descriptions(table_profile: DataFrame) -> DataFrame:
    """(table, description) from the row counts; the smallest tables have none."""
    text = F.concat(F.lit("Stores "), "table", F.lit(" records, "), F.col("n_rows").cast("string"), F.lit(" in number."))
    return table_profile.filter("n_rows > 5").select("table", text.alias("description"))


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, text) of every table."""
    columns, counts, _ = profiles(spark, sf_dir)
    return render.searchable_text(columns, descriptions(counts))


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(question_id, question, evidence, gold array<string>), one per customer."""
    key = F.col("c_custkey")
    segment, nation = F.col("c_mktsegment"), F.col("c_nationkey").cast("string")
    case = key % 3
    return load(spark, sf_dir, "customer").select(
        key.alias("question_id"),
        F.when(case == 0, F.concat(F.lit("Total price of the orders placed by customers in segment "), segment))
        .when(case == 1, F.concat(F.lit("Which supplier ships parts of size "), nation, F.lit(" in each lineitem?")))
        .otherwise(F.concat(F.lit("How many documents with quality labels exist per source and language for nation "), nation))
        .alias("question"),
        F.when(key % 2 == 0, F.concat(F.lit("balance above "), F.floor("c_acctbal").cast("string"))).otherwise("").alias("evidence"),
        F.when(case == 0, F.array(F.lit("customer"), F.lit("orders")))
        .when(case == 1, F.array(F.lit("lineitem"), F.lit("part"), F.lit("supplier")))
        .otherwise(F.array(F.lit("documents"), F.lit("labels")))
        .alias("gold"),
    )
