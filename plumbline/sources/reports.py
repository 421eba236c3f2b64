"""Stored evaluations, newest files, table descriptions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.operators.evaluate import summary


def write_evaluation(config: DataFrame, results: DataFrame, path: str) -> None:
    """Store the config, the scored questions and their summary, per run tag.

    The summary is made from the stored results, so questions are scored once.
    """
    def put(name: str, df: DataFrame) -> None:
        df.write.mode("errorifexists").partitionBy("tag").parquet(f"{path}/{name}")

    put("config", config)
    put("results", results)
    put("summary", summary(results.sparkSession.read.parquet(f"{path}/results")))


def read_evaluation(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(config, summary, results) of stored runs."""
    config, totals, results = (
        spark.read.parquet(f"{path}/{name}").withColumn("tag", F.col("tag").cast("string"))
        for name in ("config", "summary", "results")
    )
    return config, totals, results


def latest_file(spark: SparkSession, root: str, prefix: str = "predictions-", tag: str | None = None) -> DataFrame:
    """(tag, path): per tag folder below `root` the last file or folder `<prefix>*` by name.

    Only paths are read, never contents.
    """
    listing = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path")
    pattern = rf"^(.*/([^/]+)/({prefix}[^/]+))(/|$)"
    named = listing.select(
        F.regexp_extract("path", pattern, 2).alias("tag"), F.regexp_extract("path", pattern, 1).alias("path")
    ).filter("path <> ''")
    if tag is not None:
        named = named.filter(F.col("tag") == tag)
    return named.groupBy("tag").agg(F.max("path").alias("path"))


def load_descriptions(spark: SparkSession, path: str) -> DataFrame:
    """(table, description) of JSON objects {table: description}."""
    whole = spark.read.text(path, wholetext=True)
    return whole.select(F.explode(F.from_json("value", "map<string,string>")).alias("table", "description"))


def write_descriptions(descriptions: DataFrame, path: str) -> None:
    """One JSON object; a catalog has one short text per table."""
    entries = F.array_sort(F.collect_list(F.struct("table", "description")))
    descriptions.agg(F.to_json(F.map_from_entries(entries)).alias("value")).coalesce(1).write.mode(
        "errorifexists"
    ).text(path)


def missing_descriptions(tables: DataFrame, descriptions: DataFrame, refresh: bool = False) -> DataFrame:
    """Tables without a stored description; with `refresh`, all of them."""
    if refresh:
        return tables
    return tables.join(descriptions.select("table"), "table", "left_anti")
