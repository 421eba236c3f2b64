"""Registered queries: profiles of the given tables and texts made from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions import text
from plumbline.functions.frames import union_all
from plumbline.operators import dependencies, profile, render
from plumbline.plans import catalog
from plumbline.plans.registry_eval import Query
from plumbline.plans.tables import FOREIGN_KEYS, PRIMARY_KEYS, load, load_all


def _samples_text(df: DataFrame) -> DataFrame:
    return df.withColumn("sample_values", F.array_join("sample_values", "|"))


def _foreign_keys(spark: SparkSession, sf: str) -> DataFrame:
    return profile.foreign_keys(spark, FOREIGN_KEYS).join(profile.row_counts(load_all(spark, sf)), "table")


def _fk_discovery(spark: SparkSession, sf: str) -> DataFrame:
    tables = load_all(spark, sf)
    return profile.fk_discovery(tables, profile.fk_candidates(tables, PRIMARY_KEYS))


def _composite_keys(spark: SparkSession, sf: str) -> DataFrame:
    found = dependencies.unique_sets(load_all(spark, sf))
    return found.select("table", F.array_join("columns", ", ").alias("columns"), F.size("columns").alias("n_columns"))


def _catalog_profile(spark: SparkSession, sf: str) -> DataFrame:
    columns, counts, fk = catalog.profiles(spark, sf)
    return _samples_text(columns).join(counts, "table").join(fk, ["table", "column"], "left")


def _quote_identifier(spark: SparkSession, sf: str) -> DataFrame:
    part, events, documents = (load(spark, sf, t) for t in ("part", "events", "documents"))
    names = union_all(
        [part.select(F.col(c).alias("name")) for c in ("p_name", "p_brand", "p_type")]
        + [events.select(F.col("event_type").alias("name"))]
        + [documents.select(c.alias("name")) for c in (F.col("source"), F.concat_ws("_", "lang", "source"))]
    )
    return names.groupBy("name", text.quote_identifier(F.col("name")).alias("quoted")).agg(F.count("*").alias("n"))


def _extract_sql(spark: SparkSession, sf: str) -> DataFrame:
    key, fence = F.col("o_orderkey"), "```"
    gold = F.concat(F.lit("SELECT * FROM lineitem WHERE l_orderkey = "), key.cast("string"))
    case = key % 5
    completion = (
        F.when(case == 0, gold)
        .when(case == 1, F.concat(F.lit(f"{fence}sql\n"), gold, F.lit(f";\n{fence}")))
        .when(case == 2, F.concat(F.lit(f"Here it is:\n{fence}SQL "), gold, F.lit(f" ;; {fence} done")))
        .when(case == 3, F.concat(F.lit("  "), gold, F.lit(";;\n")))
        .otherwise(F.lit(f"{fence}\nSELECT 1\n{fence} or {fence}sql SELECT 2{fence}"))
    )
    return load(spark, sf, "orders").select(key, text.extract_sql(completion).alias("sql_text"))


def ddl(spark: SparkSession, sf: str) -> DataFrame:
    columns, _, fk = catalog.profiles(spark, sf)
    return render.render_table(columns, fk)


def _describe_context(spark: SparkSession, sf: str) -> DataFrame:
    columns, counts, fk = catalog.profiles(spark, sf)
    return render.describe_context(render.render_table(columns, fk), counts, fk)


def queries() -> dict[str, Query]:
    return {
        "profile_columns": lambda s, d: profile.profile_columns(load_all(s, d), measure_nulls=True),
        "row_counts": lambda s, d: profile.row_counts(load_all(s, d)),
        "sample_values": lambda s, d: _samples_text(profile.sample_values(load_all(s, d), PRIMARY_KEYS)),
        "primary_keys": lambda s, d: profile.primary_keys(load_all(s, d)),
        "composite_keys": _composite_keys,
        "inclusions": lambda s, d: dependencies.inclusions(load_all(s, d)),
        "partial_inclusions": lambda s, d: dependencies.inclusions(load_all(s, d), min_coverage=0.8),
        "foreign_keys": _foreign_keys,
        "fk_discovery": _fk_discovery,
        "catalog_profile": _catalog_profile,
        "catalog_summary": lambda s, d: profile.catalog_summary(*catalog.profiles(s, d)),
        "largest_tables": lambda s, d: profile.largest_tables(profile.row_counts(load_all(s, d))),
        "table_detail": lambda s, d: profile.table_detail(*catalog.profiles(s, d)),
        "quote_identifier": _quote_identifier,
        "estimate_tokens": lambda s, d: load(s, d, "documents").select(
            "doc_id", text.estimate_tokens(F.col("text")).alias("est_tokens")
        ),
        "extract_sql": _extract_sql,
        "render_table": ddl,
        "full_schema": lambda s, d: render.full_schema(ddl(s, d)),
        "searchable_text": catalog.corpus,
        "describe_context": _describe_context,
    }
