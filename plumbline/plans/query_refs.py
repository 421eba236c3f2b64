"""References of one logged query per run and order, in thirteen shapes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.operators import audit, profile
from plumbline.plans import derived
from plumbline.plans.derived import RUNS
from plumbline.plans.tables import load, load_all

# case: (kind, name, qualifier, alias, scope_kind) in query order
CASES: dict[int, list[tuple[str, str, str | None, str | None, str]]] = {
    0: [("statement", "Select", None, None, "base"), ("table", "orders", None, None, "base"), ("column", "o_totalprice", None, None, "base")],
    1: [
        ("statement", "Select", None, None, "base"),
        ("table", "orders", None, "o", "base"),
        ("table", "Customer", None, "c", "base"),
        ("column", "o_custkey", "o", None, "base"),
        ("column", "C_CUSTKEY", "c", None, "base"),
        ("column", "c_mktsegment", None, None, "base"),
    ],
    2: [("statement", "Select", None, None, "base"), ("table", "orders_2024", None, None, "base"), ("column", "*", None, None, "base")],
    3: [("statement", "Select", None, None, "base"), ("table", "orders", None, None, "base"), ("column", "total", None, None, "base")],
    4: [("statement", "Select", None, None, "base"), ("table", "lineitem", None, None, "base"), ("column", "c_name", None, None, "base")],
    5: [("statement", "Select", None, None, "base"), ("table", "customer", None, "c", "base"), ("column", "o_orderdate", "c", None, "base")],
    6: [("statement", "Select", None, None, "base"), ("operation", "Delete", None, None, "base"), ("table", "salez", None, None, "base")],
    7: [("statement", "Drop", None, None, "base"), ("operation", "Drop", None, None, "base")],
    8: [("empty", "", None, None, "base")],
    9: [("parse_error", "unexpected token", None, None, "base")],
    10: [("statement", "Select", None, None, "base"), ("statement", "Delete", None, None, "base")],
    11: [
        ("statement", "Select", None, None, "base"),
        ("column", "doc_id", None, None, "base"),
        ("column", "l_tax", "x", None, "base"),
        ("table", "line", None, "x", "base"),
        ("table", "zzz", None, None, "base"),
        ("column", "TEXT", "line", None, "base"),
    ],
    12: [
        ("statement", "Select", None, None, "base"),
        ("table", "recent", None, None, "cte"),
        ("table", "orders", None, None, "base"),
        ("column", "total", None, None, "alias"),
        ("column", "o_orderkey", "recent", None, "base"),
    ],
}


def _case_rows() -> list[tuple]:
    return [(case, seq, *ref) for case, refs in CASES.items() for seq, ref in enumerate(refs)]


def refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(query_id, seq, kind, name, qualifier, alias, scope_kind); query_id is '<run>:<order>'."""
    shapes = spark.createDataFrame(
        _case_rows(), "case int, seq int, kind string, name string, qualifier string, alias string, scope_kind string"
    )
    runs = F.array(*[F.struct(F.lit(tag).alias("tag"), F.lit(shift).alias("shift")) for tag, shift, _ in RUNS])
    queries = load(spark, sf_dir, "orders").select("o_orderkey", F.explode(runs).alias("run")).select(
        F.concat_ws(":", "run.tag", F.col("o_orderkey").cast("string")).alias("query_id"),
        ((F.col("o_orderkey") + F.col("run.shift")) % len(CASES)).cast("int").alias("case"),
    )
    # The shapes are fixed, some forty rows.
    return queries.join(F.broadcast(shapes), "case").drop("case")


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.catalog_index(profile.profile_columns(load_all(spark, sf_dir)))


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived.predictions(spark, sf_dir).withColumn(
        "query_id", F.concat_ws(":", "tag", F.col("question_id").cast("string"))
    )
