"""The given tables and their declared keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = [
    "benchmark",
    "conversations",
    "customer",
    "documents",
    "embeddings",
    "events",
    "labels",
    "lineitem",
    "nation",
    "orders",
    "pages",
    "part",
    "region",
    "supplier",
]

# Parquet declares no keys. lineitem has none: (l_orderkey, l_linenumber) repeats.
PRIMARY_KEYS = {
    "benchmark": ["item_id"],
    "conversations": ["conv_id", "turn"],
    "customer": ["c_custkey"],
    "documents": ["doc_id"],
    "embeddings": ["vec_id"],
    "events": ["event_id"],
    "labels": ["doc_id"],
    "nation": ["n_nationkey"],
    "orders": ["o_orderkey"],
    "pages": ["page_id"],
    "part": ["p_partkey"],
    "region": ["r_regionkey"],
    "supplier": ["s_suppkey"],
}

# (table, its columns, referenced table, referenced columns), paired by position.
FOREIGN_KEYS = [
    ("customer", ["c_nationkey"], "nation", ["n_nationkey"]),
    ("labels", ["doc_id"], "documents", ["doc_id"]),
    ("lineitem", ["l_orderkey"], "orders", ["o_orderkey"]),
    ("lineitem", ["l_partkey"], "part", ["p_partkey"]),
    ("lineitem", ["l_suppkey"], "supplier", ["s_suppkey"]),
    ("nation", ["n_regionkey"], "region", ["r_regionkey"]),
    ("orders", ["o_custkey"], "customer", ["c_custkey"]),
    ("supplier", ["s_nationkey"], "nation", ["n_nationkey"]),
]


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def load_all(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return {name: load(spark, sf_dir, name) for name in TABLES}
