"""Business questions of the kind users ask, as SQL over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from plumbline.plans.tables import load

# name: (tables read, query). The same text runs in DuckDB.
WORKLOAD: dict[str, tuple[list[str], str]] = {
    "w_customer_total": (
        ["orders"],
        """SELECT o_custkey, CAST(SUM(CAST(o_totalprice AS DECIMAL(18, 2))) AS DOUBLE) AS total
FROM {orders} WHERE o_orderdate >= TIMESTAMP '1996-01-01' AND o_orderdate < TIMESTAMP '1997-01-01'
GROUP BY o_custkey""",
    ),
    "w_segment_gap": (
        ["customer"],
        """SELECT CAST(SUM(CASE WHEN c_mktsegment = 'BUILDING' THEN 1 ELSE 0 END)
  - SUM(CASE WHEN c_mktsegment = 'MACHINERY' THEN 1 ELSE 0 END) AS BIGINT) AS gap FROM {customer}""",
    ),
    "w_join_total": (
        ["lineitem", "part"],
        """SELECT p.p_brand, CAST(SUM(CAST(l.l_extendedprice AS DECIMAL(18, 2))) AS DOUBLE) AS revenue
FROM {lineitem} l JOIN {part} p ON l.l_partkey = p.p_partkey WHERE p.p_name LIKE '%bolt%' GROUP BY p.p_brand""",
    ),
    "w_filtered_count": (
        ["orders", "customer"],
        """SELECT COUNT(*) AS n FROM {orders} o JOIN {customer} c ON o.o_custkey = c.c_custkey
WHERE o.o_orderstatus = 'F' AND c.c_mktsegment = 'HOUSEHOLD' AND c.c_acctbal > 0""",
    ),
    "w_join_group": (
        ["orders", "customer", "nation"],
        """SELECT n.n_name, c.c_mktsegment, COUNT(*) AS n_orders, MAX(o.o_totalprice) AS largest
FROM {orders} o JOIN {customer} c ON o.o_custkey = c.c_custkey JOIN {nation} n ON c.c_nationkey = n.n_nationkey
GROUP BY n.n_name, c.c_mktsegment""",
    ),
    "w_percentage": (
        ["lineitem"],
        """SELECT l_returnflag, ROUND(SUM(CASE WHEN l_discount > 0.05 THEN 1 ELSE 0 END) * CAST(100.0 AS DOUBLE) / COUNT(*), 6) AS pct
FROM {lineitem} GROUP BY l_returnflag""",
    ),
    "w_date_parts": (
        ["orders"],
        """SELECT CAST(EXTRACT(YEAR FROM o_orderdate) AS INT) AS y, SUBSTR(CAST(CAST(o_orderdate AS DATE) AS VARCHAR(10)), 6, 2) AS m,
  COUNT(*) AS n FROM {orders} WHERE CAST(CAST(o_orderdate AS DATE) AS VARCHAR(10)) LIKE '199%' GROUP BY 1, 2""",
    ),
}


def run(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    tables, text = WORKLOAD[name]
    return spark.sql(text, **{t: load(spark, sf_dir, t) for t in tables})


def duckdb_sql(name: str) -> str:
    tables, text = WORKLOAD[name]
    return text.format(**{t: t for t in tables})
