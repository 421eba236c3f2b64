"""Registered queries against DuckDB on the small tables.

A few of each module by default; ORACLE=all runs every query. The full check at
a larger scale is `python tests/oracle_check.py <sf_dir>`.
"""

import os

import pytest

from oracle_check import compare, connect
from plumbline.plans import oracle, registry

SF = "/root/testdata/sf0.001"
SAMPLE = [
    "by_difficulty",
    "stratified_sample",
    "attempt_rollup",
    "catalog_profile",
    "render_table",
    "dense_topk",
    "hybrid_topk",
    "select_tables",
    "audit_verdict",
    "audit_examples",
    "load_predictions",
    "run_query_log",
    "w_join_group",
]
NAMES = list(registry.queries()) if os.environ.get("ORACLE") == "all" else SAMPLE

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the given tables")


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, con, name):
    sql = oracle.sql().get(name)
    if sql is None:
        assert registry.queries()[name](spark, SF).count() >= 0
        return
    problem, _ = compare(spark, con, registry.queries()[name], sql, SF)
    assert problem == ""


def test_every_query_is_checked():
    assert set(registry.queries()) - set(oracle.sql()) == {"dense_topk_approx"}
    assert set(oracle.sql()) <= set(registry.queries())


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 6
