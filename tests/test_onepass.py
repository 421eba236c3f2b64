import random

import pytest

from plumbline.operators import audit, onepass

CATALOG = {"orders": ["o_orderkey", "o_total", "note"], "customer": ["c_custkey", "c_name", "note"], "part": ["p_size"]}
REFS = "query_id string, seq int, kind string, name string, qualifier string, alias string, scope_kind string"


@pytest.fixture(scope="module")
def inputs(spark):
    rng = random.Random(5)
    names = ["orders", "Customer", "part", "order", "parts_2", "zzz", "", None]
    columns = ["o_total", "C_NAME", "note", "p_size", "nothing", "*", "", None]
    rows = []
    for q in range(300):
        kinds = rng.choices(["statement", "operation", "table", "column", "empty", "parse_error"], [2, 0.3, 5, 6, 0.1, 0.1], k=rng.randint(1, 9))
        for seq, kind in enumerate(kinds):
            name = {
                "statement": rng.choice(["Select", "Select", "Select", "Union", "Drop"]),
                "operation": rng.choice(["Delete", "Sort"]),
                "table": rng.choice(names),
                "column": rng.choice(columns),
            }.get(kind, rng.choice(["unexpected", None]))
            qualifier = rng.choice([None, "", "o", "ORDERS", "customer", "x"]) if kind == "column" else None
            alias = rng.choice([None, "", "o", "X"]) if kind == "table" else None
            rows.append((f"q{q}", seq, kind, name, qualifier, alias, rng.choice(["base", "base", "cte", "alias", None])))
    catalog = [(t, c) for t, cs in CATALOG.items() for c in cs]
    return spark.createDataFrame(rows, REFS), audit.catalog_index(spark.createDataFrame(catalog, "table string, column string"))


def rows_of(df):
    return sorted((tuple(r) for r in df.select(sorted(df.columns)).collect()), key=repr)


@pytest.mark.parametrize("strict", [False, True])
def test_same_as_one_check_at_a_time(inputs, strict):
    refs, catalog = inputs
    issues = audit.all_issues(refs, catalog, strict)
    want = rows_of(issues)
    assert len({r[0] for r in want}) == 7
    assert rows_of(onepass.findings(refs, catalog, strict)) == want
    told = rows_of(audit.audit_verdict(refs, issues))
    assert rows_of(onepass.verdicts(refs, catalog, strict)) == told
    if strict:
        assert rows_of(onepass.verdicts(refs, catalog, strict, max_bytes=0)) == told


def test_references_are_shuffled_once(spark, inputs):
    refs, catalog = inputs
    plan = onepass.verdicts(refs, catalog)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("RepartitionByExpression") == 1
    physical = onepass.verdicts(refs, catalog)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in physical and physical.count("hashpartitioning(query_id") == 1


def test_empty_inputs(spark, inputs):
    refs, catalog = inputs
    assert onepass.verdicts(refs.limit(0), catalog).count() == 0
    empty = audit.catalog_index(spark.createDataFrame([], "table string, column string"))
    assert rows_of(onepass.findings(refs, empty)) == rows_of(audit.all_issues(refs, empty))
