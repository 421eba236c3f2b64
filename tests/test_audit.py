"""Identifier audits on a small catalog, one query per case."""

import random

import pytest
from pyspark.sql import functions as F

from plumbline.operators import audit

CATALOG = {
    "yearmonth": ["customerid", "date", "consumption"],
    "customers": ["customerid", "segment"],
    "player": ["id", "player_name"],
    "player_attributes": ["id", "ball_control"],
    "examination": ["id", "aCL IgG"],
}


def t(name, alias=None, scope="base"):
    return ("table", name, None, alias, scope)


def c(name, qualifier=None, scope="base"):
    return ("column", name, qualifier, None, scope)


def s(name):
    return ("statement", name, None, None, "base")


def op(name):
    return ("operation", name, None, None, "base")


SELECT = s("Select")
KEYS = [c("customerid", "customers"), c("customerid", "yearmonth")]
# case: (references, first kind or None)
CASES = {
    "simple": ([SELECT, t("yearmonth"), c("consumption")], None),
    "filter": ([SELECT, t("yearmonth"), c("consumption"), c("customerid")], None),
    "aliases": (
        [SELECT, t("customers", "c"), t("yearmonth", "y"), c("segment", "c"), c("consumption", "y"), c("customerid", "c"), c("customerid", "Y")],
        None,
    ),
    "unqualified_join": ([SELECT, t("customers"), t("yearmonth"), c("segment"), c("consumption"), *KEYS], None),
    "mixed_case": ([SELECT, t("Examination"), c("aCL IgG")], None),
    "star": ([SELECT, t("yearmonth"), c("*")], None),
    "unknown_table": ([SELECT, t("salez"), c("*")], "unknown_table"),
    "unknown_column": ([SELECT, t("yearmonth"), c("total")], "unknown_column"),
    "unjoined_owner": ([SELECT, t("player_attributes"), c("player_name"), c("ball_control")], "unknown_column"),
    "wrong_owner": ([SELECT, t("player_attributes", "pa"), c("player_name", "pa")], "unknown_column"),
    "unknown_qualifier": ([SELECT, t("yearmonth"), c("x", "nowhere")], None),
    "empty": ([("empty", "", None, None, "base")], "empty"),
    "unparsable": ([("parse_error", "near FROM", None, None, "base")], "parse"),
    "two_statements": ([SELECT, SELECT], "multiple"),
    "drop": ([s("Drop"), op("Drop")], "not_select"),
    "update": ([s("Update"), op("Update")], "not_select"),
    "hidden_delete": ([SELECT, t("x", None, "cte"), op("Delete"), t("salez")], "forbidden"),
    "cte": ([SELECT, t("recent", None, "cte"), t("yearmonth"), c("total", None, "alias")], None),
}
BLOCKED = {"drop", "update", "hidden_delete"}


@pytest.fixture(scope="module")
def inputs(spark):
    refs = [(name, i, *ref) for name, (refs, _) in CASES.items() for i, ref in enumerate(refs)]
    columns = [(table, col) for table, cols in CATALOG.items() for col in cols]
    return (
        spark.createDataFrame(
            refs, "query_id string, seq int, kind string, name string, qualifier string, alias string, scope_kind string"
        ),
        audit.catalog_index(spark.createDataFrame(columns, "table string, column string")),
    )


@pytest.fixture(scope="module")
def found(inputs):
    refs, catalog = inputs
    issues = audit.all_issues(refs, catalog)
    kinds = {}
    for r in issues.orderBy("level", "seq").collect():
        kinds.setdefault(r["query_id"], r)
    verdicts = {r["query_id"]: r for r in audit.audit_verdict(refs, issues).collect()}
    return kinds, verdicts


@pytest.mark.parametrize("name", CASES)
def test_case(found, name):
    kinds, verdicts = found
    expected = CASES[name][1]
    assert verdicts[name]["ok"] is (expected is None)
    assert verdicts[name]["blocked"] is (name in BLOCKED)
    if expected:
        assert kinds[name]["kind"] == expected


def test_messages(found):
    kinds, verdicts = found
    assert kinds["unjoined_owner"]["suggestion"] == "elle existe dans player"
    assert verdicts["wrong_owner"]["feedback"] == (
        "- la colonne player_name n'appartient pas à player_attributes (peut-être : elle existe dans player)"
    )
    assert verdicts["hidden_delete"]["n_issues"] == 1  # a refusal ends the audit
    assert verdicts["simple"]["feedback"] == "" and verdicts["simple"]["first_issue"] is None


def test_strict_checks_names_of_the_query_itself(inputs):
    refs, catalog = inputs
    strict = audit.audit_verdict(refs, audit.all_issues(refs, catalog, strict=True)).filter("query_id = 'cte'").collect()[0]
    assert strict["n_issues"] == 2 and strict["first_issue"] == "la table recent n'existe pas"


def test_closest_table_is_containment(spark, inputs):
    _, catalog = inputs
    tables = sorted(CATALOG)
    names = ["play", "players", "customer", "CUSTOMERS_2", "zzz", "player_attributes_old", "a", "date", ""]
    df = spark.createDataFrame([(n,) for n in names], "name string")
    got = {r["name"]: r["suggestion"] for r in audit.closest_table(df, catalog).collect()}
    for n in names:
        low = n.lower()
        want = next((x for x in tables if low and (low in x or x in low)), None)
        assert got.get(n) == want


def _sequential(rows):
    """The list as one pass over the questions fills it."""
    taken = []
    for q, failed, ok, correct in rows:
        if failed and not ok:
            if len(taken) < 5:
                taken.append(q)
        elif failed:
            if len(taken) < 8:
                taken.append(q)
        elif correct and not ok:
            taken.append(q)
    return taken


@pytest.mark.parametrize("seed", range(4))
def test_examples_and_confusion(spark, seed):
    rng = random.Random(seed)
    rows = [(i, rng.random() < 0.5, rng.random() < 0.6, rng.random() < 0.5) for i in range(60)]
    predictions = spark.createDataFrame(
        [("t", q, f"q{q}", "boom" if failed else None) for q, failed, _, _ in rows],
        "tag string, question_id long, query_id string, execution_error string",
    )
    verdicts = spark.createDataFrame(
        [(f"q{q}", ok, None if ok else "bad") for q, _, ok, _ in rows], "query_id string, ok boolean, first_issue string"
    )
    matches = spark.createDataFrame([("t", q, right and not failed) for q, failed, _, right in rows], "tag string, question_id long, correct boolean")
    examples = audit.audit_examples(predictions, verdicts, matches)
    assert [r["question_id"] for r in examples.orderBy("question_id").collect()] == _sequential(
        [(q, f, ok, right and not f) for q, f, ok, right in rows]
    )
    total = audit.audit_confusion(predictions, verdicts, matches).collect()[0]
    caught = sum(f and not ok for _, f, ok, _ in rows)
    failed = sum(f for _, f, _, _ in rows)
    assert (total["caught"], total["sql_errors"]) == (caught, failed)
    assert total["detection_rate"] == round(caught / failed, 3)
    assert total["false_positives"] == sum(r and not f and not ok for _, f, ok, r in rows)


def test_no_failures_give_rate_zero(spark):
    predictions = spark.createDataFrame([("t", 1, "q", None)], "tag string, question_id long, query_id string, execution_error string")
    verdicts = spark.createDataFrame([("q", True, None)], "query_id string, ok boolean, first_issue string")
    matches = spark.createDataFrame([("t", 1, True)], "tag string, question_id long, correct boolean")
    assert audit.audit_confusion(predictions, verdicts, matches).select(F.col("detection_rate")).collect()[0][0] == 0.0
