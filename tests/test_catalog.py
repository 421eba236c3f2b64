"""Profiles, sampling limits, DDL and prompts."""

import datetime

import pytest

from plumbline.operators import profile, render

DAY = datetime.date(2024, 1, 1)


@pytest.fixture(scope="module")
def tables(spark):
    rows = [
        (i, f"v{i % 50:02d}", f"w{i % 51:02d}", None, "x" * 40 + str(i % 3), i % 2 == 0, DAY + datetime.timedelta(days=i % 4), float(i))
        for i in range(400)
    ]
    wide = spark.createDataFrame(
        rows, "id long, fifty string, fiftyone string, nothing string, long_text string, flag boolean, day date, amount double"
    )
    empty = spark.createDataFrame([], "id long, name string")
    child = spark.createDataFrame([(i, i % 7 if i else None, 500 + i) for i in range(90)], "n int, wide_id long, other long")
    return {"wide": wide, "empty": empty, "child": child}


def test_samples(tables):
    got = {(r["table"], r["column"]): r["sample_values"] for r in profile.sample_values(tables, {"wide": ["id"]}).collect()}
    assert got == {
        ("wide", "fifty"): ["v00", "v01", "v02"],
        ("wide", "long_text"): ["x" * 40],  # equal once cut to 40 characters
        ("wide", "flag"): ["false", "true"],
        ("wide", "day"): ["2024-01-01", "2024-01-02", "2024-01-03"],
    }
    without_key = profile.sample_values(tables, {"wide": ["fifty"]})
    assert "fifty" not in {r["column"] for r in without_key.collect()}


def test_samples_of_a_column_just_above_the_limit(spark):
    """Values that share a hash bucket must not slip under the limit."""
    many = spark.createDataFrame([(f"{i}",) for i in range(3000)], "v string")
    assert profile.sample_values({"t": many}, max_distinct=2990).count() == 0
    assert profile.sample_values({"t": many}, max_distinct=3000).count() == 1


def test_counts_keys_and_columns(tables):
    counts = {r["table"]: r["n_rows"] for r in profile.row_counts(tables).collect()}
    assert counts == {"wide": 400, "empty": 0, "child": 90}
    found = {(r["table"], r["column"]) for r in profile.primary_keys(tables).filter("is_primary_key").collect()}
    assert found == {("wide", "id"), ("wide", "amount"), ("child", "n"), ("child", "other")}
    declared = profile.primary_keys(tables, {"wide": ["id", "day"]}).filter("is_primary_key").collect()
    assert {r["column"] for r in declared} == {"id", "day"}
    nulls = {(r["table"], r["column"]): r["n_nulls"] for r in profile.profile_columns(tables, measure_nulls=True).collect()}
    assert nulls[("wide", "nothing")] == 400 and nulls[("child", "wide_id")] == 1 and nulls[("empty", "id")] == 0


def test_foreign_keys(spark, tables):
    pairs = profile.foreign_keys(spark, [("a", ["x", "y"], "b", ["p", "q"])]).collect()
    assert sorted((r["column"], r["references_column"]) for r in pairs) == [("x", "p"), ("y", "q")]
    tested = {
        r["columns"]: (r["n_rows"], r["orphans"])
        for r in profile.fk_discovery(tables, [("child", ["wide_id"], "wide", ["id"]), ("child", ["other"], "wide", ["id"])]).collect()
    }
    assert tested == {"wide_id": (89, 0), "other": (90, 90)}


COLUMNS = "table string, column string, ordinal int, data_type string, nullable boolean, is_primary_key boolean, sample_values array<string>"
FK = "table string, column string, references_table string, references_column string"


@pytest.fixture(scope="module")
def catalog(spark):
    columns = [
        ("orders", "id", 1, "bigint", False, True, []),
        ("orders", "Ship Date", 2, "date", True, False, ["2024-01-01", "2024-01-02"]),
        ("orders", "a_rather_long_column_name_for_a_table", 3, "timestamp without time zone", True, False, ["x"]),
        ("orders", "status", 4, "text", True, False, ["F", "O", "P"]),
        ("Lines", "order_id", 1, "bigint", True, True, []),
        ("Lines", "n", 2, "integer", True, True, []),
    ]
    fk = [("Lines", "order_id", "orders", "id")]
    return spark.createDataFrame(columns, COLUMNS), spark.createDataFrame(fk, FK)


def test_ddl(catalog):
    texts = {r["table"]: r["ddl"] for r in render.render_table(*catalog).collect()}
    assert texts["orders"] == "\n".join(
        [
            "CREATE TABLE orders (",
            "  id bigint PRIMARY KEY,",
            '  "Ship Date" date,'.ljust(48) + "-- ex: 2024-01-01, 2024-01-02",
            "  a_rather_long_column_name_for_a_table timestamp without time zone,-- ex: x",
            "  status text".ljust(48) + "-- ex: F, O, P",
            ");",
        ]
    )
    assert texts["Lines"] == "\n".join(
        [
            'CREATE TABLE "Lines" (',
            "  order_id bigint PRIMARY KEY,",
            "  n integer PRIMARY KEY",
            ");",
            '-- "Lines".order_id -> orders.id',
        ]
    )


def test_schema_prompt_and_search_text(spark, catalog):
    ddl = render.render_table(*catalog)
    texts = {r["table"]: r["ddl"] for r in ddl.collect()}
    selected = spark.createDataFrame([(1, "orders", 1), (1, "gone", 2), (1, "Lines", 3), (2, "Lines", 1)], "question_id int, table string, pos int")
    schema = render.render_schema(selected, ddl)
    got = {r["question_id"]: r["schema_text"] for r in schema.collect()}
    assert got == {1: texts["orders"] + "\n\n" + texts["Lines"], 2: texts["Lines"]}
    first = {r["question_id"]: r["schema_text"] for r in render.render_schema(selected, ddl, max_tables=1).collect()}
    assert first[1] == texts["orders"]
    assert render.full_schema(ddl, max_tables=0).collect()[0][0] == texts["Lines"] + "\n\n" + texts["orders"]

    asked = spark.createDataFrame([(1, "How many?", "count rows"), (2, "Why?", "")], "question_id int, question string, evidence string")
    prompts = {r["question_id"]: r["prompt"] for r in render.build_prompt(asked, schema).collect()}
    assert prompts[1] == f"Schéma :\n\n{got[1]}\n\nIndication : count rows\n\nQuestion : How many?\n\nRequête SQL :"
    assert prompts[2] == f"Schéma :\n\n{got[2]}\n\nQuestion : Why?\n\nRequête SQL :"
    plain = {r["question_id"]: r["prompt"] for r in render.build_prompt(asked, schema, use_evidence=False).collect()}
    assert "Indication" not in plain[1]

    described = spark.createDataFrame([("orders", "All orders.")], "table string, description string")
    found = {r["id"]: r["text"] for r in render.searchable_text(catalog[0], described).collect()}
    assert found["orders"] == (
        "orders. All orders. Columns: id Ship Date a_rather_long_column_name_for_a_table status. Values: 2024-01-01 2024-01-02 x F O"
    )
    assert found["Lines"] == "Lines.  Columns: order_id n. Values: "

    counts = spark.createDataFrame([("orders", 1234567), ("Lines", 5)], "table string, n_rows long")
    context = {r["table"]: r["text"] for r in render.describe_context(ddl, counts, catalog[1]).collect()}
    assert context["orders"] == texts["orders"] + "\n\nLignes estimées : 1,234,567\nTables liées : aucune"
    assert context["Lines"].endswith("Lignes estimées : 5\nTables liées : orders")


def test_summary_and_detail(spark, catalog):
    counts = spark.createDataFrame([("orders", 10), ("Lines", 50)], "table string, n_rows long")
    row = profile.catalog_summary(catalog[0], counts, catalog[1]).collect()[0]
    assert tuple(row) == (2, 6, 1, 3, 0, 1)
    lines = [r["line"] for r in profile.table_detail(*catalog[:1], counts, catalog[1], name="Lines").orderBy("ordinal").collect()]
    assert lines == [
        "  order_id               bigint  [PK]",
        "  n                      integer  [PK]",
        "  FK: order_id -> orders.id",
    ]
