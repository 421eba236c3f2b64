"""Text assembled from profiles: DDL, searchable text, prompts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.text import quote_identifier

# Layout and labels of the produced texts.
SAMPLE_COLUMN = 48
SEARCH_SAMPLES = 2
SCHEMA_LABEL = "Schéma :\n\n"
HINT_LABEL = "Indication : "
QUESTION_LABEL = "Question : "
ANSWER_CUE = "Requête SQL :"
ROWS_LABEL = "Lignes estimées : "
LINKED_LABEL = "Tables liées : "
NO_LINKED = "aucune"


def _pad(text: Column, width: int) -> Column:
    """Pad on the right; longer text stays whole."""
    return F.when(F.length(text) < width, F.rpad(text, width, " ")).otherwise(text)


def _ordered(value: Column, *order: Column) -> Column:
    """Collect `value` in the order of `order`. Used per table or per question only."""
    keys = [o.alias(f"o{i}") for i, o in enumerate(order)]
    return F.transform(F.array_sort(F.collect_list(F.struct(*keys, value.alias("v")))), lambda e: e.v)


def render_table(column_profile: DataFrame, fk: DataFrame) -> DataFrame:
    """(table, ddl): a CREATE TABLE text with sample values and foreign keys as comments."""
    code = F.concat(
        F.lit("  "),
        quote_identifier(F.col("column")),
        F.lit(" "),
        F.col("data_type"),
        F.when(F.col("is_primary_key"), " PRIMARY KEY").otherwise(""),
    )
    samples = F.when(F.size("sample_values") > 0, F.concat(F.lit("-- ex: "), F.array_join("sample_values", ", ")))
    bodies = (
        column_profile.select("table", "ordinal", F.struct(code.alias("code"), samples.alias("samples")).alias("line"))
        .groupBy("table")
        .agg(_ordered(F.col("line"), F.col("ordinal")).alias("lines"))
    )

    def finished(line: Column, i: Column) -> Column:
        text = F.concat(line.code, F.when(i < F.size("lines") - 1, ",").otherwise(""))
        return F.when(line.samples.isNull(), text).otherwise(F.concat(_pad(text, SAMPLE_COLUMN), line.samples))

    link = F.concat(
        F.lit("-- "),
        quote_identifier(F.col("table")),
        F.lit("."),
        quote_identifier(F.col("column")),
        F.lit(" -> "),
        quote_identifier(F.col("references_table")),
        F.lit("."),
        quote_identifier(F.col("references_column")),
    )
    links = fk.groupBy("table").agg(
        F.array_sort(F.collect_list(link)).alias("links")
    )
    return bodies.join(links, "table", "left").select(
        "table",
        F.array_join(
            F.concat(
                F.array(F.concat(F.lit("CREATE TABLE "), quote_identifier(F.col("table")), F.lit(" ("))),
                F.transform("lines", finished),
                F.array(F.lit(");")),
                F.coalesce("links", F.array().cast("array<string>")),
            ),
            "\n",
        ).alias("ddl"),
    )


def render_schema(selected: DataFrame, ddl: DataFrame, max_tables: int | None = None) -> DataFrame:
    """(question_id, schema_text, n_tables): DDL of the selected tables, in their order.

    `selected` is (question_id, table, pos); tables without DDL are left out.
    max_tables = 0 means all, like none. The selection is partitioned by question
    before the texts are attached, so that only names go through the exchange.
    """
    texts = _ordered(F.col("ddl"), F.col("pos"))
    return (
        selected.repartition("question_id")
        .join(ddl, "table")
        .groupBy("question_id")
        .agg((F.slice(texts, 1, max_tables) if max_tables else texts).alias("chosen"))
        .select("question_id", F.array_join("chosen", "\n\n").alias("schema_text"), F.size("chosen").alias("n_tables"))
    )


def full_schema(ddl: DataFrame, max_tables: int | None = None) -> DataFrame:
    """One row: the DDL of all tables in name order, or of the first max_tables."""
    texts = F.transform(F.array_sort(F.collect_list(F.struct("table", "ddl"))), lambda e: e.ddl)
    kept = F.slice(texts, 1, max_tables) if max_tables else texts
    return ddl.agg(F.array_join(kept, "\n\n").alias("schema_text"))


def searchable_text(column_profile: DataFrame, descriptions: DataFrame) -> DataFrame:
    """(id, text): name, description, column names and a few sample values per table."""
    order = F.col("ordinal")
    samples = F.slice("sample_values", 1, SEARCH_SAMPLES)
    grouped = column_profile.groupBy("table").agg(
        _ordered(F.col("column"), order).alias("columns"), F.flatten(_ordered(samples, order)).alias("samples")
    )
    text = F.concat(
        F.col("table"),
        F.lit(". "),
        F.coalesce("description", F.lit("")),
        F.lit(" Columns: "),
        F.array_join("columns", " "),
        F.lit(". Values: "),
        F.array_join("samples", " "),
    )
    return grouped.join(descriptions.select("table", "description"), "table", "left").select(
        F.col("table").alias("id"), text.alias("text")
    )


def build_prompt(questions: DataFrame, schema: DataFrame, use_evidence: bool = True) -> DataFrame:
    """(question_id, prompt): schema, optional hint, question and cue."""
    hint = F.when(F.coalesce("evidence", F.lit("")) != "", F.concat(F.lit(HINT_LABEL), F.col("evidence")))
    prompt = F.concat_ws(
        "\n\n",
        F.concat(F.lit(SCHEMA_LABEL), F.col("schema_text")),
        hint if use_evidence else F.lit(None).cast("string"),
        F.concat(F.lit(QUESTION_LABEL), F.col("question")),
        F.lit(ANSWER_CUE),
    )
    return questions.join(schema.select("question_id", "schema_text"), "question_id").select(
        "question_id", prompt.alias("prompt")
    )


def describe_context(ddl: DataFrame, table_profile: DataFrame, fk: DataFrame) -> DataFrame:
    """(table, text): DDL, row count and referenced tables, in foreign-key order."""
    linked = fk.groupBy("table").agg(
        F.array_join(_ordered(F.col("references_table"), F.col("column"), F.col("references_column")), ", ").alias("linked")
    )
    text = F.concat(
        F.col("ddl"),
        F.lit("\n\n" + ROWS_LABEL),
        F.format_number("n_rows", 0),
        F.lit("\n" + LINKED_LABEL),
        F.coalesce("linked", F.lit(NO_LINKED)),
    )
    return ddl.join(table_profile, "table").join(linked, "table", "left").select("table", text.alias("text"))
