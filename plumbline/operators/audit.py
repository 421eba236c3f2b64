"""Identifiers used by queries, checked against a catalog.

`refs` holds what a query refers to, one row per reference:

    query_id, seq   the query, and the order of its references
    kind            statement | operation | table | column | empty | parse_error
    name            statement or operation type, identifier, or error text
    qualifier       of a column, if any
    alias           of a table, if any
    scope_kind      base | cte | alias: what a name stands for

All checks are joins against catalog metadata; no query text is read. Common
table expressions and select aliases are known to the query itself: with
strict=True they are checked like base names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plumbline.functions.frames import union_all
from plumbline.functions.rounding import round_half_even
from plumbline.session import stored

# Statements and operations, message formats, caps of the report.
QUERY_STATEMENTS = ["Select", "Union", "Subquery"]
FORBIDDEN_OPERATIONS = ["Insert", "Update", "Delete", "Drop", "Create", "Alter", "TruncateTable", "Grant", "Merge"]
BLOCKING_KINDS = ["forbidden", "not_select"]
EMPTY_MESSAGE = "requête vide"
PARSE_MESSAGE = "SQL non parsable : {}"
MULTIPLE_MESSAGE = "{} instructions, une seule attendue"
NOT_SELECT_MESSAGE = "seul SELECT est autorisé, reçu {}"
FORBIDDEN_MESSAGE = "opération interdite : {}"
TABLE_MESSAGE = "la table {} n'existe pas"
WRONG_OWNER_MESSAGE = "la colonne {} n'appartient pas à {}"
NO_OWNER_MESSAGE = "la colonne {} n'appartient à aucune table de la requête"
OWNERS_SUGGESTION = "elle existe dans {}"
SUGGESTION_SUFFIX = " (peut-être : {})"
MAX_OWNERS = 3
CAUGHT_EXAMPLES = 5
MISSED_EXAMPLES = 8
ERROR_WIDTH = 90

ISSUE_COLUMNS = ["query_id", "level", "seq", "kind", "target", "message", "suggestion"]
# Precedence of findings; a query reports only its first level.
LEVELS = {"empty": 0, "parse": 1, "multiple": 2, "not_select": 3, "forbidden": 4, "unknown_table": 5, "unknown_column": 5}


def _fill(template: str, *values: Column) -> Column:
    parts = template.split("{}")
    pieces: list[Column] = [F.lit(parts[0])]
    for value, text in zip(values, parts[1:]):
        pieces += [value, F.lit(text)]
    return F.concat(*pieces)


def _issues(df: DataFrame, kind: str | Column, target: Column, message: Column, suggestion: Column | None = None) -> DataFrame:
    none = F.lit(None).cast("string")
    name = F.lit(kind) if isinstance(kind, str) else kind
    level = F.lit(LEVELS[kind]) if isinstance(kind, str) else F.create_map(*[F.lit(x) for kv in LEVELS.items() for x in kv])[name]
    return df.select(
        "query_id",
        level.cast("int").alias("level"),
        F.col("seq").cast("bigint").alias("seq"),
        name.alias("kind"),
        target.alias("target"),
        message.alias("message"),
        (none if suggestion is None else suggestion).alias("suggestion"),
    )


def catalog_index(column_profile: DataFrame) -> DataFrame:
    """(table, column) in lower case, distinct."""
    return column_profile.select(F.lower("table").alias("table"), F.lower("column").alias("column")).distinct()


def _tables(catalog: DataFrame) -> DataFrame:
    return catalog.select("table").distinct()


def _table_refs(refs: DataFrame, strict: bool) -> DataFrame:
    tables = refs.filter((F.col("kind") == "table") & (F.coalesce("name", F.lit("")) != ""))
    return tables if strict else tables.filter(F.coalesce("scope_kind", F.lit("base")) != "cte")


def _column_refs(refs: DataFrame, strict: bool) -> DataFrame:
    columns = refs.filter((F.col("kind") == "column") & ~F.coalesce("name", F.lit("")).isin("", "*"))
    return columns if strict else columns.filter(F.coalesce("scope_kind", F.lit("base")) != "alias")


def _substrings(name: Column, longest: Column) -> Column:
    """All substrings of `name` no longer than `longest`, distinct."""
    starts = F.sequence(F.lit(1), F.length(name))
    per_start = F.transform(
        starts,
        lambda i: F.transform(
            F.sequence(F.lit(1), F.least(F.length(name) - i + 1, longest)), lambda n: F.substring(name, i, n)
        ),
    )
    return F.array_distinct(F.flatten(per_start))


def closest_table(names: DataFrame, catalog: DataFrame) -> DataFrame:
    """(name, suggestion): the first table that contains the name or is contained in it.

    Containment becomes equality with a substring, so this is two equi-joins
    instead of a comparison of every name with every table.
    """
    tables = _tables(catalog)
    longest = tables.agg(F.max(F.length("table")).alias("n")).scalar()
    wanted = names.select("name").distinct().select("name", F.lower("name").alias("target"), longest.alias("longest"))
    # One row per substring, so the join brings at most one table per name.
    containing = (
        tables.select("table", F.explode(_substrings(F.col("table"), F.length("table"))).alias("target"))
        .groupBy("target")
        .agg(F.min("table").alias("candidate"))
    )
    contained = wanted.filter("target <> ''").select("name", F.explode(_substrings(F.col("target"), F.col("longest"))).alias("candidate"))
    found = wanted.join(containing, "target").select("name", "candidate").unionByName(
        contained.join(tables.withColumnRenamed("table", "candidate"), "candidate").select("name", "candidate")
    )
    return found.groupBy("name").agg(F.min("candidate").alias("suggestion"))


def column_owners(catalog: DataFrame) -> DataFrame:
    """(column, owners, suggestion): tables with that column in name order, the first three named."""
    # Bounded by the number of tables in the catalog.
    owners = catalog.groupBy("column").agg(F.array_sort(F.collect_set("table")).alias("owners"))
    shown = F.array_join(F.slice("owners", 1, MAX_OWNERS), ", ")
    return owners.select("column", "owners", _fill(OWNERS_SUGGESTION, shown).alias("suggestion"))


def unknown_tables(refs: DataFrame, catalog: DataFrame, strict: bool = False) -> DataFrame:
    """Issues for table references that the catalog does not have."""
    known = _tables(catalog).withColumnRenamed("table", "key")
    missing = _table_refs(refs, strict).withColumn("key", F.lower("name")).join(known, "key", "left_anti")
    suggested = missing.join(closest_table(missing, catalog), "name", "left")
    return _issues(suggested, "unknown_table", F.col("name"), _fill(TABLE_MESSAGE, F.col("name")), F.col("suggestion"))


def alias_map(refs: DataFrame) -> DataFrame:
    """(query_id, key, table): what a qualifier stands for; the last definition wins."""
    tables = refs.filter((F.col("kind") == "table") & (F.coalesce("name", F.lit("")) != ""))
    keys = F.array_compact(F.array(F.when(F.coalesce("alias", F.lit("")) != "", F.lower("alias")), F.lower("name")))
    return (
        tables.select("query_id", "seq", "name", F.posexplode(keys).alias("nth", "key"))
        .groupBy("query_id", "key")
        .agg(F.max_by("name", F.struct("seq", "nth")).alias("table"))
    )


def unknown_qualified_columns(refs: DataFrame, catalog: DataFrame, strict: bool = False) -> DataFrame:
    """Issues for qualified columns that their table does not have.

    Qualifiers that resolve to no catalog table are left to `unknown_tables`.
    """
    qualified = _column_refs(refs, strict).filter(F.coalesce("qualifier", F.lit("")) != "")
    resolved = (
        qualified.withColumn("key", F.lower("qualifier"))
        .join(alias_map(refs).withColumnRenamed("table", "owner"), ["query_id", "key"])
        .withColumns({"owner_key": F.lower("owner"), "column_key": F.lower("name")})
    )
    known = _tables(catalog).withColumnRenamed("table", "owner_key")
    pairs = catalog.select(F.col("table").alias("owner_key"), F.col("column").alias("column_key"))
    wrong = resolved.join(known, "owner_key", "left_semi").join(pairs, ["owner_key", "column_key"], "left_anti")
    owners = column_owners(catalog).select(F.col("column").alias("column_key"), "suggestion")
    return _issues(
        wrong.join(owners, "column_key", "left"),
        "unknown_column",
        F.concat("qualifier", F.lit("."), "name"),
        _fill(WRONG_OWNER_MESSAGE, F.col("name"), F.col("owner")),
        F.col("suggestion"),
    )


def out_of_scope_columns(refs: DataFrame, catalog: DataFrame, strict: bool = False) -> DataFrame:
    """Issues for unqualified columns that no table of the query has."""
    bare = _column_refs(refs, strict).filter(F.coalesce("qualifier", F.lit("")) == "")
    known = _tables(catalog).withColumnRenamed("table", "key")
    # Known tables only, so the array is bounded by the catalog.
    in_scope = (
        refs.filter(F.col("kind") == "table")
        .select("query_id", F.lower("name").alias("key"))
        .join(known, "key", "left_semi")
        .groupBy("query_id")
        .agg(F.collect_set("key").alias("scope"))
    )
    owners = column_owners(catalog).withColumnRenamed("column", "column_key")
    none = F.array().cast("array<string>")
    judged = (
        bare.withColumn("column_key", F.lower("name"))
        .join(owners, "column_key", "left")
        .join(in_scope, "query_id", "left")
        .filter(~F.arrays_overlap(F.coalesce("owners", none), F.coalesce("scope", none)))
    )
    return _issues(judged, "unknown_column", F.col("name"), _fill(NO_OWNER_MESSAGE, F.col("name")), F.col("suggestion"))


def policy_flags(refs: DataFrame) -> DataFrame:
    """Issues of statement level: empty, unparsable, several, not a query, a forbidden operation.

    A report on a log, not a gate in front of a database.
    """
    name = F.col("name")
    empty = _issues(refs.filter("kind = 'empty'"), "empty", F.lit(""), F.lit(EMPTY_MESSAGE))
    parse = _issues(refs.filter("kind = 'parse_error'"), "parse", F.lit(""), _fill(PARSE_MESSAGE, F.coalesce(name, F.lit(""))))
    roots = refs.filter("kind = 'statement'").groupBy("query_id").agg(
        F.count("*").alias("n"), F.min("seq").alias("seq"), F.min_by("name", "seq").alias("name")
    )
    many = _issues(roots.filter("n > 1"), "multiple", F.lit(""), _fill(MULTIPLE_MESSAGE, F.col("n").cast("string")))
    other = _issues(
        roots.filter((F.col("n") == 1) & ~name.isin(QUERY_STATEMENTS)), "not_select", name, _fill(NOT_SELECT_MESSAGE, name)
    )
    forbidden = _issues(
        refs.filter((F.col("kind") == "operation") & name.isin(FORBIDDEN_OPERATIONS)),
        "forbidden",
        F.upper(name),
        _fill(FORBIDDEN_MESSAGE, F.upper(name)),
    )
    return union_all([empty, parse, many, other, forbidden])


def all_issues(refs: DataFrame, catalog: DataFrame, strict: bool = False) -> DataFrame:
    """Every finding of every level: (query_id, level, seq, kind, target, message, suggestion)."""
    return union_all(
        [
            policy_flags(refs),
            unknown_tables(refs, catalog, strict),
            unknown_qualified_columns(refs, catalog, strict),
            out_of_scope_columns(refs, catalog, strict),
        ]
    )


def issue_text() -> Column:
    """Message with its suggestion, as one line."""
    return F.concat(
        "message",
        F.when(F.coalesce("suggestion", F.lit("")) != "", _fill(SUGGESTION_SUFFIX, F.col("suggestion"))).otherwise(""),
    )


def audit_verdict(refs: DataFrame, issues: DataFrame) -> DataFrame:
    """One row per query: (query_id, ok, blocked, n_issues, first_issue, feedback).

    Only the findings of the first level count. Unknown tables come before
    unknown columns, each in query order. The feedback of one query is one text,
    as long as its list of references.
    """
    table_first = F.when(F.col("kind") == "unknown_table", 0).otherwise(1)
    line = F.struct(table_first.alias("part"), "seq", issue_text().alias("text"))
    per_level = issues.groupBy("query_id", "level").agg(
        F.array_sort(F.collect_list(line)).alias("lines"),
        F.bool_or(F.col("kind").isin(BLOCKING_KINDS)).alias("blocked"),
    )
    first = per_level.groupBy("query_id").agg(F.min_by(F.struct("lines", "blocked"), "level").alias("v"))
    lines = F.col("v.lines")
    return (
        refs.select("query_id")
        .distinct()
        .join(first, "query_id", "left")
        .select(
            "query_id",
            F.col("v").isNull().alias("ok"),
            F.coalesce("v.blocked", F.lit(False)).alias("blocked"),
            F.coalesce(F.size(lines), F.lit(0)).alias("n_issues"),
            F.when(F.col("v").isNotNull(), lines[0]["text"]).alias("first_issue"),
            F.coalesce(
                F.array_join(F.transform(lines, lambda x: F.concat(F.lit("- "), x["text"])), "\n"), F.lit("")
            ).alias("feedback"),
        )
    )


def _bucketed(predictions: DataFrame, verdicts: DataFrame, matches: DataFrame) -> DataFrame:
    """predictions: (tag, question_id, query_id, execution_error); matches: (tag, question_id, correct)."""
    failed = F.col("execution_error").isNotNull()
    bucket = (
        F.when(failed & ~F.col("ok"), "caught")
        .when(failed, "missed")
        .when(F.col("correct") & ~F.col("ok"), "false_positive")
        .otherwise("clean")
    )
    return (
        predictions.select("tag", "question_id", "query_id", "execution_error")
        .join(verdicts, "query_id")
        .join(matches, ["tag", "question_id"])
        .select("tag", "question_id", "execution_error", "first_issue", bucket.alias("bucket"))
    )


def audit_confusion(predictions: DataFrame, verdicts: DataFrame, matches: DataFrame) -> DataFrame:
    """One row per run: how many failures the audit caught, missed, or saw in correct queries.

    'clean' also holds queries that ran with a wrong result, flagged or not.
    """
    counted = _bucketed(predictions, verdicts, matches).groupBy("tag").agg(
        F.count("*").alias("questions"),
        *[F.count_if(F.col("bucket") == b).alias(b) for b in ("caught", "missed", "false_positive", "clean")],
    )
    failures = F.col("caught") + F.col("missed")
    return counted.select(
        "tag",
        "questions",
        failures.alias("sql_errors"),
        "caught",
        "missed",
        F.when(failures > 0, round_half_even(F.col("caught") / failures, 3)).otherwise(F.lit(0.0)).alias("detection_rate"),
        F.col("false_positive").alias("false_positives"),
        "clean",
    )


def audit_examples(predictions: DataFrame, verdicts: DataFrame, matches: DataFrame) -> DataFrame:
    """(tag, question_id, bucket, line): examples, taken in question order.

    One list is filled per run: caught queries while it holds fewer than five
    entries, missed ones while fewer than eight, and every false positive. So
    the first five of any kind enter; after them caught ones never do, missed
    ones only among the next three that are not caught.
    """
    kinds = stored(_bucketed(predictions, verdicts, matches).filter("bucket <> 'clean'"), "audit-kinds")
    order = W.partitionBy("tag").orderBy("question_id")
    start = kinds.withColumn("nth", F.row_number().over(order)).filter(F.col("nth") <= CAUGHT_EXAMPLES).drop("nth")
    # One row per run.
    last = start.groupBy("tag").agg(F.max("question_id").alias("until"), F.count("*").alias("n"))
    later = (
        kinds.filter("bucket <> 'caught'")
        .join(last.filter(F.col("n") == CAUGHT_EXAMPLES), "tag")
        .filter(F.col("question_id") > F.col("until"))
        .drop("until", "n")
    )
    more_missed = (
        later.withColumn("nth", F.row_number().over(order))
        .filter(F.col("nth") <= MISSED_EXAMPLES - CAUGHT_EXAMPLES)
        .filter("bucket = 'missed'")
        .drop("nth")
    )
    taken = start.unionByName(more_missed).unionByName(later.filter("bucket = 'false_positive'"))
    key = F.col("question_id").cast("string")
    line = (
        F.when(F.col("bucket") == "caught", _fill("{} détectée : {}", key, F.col("first_issue")))
        .when(
            F.col("bucket") == "missed",
            _fill("{} manquée : {}", key, F.left(F.coalesce("execution_error", F.lit("")), F.lit(ERROR_WIDTH))),
        )
        .otherwise(_fill("{} FAUX POSITIF : {}", key, F.col("first_issue")))
    )
    return taken.select("tag", "question_id", "bucket", line.alias("line"))
