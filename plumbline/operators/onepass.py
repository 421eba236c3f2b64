"""All identifier checks of `audit` in one pass over the references.

References are shuffled once, by query. The catalog is read once, its size is
counted, and up to MAX_CATALOG_BYTES its names are looked up in a broadcast
dictionary where the references already lie; a hot table or column name thus
moves nothing. Every check is an expression on the array of a query's
references. A larger catalog goes through the joins of `audit`, with the same
results.

The references of one query are held together; they are bounded by its text.
Rows without a query_id count as one query. A query without references that a
check looks at has no findings; empty inputs give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.operators import audit
from plumbline.operators.audit import LEVELS, _fill
from plumbline.session import stored

MAX_CATALOG_BYTES = 32 << 20


def _size(catalog: DataFrame) -> int:
    return catalog.agg(F.sum(F.length("table") + F.length("column") + F.lit(32))).first()[0] or 0


def _gathered(refs: DataFrame, catalog: DataFrame) -> DataFrame:
    """(query_id, refs): the references of a query, each with what the catalog says of its name."""
    tables = catalog.select(F.col("table").alias("_table")).distinct()
    owners = audit.column_owners(catalog).select(
        F.col("column").alias("_column"), "owners", F.col("suggestion").alias("elsewhere")
    )
    name, kind = F.lower("name"), F.col("kind")
    # Both sides are parts of the catalog, whose size is known.
    looked_up = (
        refs.repartition("query_id")
        .join(F.broadcast(tables), F.when(kind == "table", name) == F.col("_table"), "left")
        .join(F.broadcast(owners), F.when(kind == "column", name) == F.col("_column"), "left")
    )
    one = F.struct(
        F.col("seq").cast("bigint").alias("seq"),
        "kind",
        "name",
        F.coalesce("qualifier", F.lit("")).alias("qualifier"),
        F.coalesce("alias", F.lit("")).alias("alias"),
        F.coalesce("scope_kind", F.lit("base")).alias("scope_kind"),
        F.col("_table").isNotNull().alias("known"),
        F.coalesce("owners", F.array().cast("array<string>")).alias("owners"),
        "elsewhere",
    )
    names = tables.agg(F.array_sort(F.collect_set("_table")).alias("names")).scalar()
    return looked_up.groupBy("query_id").agg(F.collect_list(one).alias("refs")).withColumn("names", names)


def _finding(kind: str, seq: Column, target: Column, message: Column, suggestion: Column | None = None) -> Column:
    return F.struct(
        F.lit(LEVELS[kind]).cast("int").alias("level"),
        seq.cast("bigint").alias("seq"),
        F.lit(kind).alias("kind"),
        target.cast("string").alias("target"),
        message.alias("message"),
        (F.lit(None) if suggestion is None else suggestion).cast("string").alias("suggestion"),
    )


def _policy() -> list[Column]:
    """Findings of statement level, as arrays."""
    of = lambda kind: F.filter("refs", lambda r: r["kind"] == kind)
    name = lambda r: F.coalesce(r["name"], F.lit(""))
    roots = F.transform(of("statement"), lambda r: F.struct(r["seq"].alias("seq"), r["name"].alias("name")))
    first, n = F.array_min(roots), F.size(roots)
    many = _fill(audit.MULTIPLE_MESSAGE, n.cast("string"))
    other = (n == 1) & ~first["name"].isin(audit.QUERY_STATEMENTS)
    banned = lambda r: r["name"].isin(audit.FORBIDDEN_OPERATIONS)
    upper = lambda r: F.upper(r["name"])
    return [
        F.transform(of("empty"), lambda r: _finding("empty", r["seq"], F.lit(""), F.lit(audit.EMPTY_MESSAGE))),
        F.transform(of("parse_error"), lambda r: _finding("parse", r["seq"], F.lit(""), _fill(audit.PARSE_MESSAGE, name(r)))),
        F.array_compact(F.array(F.when(n > 1, _finding("multiple", first["seq"], F.lit(""), many)))),
        F.array_compact(
            F.array(
                F.when(other, _finding("not_select", first["seq"], first["name"], _fill(audit.NOT_SELECT_MESSAGE, first["name"])))
            )
        ),
        F.transform(
            F.filter(of("operation"), banned),
            lambda r: _finding("forbidden", r["seq"], upper(r), _fill(audit.FORBIDDEN_MESSAGE, upper(r))),
        ),
    ]


def _names() -> list[Column]:
    """Findings of unknown tables and columns, as arrays."""
    closest = lambda low: F.array_min(F.filter("names", lambda t: F.contains(t, low) | F.contains(low, t)))
    owner = lambda c: c["owner"]["name"]
    lost = lambda c: (
        (c["qualifier"] != "") & F.coalesce(c["owner"]["known"], F.lit(False)) & ~F.array_contains(c["owners"], F.lower(owner(c)))
    )
    nowhere = lambda c: (c["qualifier"] == "") & ~F.arrays_overlap(c["owners"], F.col("scope"))
    return [
        F.transform(
            F.filter("checked_tables", lambda t: ~t["known"]),
            lambda t: _finding(
                "unknown_table", t["seq"], t["name"], _fill(audit.TABLE_MESSAGE, t["name"]), closest(F.lower(t["name"]))
            ),
        ),
        F.transform(
            F.filter("columns", lost),
            lambda c: _finding(
                "unknown_column",
                c["seq"],
                F.concat(c["qualifier"], F.lit("."), c["name"]),
                _fill(audit.WRONG_OWNER_MESSAGE, c["name"], owner(c)),
                c["elsewhere"],
            ),
        ),
        F.transform(
            F.filter("columns", nowhere),
            lambda c: _finding(
                "unknown_column", c["seq"], c["name"], _fill(audit.NO_OWNER_MESSAGE, c["name"]), c["elsewhere"]
            ),
        ),
    ]


def _checked(refs: DataFrame, catalog: DataFrame, strict: bool) -> DataFrame:
    """(query_id, issues), one row per query."""
    some = lambda r: F.coalesce(r["name"], F.lit("")) != ""
    in_scope = lambda r, own: F.lit(strict) | (r["scope_kind"] != own)
    split = _gathered(refs, catalog).select(
        "query_id",
        "names",
        "refs",
        F.filter("refs", lambda r: (r["kind"] == "table") & some(r)).alias("tables"),
        F.filter(
            "refs", lambda r: (r["kind"] == "column") & some(r) & (r["name"] != "*") & in_scope(r, "alias")
        ).alias("found"),
    )

    def stands_for(t: Column, nth: int, key: Column) -> Column:
        # In order of definition, as the last one wins.
        return F.struct(
            t["seq"].alias("seq"), F.lit(nth).alias("nth"), F.lower(key).alias("key"), t["name"].alias("name"), t["known"].alias("known")
        )

    both = lambda t: F.array_compact(
        F.array(F.when(t["alias"] != "", stands_for(t, 0, t["alias"])), stands_for(t, 1, t["name"]))
    )
    defined = split.select(
        "*",
        F.filter("tables", lambda t: in_scope(t, "cte")).alias("checked_tables"),
        F.flatten(F.transform("tables", both)).alias("defined"),
        F.transform(F.filter("tables", lambda t: t["known"]), lambda t: F.lower(t["name"])).alias("scope"),
    )
    owner = lambda c: F.array_max(F.filter("defined", lambda d: d["key"] == F.lower(c["qualifier"])))
    fields = ("seq", "name", "qualifier", "owners", "elsewhere")
    resolved = defined.withColumn(
        "columns", F.transform("found", lambda c: F.struct(*[c[f].alias(f) for f in fields], owner(c).alias("owner")))
    )
    return resolved.select("query_id", F.concat(*_policy(), *_names()).alias("issues"))


def findings(refs: DataFrame, catalog: DataFrame, strict: bool = False, max_bytes: int = MAX_CATALOG_BYTES) -> DataFrame:
    """Every finding of every level, the rows of `audit.all_issues`."""
    catalog = stored(catalog, "catalog")
    if _size(catalog) > max_bytes:
        return audit.all_issues(refs, catalog, strict)
    return _checked(refs, catalog, strict).select("query_id", F.inline("issues"))


def verdicts(refs: DataFrame, catalog: DataFrame, strict: bool = False, max_bytes: int = MAX_CATALOG_BYTES) -> DataFrame:
    """One row per query, the rows of `audit.audit_verdict`; nothing is shuffled after the references."""
    catalog = stored(catalog, "catalog")
    if _size(catalog) > max_bytes:
        return audit.audit_verdict(refs, audit.all_issues(refs, catalog, strict))
    first = F.array_min(F.transform("issues", lambda x: x["level"]))
    suggested = lambda x: F.when(
        F.coalesce(x["suggestion"], F.lit("")) != "", _fill(audit.SUGGESTION_SUFFIX, x["suggestion"])
    ).otherwise("")
    line = lambda x: F.struct(
        F.when(x["kind"] == "unknown_table", 0).otherwise(1).alias("part"),
        x["seq"].alias("seq"),
        F.concat(x["message"], suggested(x)).alias("text"),
    )
    levelled = _checked(refs, catalog, strict).withColumn("level", first)
    told = levelled.withColumn("first", F.filter("issues", lambda x: x["level"] == F.col("level")))
    lined = told.select("query_id", "first", F.array_sort(F.transform("first", line)).alias("lines"))
    return lined.select(
        "query_id",
        (F.size("lines") == 0).alias("ok"),
        F.exists("first", lambda x: x["kind"].isin(audit.BLOCKING_KINDS)).alias("blocked"),
        F.size("lines").alias("n_issues"),
        F.get("lines", F.lit(0))["text"].alias("first_issue"),
        F.array_join(F.transform("lines", lambda x: F.concat(F.lit("- "), x["text"])), "\n").alias("feedback"),
    )
