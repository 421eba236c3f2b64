"""Recurring lines by a template tree of fixed depth.

A line goes down the tree by its number of tokens, then by its leading tokens;
tokens with a digit count as variable from the start, if the line has at least
`min_tokens` tokens of which `similarity` stay fixed; else they are compared as
they are. Lines that end in one leaf
and agree in at least `similarity` of their tokens have one template, with the
other positions variable. The leaf's candidates come from the lines themselves:
each names the templates that leave open one of `slots` interleaved groups of its
positions (or none), so two lines that differ in the positions of one group meet
in an equal template, without comparing lines pair by pair.

A template recurs if lines of at least `min_docs` documents have it. Lines of
recurring templates are dropped from every document but the one with the
smallest id, which keeps its copies. A template that leaves positions open must
recur and have at least `min_tokens` tokens; below that, only whole lines count.

Counting is done on digests, combined before the shuffle, so a line in a third
of all documents costs one row for each task. Only digests of recurring
templates meet the lines again, and only numbers of lines meet the texts.

Defined cases: a null text counts as empty, has no lines and stays null; blank
lines are kept and never templates; rows that repeat an id count as one
document, and rows of a null id as one that is larger than others, but each row
loses lines of its own text only (rows are told apart by id and a 64-bit hash of
the text; equal ones lose the same); an empty table gives an empty result; columns that clash with result columns are
replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import small_side, without
from plumbline.session import stored

MIN_DOCS = 3
DEPTH = 2
SIMILARITY = 0.7
SLOTS = 4
MIN_TOKENS = 6
MAX_BROADCAST = 500_000
MAX_ID = 2**63 - 1
OPEN = "<*>"


def lines_of(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """_id, _text (a hash), line_no (from 0), tokens, _digits (whether any has one): the lines that aren't blank."""
    split = docs.select(
        F.coalesce(F.col(doc_id).cast("bigint"), F.lit(MAX_ID)).alias("_id"),
        F.xxhash64(text).alias("_text"),
        F.posexplode(F.split(F.coalesce(F.col(text), F.lit("")), "\n")).alias("line_no", "_line"),
    )
    tokens = F.split(F.trim("_line"), "[ \t\r]+")
    digits = F.col("_line").rlike("[0-9]")
    return split.filter(F.trim("_line") != "").select("_id", "_text", "line_no", tokens.alias("tokens"), digits.alias("_digits"))


def masked(tokens: Column, min_tokens: int, similarity: float) -> Column:
    """Tokens with a digit are variable from the start, if the line is long enough and enough others stay fixed."""
    fixed = F.size(F.filter(tokens, lambda t: ~t.rlike("[0-9]")))
    enough = (F.size(tokens) >= min_tokens) & (fixed >= F.lit(float(similarity)) * F.size(tokens))
    return F.when(enough, F.transform(tokens, lambda t: F.when(t.rlike("[0-9]"), F.lit(OPEN)).otherwise(t))).otherwise(tokens)


def templates(tokens: Column, depth: int, slots: int, min_tokens: int, similarity: float) -> Column:
    """Digests of the line's templates: nothing left open, then one group of positions behind the leading tokens.

    Each group of positions is digested once; a template is made of the digests
    of what it does not leave open.
    """
    n = F.size(tokens)
    lead = F.xxhash64(n, F.slice(tokens, 1, depth))
    behind = F.slice(tokens, depth + 1, F.greatest(n - depth, F.lit(0)))

    def group(k: int) -> Column:
        return F.xxhash64(F.filter(behind, lambda t, i: i % slots == k))

    groups = [group(k) for k in range(slots)]
    whole = F.xxhash64(lead, *groups)
    open_from_start = F.size(F.filter(tokens, lambda t: t == OPEN))
    # The largest group has this many positions.
    fixed = n - F.ceil((n - depth) / slots) - open_from_start
    close = [F.xxhash64(lead, F.lit(k), *groups[:k], *groups[k + 1 :]) for k in range(slots)]
    return F.when(
        (n >= min_tokens) & (fixed >= F.lit(float(similarity)) * n), F.array(whole, *close)
    ).otherwise(F.array(whole))


def recurring(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    min_docs: int = MIN_DOCS,
    depth: int = DEPTH,
    similarity: float = SIMILARITY,
    slots: int = SLOTS,
    min_tokens: int = MIN_TOKENS,
) -> tuple[DataFrame, DataFrame]:
    """(lines with the digests of their templates, templates that recur with documents and the first of them)."""
    made = templates(F.col("tokens"), depth, slots, min_tokens, similarity)
    opened = F.when(F.col("_digits"), masked(F.col("tokens"), min_tokens, similarity)).otherwise(F.col("tokens"))
    lines = lines_of(docs, doc_id, text).select("_id", "_text", "line_no", opened.alias("tokens"))
    coded = stored(lines.select("_id", "_text", "line_no", made.alias("templates")), "lines")
    each = coded.select("_id", F.explode(F.array_distinct("templates")).alias("template"))
    # A document counts once for each template; the pairs shrink before and after the shuffle.
    found = (
        each.groupBy("template", "_id")
        .agg(F.lit(1).alias("one"))
        .groupBy("template")
        .agg(F.count("*").alias("n_docs"), F.min("_id").alias("first_id"))
        .filter(F.col("n_docs") >= min_docs)
    )
    return coded, stored(found, "templates")


def line_decisions(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **limits) -> DataFrame:
    """Lines that have a recurring template: _id, _text, line_no, template, n_docs, dropped."""
    coded, found = recurring(docs, doc_id, text, **limits)
    tried = coded.select("_id", "_text", "line_no", F.posexplode("templates").alias("rank", "template"))
    met = tried.join(small_side(found, MAX_BROADCAST), "template")
    # The most common template speaks for a line; of equals, the one that leaves least open.
    best = F.max_by(F.struct("template", "n_docs", "first_id"), F.struct("n_docs", -F.col("rank")))
    return met.groupBy("_id", "_text", "line_no").agg(best.alias("b")).select(
        "_id", "_text", "line_no", "b.template", "b.n_docs", (F.col("_id") != F.col("b.first_id")).alias("dropped")
    )


def drop_recurring_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **limits) -> DataFrame:
    """The columns of `docs` with n_lines, n_dropped and clean_text."""
    dropped = (
        line_decisions(docs, doc_id, text, **limits)
        .filter("dropped")
        .groupBy("_id", "_text")
        .agg(F.collect_set("line_no").alias("_gone"))
    )
    base = without(docs, "n_lines", "n_dropped", "clean_text", "_id", "_text", "_gone", "_split").withColumns(
        {"_id": F.coalesce(F.col(doc_id).cast("bigint"), F.lit(MAX_ID)), "_text": F.xxhash64(text)}
    )
    joined = base.join(small_side(stored(dropped, "dropped"), MAX_BROADCAST), ["_id", "_text"], "left").withColumn("_split", F.split(F.coalesce(F.col(text), F.lit("")), "\n"))
    left = F.filter("_split", lambda line, i: ~F.array_contains("_gone", i))
    clean = F.when(F.col("_gone").isNull(), F.col(text)).otherwise(F.array_join(left, "\n"))
    return joined.select(
        *[F.col(f"`{c}`") for c in base.columns if c not in ("_id", "_text")],
        F.size(F.filter("_split", lambda line: F.trim(line) != "")).cast("bigint").alias("n_lines"),
        F.coalesce(F.size("_gone"), F.lit(0)).cast("bigint").alias("n_dropped"),
        clean.alias("clean_text"),
    )
