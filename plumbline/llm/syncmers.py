"""Document fingerprints from closed syncmers.

Words are the symbols, hashed after lower-casing. Of the runs of K words those
are chosen whose smallest inner run of S words is the first or the last one. The
choice depends on the run alone, so a passage has the same anchors wherever it
stands, and an edit only touches the anchors that overlap it. A fingerprint
holds all anchors of a text in their order, whatever its length.

Anchors are matched by position: neighbouring anchors and the distance between
them form a step, and two texts have a step in common if both anchors stand at
that distance in either. near_* is the share of the steps of the text with fewer
that the other has too, so a text that lies whole in a longer one is found;
alike_* is the share in terms of both, 2 |A & B| / (|A| + |B|). Both are exact.

Defined cases: a null text counts as empty; a text none of whose runs is chosen,
such as one of fewer than K words, has its whole sequence of words as its one
anchor, and a text of one anchor is held by another if that has the anchor; a
text without words has an empty fingerprint, which is like another empty one (1)
and unlike all others (0); steps that a text repeats count once; a very long
text has all its anchors and is held whole by one task;
repeated rows are fingerprinted one by one; rows of a null id come last in the
descending order; an empty table gives an empty result; further columns are not
read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

K = 5
S = 2
ROWS_PER_BUCKET = 4_000
MAX_BUCKETS = 10_000
FAN = 100


def words_of(text: Column) -> Column:
    """Words between ASCII white space, lower-cased."""
    return F.filter(F.split(F.lower(text), "[ \t\n\x0b\f\r]+"), lambda w: w != "")


def _chosen(inner: Column, x: Column, i: Column) -> Column:
    """The code of the K = 5 words from i on if they are a closed syncmer; else null.

    They hold the inner runs i to i + 3; the last place of `inner` has no second word.
    """
    last = F.get(inner, i + 3)
    edge = F.least(x, last) <= F.least(F.get(inner, i + 1), F.get(inner, i + 2))
    return F.when(edge & F.get(inner, i + 4).isNotNull(), F.xxhash64(x, F.get(inner, i + 2), last))


def _with_inner(df: DataFrame, text: str) -> DataFrame:
    """Add _inner, the codes of the runs of S = 2 words, with _whole and _n for short texts.

    Step by step: an array that a lambda looks into must be a column, or it is made anew for each element.
    """
    columns = [F.col(f"`{c}`") for c in df.columns]
    words = df.select(*columns, words_of(F.coalesce(F.col(text), F.lit(""))).alias("_words"))
    codes = words.select(
        *columns,
        F.transform("_words", lambda w: F.xxhash64(w)).alias("_codes"),
        F.xxhash64("_words").alias("_whole"),
        F.size("_words").alias("_n"),
    )
    inner = F.transform("_codes", lambda x, i: F.xxhash64(x, F.get(F.col("_codes"), i + 1)))
    return codes.select(*columns, "_whole", "_n", inner.alias("_inner"))


def with_anchors(df: DataFrame, text: str = "text", anchors: str = "anchors") -> DataFrame:
    """Add all anchors of a text (code, place), the place being the number of the word they start at."""
    inner = F.col("_inner")
    found = F.transform(inner, lambda x, i: F.struct(_chosen(inner, x, i).alias("code"), i.alias("place")))
    columns = [F.col(f"`{c}`") for c in df.columns]
    chosen = _with_inner(df, text).select(
        *columns, "_whole", "_n", F.filter(found, lambda a: a["code"].isNotNull()).alias("_chosen")
    )
    whole = F.array(F.struct(F.col("_whole").alias("code"), F.lit(0).alias("place")))
    one = (F.size("_chosen") == 0) & (F.col("_n") > 0)
    return chosen.select(*columns, F.when(one, whole).otherwise(F.col("_chosen")).alias(anchors))


def with_fingerprint(df: DataFrame, text: str, name: str) -> DataFrame:
    """Add `name`, the codes of all anchors (codes) and the distinct steps between neighbours (steps)."""
    columns = [F.col(f"`{c}`") for c in df.columns]
    anchors = F.col("_anchors")

    def step(a: Column, i: Column) -> Column:
        after = F.get(anchors, i + 1)
        return F.when(after.isNotNull(), F.xxhash64(a["code"], after["code"], after["place"] - a["place"]))

    steps = F.array_distinct(F.array_compact(F.transform(anchors, step)))
    made = F.struct(F.col("_anchors.code").alias("codes"), steps.alias("steps"))
    return with_anchors(df, text, "_anchors").select(*columns, made.alias(name))


def likeness(a: Column, b: Column) -> tuple[Column, Column]:
    """The share of the steps of the text with fewer that the other has, and the share in terms of both; 0 to 1."""
    single = F.least(F.size(a["codes"]), F.size(b["codes"])) <= 1
    x = F.when(single, F.array_distinct(a["codes"])).otherwise(a["steps"])
    y = F.when(single, F.array_distinct(b["codes"])).otherwise(b["steps"])
    both, m, n = F.size(F.array_intersect(x, y)), F.size(x), F.size(y)
    empty = F.when((m == 0) & (n == 0), F.lit(1.0)).when((m == 0) | (n == 0), F.lit(0.0))
    return empty.otherwise(both / F.least(m, n)), empty.otherwise(2 * both / (m + n))


def as_text(codes: Column) -> Column:
    """The anchors' upper 32 bits in hex, joined."""
    return F.array_join(
        F.transform(codes, lambda x: F.lpad(F.lower(F.hex(F.shiftrightunsigned(x, 32))), 8, "0")), "-"
    )


def _bucket(df: DataFrame, doc_id: str, rows_per_bucket: int) -> Column:
    """Ranges of ids of about equal size, the largest ids first; a null id is in the last one.

    The bounds are quantiles of the ids, at most MAX_BUCKETS numbers.
    """
    n = df.select(F.count(doc_id)).first()[0]
    buckets = int(min(MAX_BUCKETS, n // rows_per_bucket))
    if buckets < 2:
        return F.when(F.col(doc_id).isNull(), F.lit(0)).otherwise(F.lit(1))
    at = [i / buckets for i in range(1, buckets)]
    cuts = sorted(set(df.select(F.percentile_approx(doc_id, at, 20_000)).first()[0]))
    fans = [cuts[i : i + FAN] for i in range(0, len(cuts), FAN)]
    nested = F.array(*[F.array(*[F.lit(c) for c in fan]) for fan in fans])
    below = lambda cs: F.size(F.filter(cs, lambda c: c <= F.col(doc_id)))
    fan = F.size(F.filter(nested, lambda cs: cs[0] <= F.col(doc_id)))
    inside = F.when(fan == 0, F.lit(0)).otherwise(FAN * (fan - 1) + below(F.get(nested, fan - 1)))
    return F.when(F.col(doc_id).isNull(), F.lit(0)).otherwise(inside + 1)


def with_next(docs: DataFrame, rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """Add print, next_text and next_print, from the next row by descending id; the last row's next is the first.

    Rows are ordered within ranges of ids, in one shuffle. The first row of each
    range, at most MAX_BUCKETS + 2 of them, is fetched by its id and meets the
    last row of the range before it.
    """
    cut = docs.withColumn("_bucket", _bucket(docs, "doc_id", rows_per_bucket))
    tops = {r["_bucket"]: r["top"] for r in cut.groupBy("_bucket").agg(F.max("doc_id").alias("top")).collect()}
    known = sorted(tops, reverse=True)
    behind = [(b, n, tops[n]) for b, n in zip(known, known[1:] + known[:1])]
    wanted = docs.sparkSession.createDataFrame(behind, "_bucket int, _next int, _top bigint")
    first = F.max(F.struct("doc_id", "text"))
    heads = (
        cut.withColumnRenamed("_bucket", "_next")
        .join(F.broadcast(wanted.withColumnRenamed("_next", "_n")), (F.col("_next") == F.col("_n")) & F.col("doc_id").eqNullSafe(F.col("_top")))
        .groupBy("_bucket")
        .agg(first["text"].alias("_head_text"))
    )
    heads = with_fingerprint(heads, "_head_text", "_head_print")
    w = W.partitionBy("_bucket").orderBy(F.col("doc_id").desc_nulls_last(), F.col("text").desc())
    # Fingerprints are made where the rows arrive, so that only texts are shuffled.
    rows = with_fingerprint(cut.repartition("_bucket"), "text", "print").select(
        "*", F.lead(F.lit(True)).over(w).alias("_has_next"), *[F.lead(v).over(w).alias(f"_lead_{v}") for v in ("text", "print")]
    )
    pick = lambda v: F.when(F.col("_has_next"), F.col(f"_lead_{v}")).otherwise(F.col(f"_head_{v}")).alias(f"next_{v}")
    # Rows already lie by range, so only the heads move.
    return rows.join(heads, "_bucket", "left").select("doc_id", "text", "print", pick("text"), pick("print"))


def fingerprints(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", rows_per_bucket: int = ROWS_PER_BUCKET
) -> DataFrame:
    """Per row its fingerprint, that of its edited text, and how alike it is to that and to the next row."""
    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    own = with_next(rows, rows_per_bucket)
    n, half = F.length("text"), F.floor(F.length("text") / 2).cast("int")
    edited = own.select(
        "doc_id",
        n.cast("bigint").alias("n_chars"),
        "print",
        "next_print",
        F.concat(F.substring("text", F.lit(1), n - half), F.substring("next_text", F.lit(1), half)).alias("edited"),
    )
    both = with_fingerprint(edited, "edited", "edited_print")
    near_edited, alike_edited = likeness(F.col("print"), F.col("edited_print"))
    near_next, alike_next = likeness(F.col("print"), F.col("next_print"))
    return both.select(
        "doc_id",
        "n_chars",
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        as_text(F.col("print.codes")).alias("fingerprint"),
        as_text(F.col("edited_print.codes")).alias("edited_fingerprint"),
        near_edited.alias("near_edited"),
        near_next.alias("near_next"),
        alike_edited.alias("alike_edited"),
        alike_next.alias("alike_next"),
    )
