"""Exact copies with a heavy-hitter split.

Misra-Gries summaries (merged over all partitions) name every digest that may
hold more than `support` of the rows. Their exact counts and winners fit a
broadcast of at most 1/support rows, so losers of large groups leave on the
map side. Everything else goes through one ordinary shuffle by digest, in which
no group can hold more than `support` of the rows.

Defined cases: a null text counts as empty; texts are equal when identical
after lower-casing A-Z; of equal texts the row with the largest id stays, a
null id being smaller than any other; of rows that repeat the staying id one
stays; an empty table gives an empty result; columns that clash with result
columns are replaced by them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plumbline.llm.common import ascii_lower, without
from plumbline.session import stored

SUPPORT = 0.001


def digest(text: str = "text"):
    """sha256 of the normalised text, lower-case hex."""
    return F.sha2(ascii_lower(F.col(text)).cast("binary"), 256)


def heavy_groups(hashed: DataFrame, support: float = SUPPORT) -> DataFrame:
    """Digests with more than `support` of all rows: digest, hot_keep, hot_size.

    At most 1/support rows. `hashed` has `_id` and `_digest` and is read twice.
    """
    item = F.xxhash64("_digest")
    # freqItems is a mergeable Misra-Gries summary: it misses no item above the support.
    frequent = hashed.select(item.alias("item")).stat.freqItems(["item"], support)
    suspects = frequent.select(F.explode("item_freqItems").alias("_item"))
    rows = hashed.agg(F.count("*").alias("rows"))
    counted = (
        hashed.join(F.broadcast(suspects), item == F.col("_item"), "left_semi")
        .groupBy("_digest")
        .agg(F.max("_id").alias("_hot_keep"), F.count("*").alias("_hot_size"))
    )
    floor = F.greatest(F.lit(1.0), F.col("rows") * F.lit(support))
    return counted.join(F.broadcast(rows), F.col("_hot_size") > floor).drop("rows")


def exact_groups(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", support: float = SUPPORT
) -> DataFrame:
    """Per row: id, keep_id, group_size, kept, text_sha256."""
    hashed = stored(
        docs.select(F.col(doc_id).alias("_id"), digest(text).alias("_digest")), "digests"
    )
    tagged = hashed.join(F.broadcast(heavy_groups(hashed, support)), "_digest", "left")
    loses = F.coalesce(F.col("_id") < F.col("_hot_keep"), F.col("_id").isNull() & F.col("_hot_keep").isNotNull())
    result = [F.col("_id").alias(doc_id), "keep_id", "group_size", "kept", F.col("_digest").alias("text_sha256")]
    removed = tagged.filter(loses).select(
        "*", F.col("_hot_keep").alias("keep_id"), F.col("_hot_size").alias("group_size"), F.lit(False).alias("kept")
    )
    group = W.partitionBy("_digest")
    rest = tagged.filter(~loses).select(
        "*",
        F.max("_id").over(group).alias("keep_id"),
        F.coalesce("_hot_size", F.count("*").over(group)).alias("group_size"),
        (F.row_number().over(group.orderBy(F.col("_id").desc_nulls_last())) == 1).alias("kept"),
    )
    return removed.select(*result).unionByName(rest.select(*result))


def drop_copies(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", support: float = SUPPORT
) -> DataFrame:
    """The rows of `docs` that stay, with their columns."""
    columns = docs.columns
    marked = without(docs, "_digest", "_id").withColumn("_digest", digest(text)).withColumn("_id", F.col(doc_id))
    hashed = stored(marked.select("_id", "_digest"), "digests")
    tagged = marked.join(F.broadcast(heavy_groups(hashed, support)), "_digest", "left")
    loses = F.coalesce(F.col("_id") < F.col("_hot_keep"), F.col("_id").isNull() & F.col("_hot_keep").isNotNull())
    group = W.partitionBy("_digest").orderBy(F.col("_id").desc_nulls_last(), F.col(text).desc_nulls_last())
    return (
        tagged.filter(~loses)
        .withColumn("_nth", F.row_number().over(group))
        .filter("_nth = 1")
        .select(*[F.col(f"`{c}`") for c in columns])
    )
