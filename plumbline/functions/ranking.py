"""Ranks, running sums and quotas that survive one huge group.

A plain window puts a whole group into one task. Here rows are cut into
buckets of the order column first; only the per-bucket totals go through a
window over the whole group, so no task sorts more than a bucket.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plumbline.session import stored

BUCKET_WIDTH = 65_536
COUNT_CELLS = 65_536
# monotonically_increasing_id keeps the number inside a partition in its lower 33 bits.
RANGE_BITS = 33


def running_sum(
    df: DataFrame,
    keys: list[str],
    order: str,
    values: dict[str, Column],
    width: int = BUCKET_WIDTH,
) -> DataFrame:
    """Add, per `keys` in the order of the integer column `order`, running sums.

    `values` maps output names to the summed expressions; the current row is
    included. `order` must be unique within `keys`.
    """
    names = list(values)
    cut = df.select(
        "*",
        F.floor(F.col(order) / F.lit(width)).alias("_bucket"),
        *[v.alias(f"_v_{n}") for n, v in values.items()],
    )
    totals = cut.groupBy(*keys, "_bucket").agg(*[F.sum(f"_v_{n}").alias(f"_t_{n}") for n in names])
    before = W.partitionBy(*keys).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    offsets = (
        totals.select(
            *keys,
            "_bucket",
            F.row_number().over(W.partitionBy(*keys).orderBy("_bucket")).alias("_nth"),
            *[F.sum(f"_t_{n}").over(before).alias(f"_o_{n}") for n in names],
        )
        # Most groups fit one bucket and need no offset: nothing to join for them.
        .filter("_nth > 1")
        .drop("_nth")
    )
    local = W.partitionBy(*keys, "_bucket").orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    summed = cut.select("*", *[F.sum(f"_v_{n}").over(local).alias(f"_l_{n}") for n in names])
    joined = summed.join(offsets, [*keys, "_bucket"], "left")
    return joined.select(
        *df.columns,
        *[(F.col(f"_l_{n}") + F.coalesce(F.col(f"_o_{n}"), F.lit(0))).alias(n) for n in names],
    )


def dense_positions(
    df: DataFrame, keys: list[str], order: str, name: str, width: int = BUCKET_WIDTH
) -> DataFrame:
    """Number rows 0, 1, 2, ... per `keys` in the order of `order`."""
    counted = running_sum(df, keys, order, {name: F.lit(1).cast("bigint")}, width)
    return counted.withColumn(name, F.col(name) - 1)


def large_groups(df: DataFrame, keys: list[str], limit: int) -> DataFrame | None:
    """The `keys` with more than `limit` rows, or None where no group has.

    Rows are counted by a hash of the keys first, which shuffles little; only
    groups of cells beyond the limit are counted on their own.
    """
    cell = F.pmod(F.xxhash64(*keys), F.lit(COUNT_CELLS))
    # At most COUNT_CELLS rows.
    full = stored(df.groupBy(cell.alias("_cell")).agg(F.count("*").alias("_n")).filter(F.col("_n") > limit).select("_cell"), "full-cells")
    if full.isEmpty():
        return None
    inside = df.select(*keys, cell.alias("_cell")).join(F.broadcast(full), "_cell", "left_semi")
    large = stored(inside.groupBy(*keys).agg(F.count("*").alias("_n")).filter(F.col("_n") > limit).select(*keys), "large-groups")
    return None if large.isEmpty() else large


def split_groups(df: DataFrame, keys: list[str], large: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows of all other groups and rows of the `large` ones; null keys are keys as well."""
    mark = large.select(*[F.col(k).alias(f"_l_{k}") for k in keys])
    same = reduce(and_, [F.col(k).eqNullSafe(F.col(f"_l_{k}")) for k in keys])
    return df.join(mark, same, "left_anti"), df.join(mark, same, "left_semi")


def smallest_by_hash(
    df: DataFrame, keys: list[str], digest: str, quotas: DataFrame, tie: list[str]
) -> DataFrame:
    """Keep, per `keys`, as many rows with the smallest hex digests as `quotas` (keys, quota) says.

    A histogram over the first four hex digits finds the cell in which the
    quota is reached. Rows in lower cells are kept without sorting and only that
    one cell per group is ranked. Quotas meet the histogram, not the rows, so a
    group with most of the rows is never gathered.
    """
    cut = df.withColumn("_cell", F.substring(digest, 1, 4))
    upto = W.partitionBy(*keys).orderBy("_cell").rowsBetween(W.unboundedPreceding, -1)
    # At most 65,536 cells per group.
    histogram = cut.groupBy(*keys, "_cell").agg(F.count("*").alias("_n"))
    cells = (
        histogram.withColumn("_before", F.coalesce(F.sum("_n").over(upto), F.lit(0)))
        .join(quotas.select(*keys, "quota"), keys)
        .select(*keys, "_cell", "_n", (F.col("quota") - F.col("_before")).alias("_room"))
        .filter(F.col("_room") > 0)
    )
    inside = cut.join(cells, [*keys, "_cell"])
    whole = inside.filter("_n <= _room")
    rank = F.row_number().over(W.partitionBy(*keys, "_cell").orderBy(digest, *tie))
    edge = inside.filter("_n > _room").withColumn("_rank", rank).filter("_rank <= _room")
    return whole.select(*df.columns).unionByName(edge.select(*df.columns))


def global_positions(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """Number all rows 0, 1, 2, ... in one total order.

    The rows are cut into ranges of the order (cuts from a sample, so that
    ranges hold alike many rows whatever the values), written with their number
    inside the range, and the counted sizes of the ranges before are added. No
    task sorts more than a range; the sizes are as few as the partitions.
    """
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    # The upper bits of _at are the range, the lower ones count from 0 inside it.
    written = stored(ranged, "ranges").withColumn("_range", F.shiftright("_at", RANGE_BITS))
    sizes = written.groupBy("_range").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1))
    offsets = sizes.select("_range", F.coalesce(before, F.lit(0)).alias("_before"))
    inside = F.col("_at").bitwiseAND(F.lit((1 << RANGE_BITS) - 1))
    return written.join(F.broadcast(offsets), "_range").select(*df.columns, (F.col("_before") + inside).alias(name))
