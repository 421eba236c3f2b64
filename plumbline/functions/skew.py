"""Equi-joins whose key may be carried by a large share of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_HOT_KEYS = 10_000
ROWS_PER_SALT = 1_000_000
# Rows of a few numbers and a word; so many go to every task.
FEW_ROWS = 200_000


def hot_keys(
    counts: DataFrame,
    key: str,
    n: str = "n",
    rows_per_salt: int = ROWS_PER_SALT,
    max_hot: int = MAX_HOT_KEYS,
) -> DataFrame:
    """Keys with more than 1/max_hot of all rows, and more than rows_per_salt.

    Fewer than `max_hot` keys can hold that share each, so the result is small
    whatever the input size and may be broadcast.
    """
    total = counts.agg(F.sum(n).alias("total")).scalar()
    floor = F.greatest(F.lit(rows_per_salt).cast("double"), total.cast("double") / F.lit(max_hot))
    return counts.filter(F.col(n) > floor).select(
        key, F.ceil(F.col(n) / F.lit(rows_per_salt)).cast("int").alias("_salts")
    )


def salted_join(
    many: DataFrame, few: DataFrame, key: str, hot: DataFrame, spread: str
) -> DataFrame:
    """Inner join on `key`, spreading hot keys of `many` over several tasks.

    Rows of `many` with a hot key get a salt from the column `spread`; the
    matching rows of `few` are repeated once per salt. Other keys join as usual.
    """
    bounded = F.broadcast(hot)
    left = many.join(bounded, key, "left").withColumn(
        "_salt", F.when(F.col("_salts").isNull(), 0).otherwise(F.pmod(F.xxhash64(spread), F.col("_salts")).cast("int"))
    )
    right = few.join(bounded, key, "left").withColumn(
        "_salt", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("_salts"), F.lit(1)) - 1))
    )
    return left.drop("_salts").join(right.drop("_salts"), [key, "_salt"]).drop("_salt")


def few_rows(df: DataFrame, most: int = FEW_ROWS) -> bool:
    """Whether a stored table has so few rows that every task may hold them, by counting."""
    return df.limit(most + 1).count() <= most
