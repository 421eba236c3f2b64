"""Mixing sources to target weights by Poisson replication.

Every document draws its number of copies from a Poisson distribution whose
mean is the target repetition rate of its source. The draw inverts the
distribution at a uniform number hashed from the seed and the id, so it is the
same on every run, partitioning and engine. Copies then get a hashed shuffle
key and are dealt out and sorted by it.

Defined cases: rows of a null source form a source of their own; a source that
is missing from explicit weights has weight 0; rows that repeat an id draw the
same number; a null id is hashed as the text 'null'; a null text is copied as
it is; an empty table gives an empty result; columns that clash with result
columns are replaced by them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.skew import hot_keys, salted_join
from plumbline.llm.common import without
from plumbline.session import stored

SEED = 17
TEMPERATURE = 0.5
MAX_BROADCAST_SOURCES = 100_000


def uniform(*parts: Column | str) -> Column:
    """A number in [0, 1) from the first 52 bits of an md5 digest."""
    text = F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("null")) if isinstance(p, Column) else F.lit(p) for p in parts])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("double") / F.lit(float(2**52))


def poisson_steps(rate: Column) -> Column:
    """Cumulative probabilities of 0, 1, 2, ... copies, up to where the rest is below 1e-17.

    Summed from logarithms, so that a large rate doesn't underflow.
    """
    last = F.ceil(rate + F.lit(12.0) * F.sqrt(rate) + F.lit(30.0)).cast("int")
    start = F.struct((-rate).alias("log_p"), F.array(F.exp(-rate)).alias("steps"))

    def grow(state: Column, k: Column) -> Column:
        log_p = state["log_p"] + F.log(rate) - F.log(k.cast("double"))
        total = F.element_at(state["steps"], -1) + F.exp(log_p)
        return F.struct(log_p.alias("log_p"), F.concat(state["steps"], F.array(total)).alias("steps"))

    grown = F.aggregate(F.sequence(F.lit(1), last), start, grow, lambda state: state["steps"])
    return F.when(rate > 0, grown).otherwise(F.array(F.lit(1.0)))


def repetition_rates(
    docs: DataFrame,
    source: str = "source",
    weights: dict[str, float] | None = None,
    temperature: float = TEMPERATURE,
    size_ratio: float = 1.0,
) -> DataFrame:
    """Per source: _source, n, rate. Without weights a source weighs its row count to the power `temperature`."""
    counts = docs.groupBy(F.col(source).alias("_source")).agg(F.count("*").alias("n"))
    if weights is None:
        weight = F.pow(F.col("n").cast("double"), F.lit(temperature))
    else:
        table = F.create_map(*[F.lit(x) for item in weights.items() for x in item]) if weights else F.create_map()
        weight = F.coalesce(table[F.col("_source")], F.lit(0.0)).cast("double")
    weighed = counts.withColumn("weight", weight)
    total = weighed.agg(F.sum("n").alias("total_n"), F.sum("weight").alias("total_weight"))
    share = F.when(F.col("total_weight") > 0, F.col("weight") / F.col("total_weight")).otherwise(F.lit(0.0))
    rate = share * F.lit(size_ratio) * F.col("total_n") / F.col("n")
    return weighed.join(F.broadcast(total)).select("_source", "n", rate.alias("rate"))


def mix(
    docs: DataFrame,
    doc_id: str = "doc_id",
    source: str = "source",
    weights: dict[str, float] | None = None,
    temperature: float = TEMPERATURE,
    size_ratio: float = 1.0,
    seed: int = SEED,
) -> DataFrame:
    """The columns of `docs` with copy (from 1), copies and shuffle_key, dealt out by the key."""
    rates = stored(repetition_rates(docs, source, weights, temperature, size_ratio), "rates")
    keyed = "coalesce(concat('s:', _source), 'null')"
    stepped = rates.select(F.expr(keyed).alias("_key"), "n", poisson_steps(F.col("rate")).alias("_steps"))
    rows = without(docs, "copy", "copies", "shuffle_key", "_key", "_steps").withColumn(
        "_key", F.coalesce(F.concat(F.lit("s:"), F.col(source).cast("string")), F.lit("null"))
    )
    if rates.count() <= MAX_BROADCAST_SOURCES:
        drawn = rows.join(F.broadcast(stepped.drop("n")), "_key")
    else:
        drawn = salted_join(rows, stepped.drop("n"), "_key", hot_keys(stepped, "_key"), doc_id)
    u = uniform(str(seed), F.col(doc_id))
    # The smallest count whose cumulative probability exceeds u.
    copies = F.aggregate("_steps", F.lit(0), lambda k, c: k + F.when(c <= u, 1).otherwise(0))
    kept = [F.col(f"`{c}`") for c in rows.columns if c != "_key"]
    counted = drawn.select(*kept, copies.alias("copies")).filter("copies > 0")
    copied = counted.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    mark = F.concat_ws(
        "|", F.lit(f"shuffle {seed}"), F.coalesce(F.col(doc_id).cast("string"), F.lit("null")), F.col("copy").cast("string")
    )
    key = F.conv(F.substring(F.md5(mark.cast("binary")), 1, 15), 16, 10).cast("bigint")
    return copied.withColumn("shuffle_key", key).repartition("shuffle_key").sortWithinPartitions("shuffle_key", "copy")
