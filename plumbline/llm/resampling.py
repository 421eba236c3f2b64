"""Importance resampling towards a target distribution.

Features of a text (runs of 1 to `max_n` words) fall into hashed buckets. A
bucket's gain is the floored log ratio of its smoothed shares in the target and
in the raw texts; the gains are an array of `buckets` numbers, by which every
document is scored in place: the floored mean of the gains of its features, plus
hashed Gumbel noise. The highest scores are drawn, which samples documents in
proportion to their weights without replacement.

The draw never sorts all rows. A quantile sketch brackets the score of the last
document drawn; exact counts above and inside the bracket say whether the cutoff
lies in it, and widen it where it doesn't. Only the bracket is sorted to find
the cutoff, and only what is drawn to be ranked.

Defined cases: a null or wordless text has no features, weight 0 and is never
eligible for a positive `min_words`; very long texts are read whole, by one task
each; a null id is hashed as the text 'null' and comes last among equal scores;
of rows that repeat an id and score those with more features, then with the
larger weight come first, further ones are alike in the result; an empty table
gives an empty result, an empty target scores all buckets against no words;
other columns of the input are left out.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.ranking import global_positions
from plumbline.llm.common import ascii_lower
from plumbline.session import stored

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BUCKETS = 10_000
MAX_N = 1
SEED = 2024
MIN_WORDS = 20
PERCENT = 10
# The sketch is off by at most one row in so many.
ACCURACY = 10_000


@dataclass(frozen=True)
class Bracket:
    """Scores between which the cutoff lies; above holds the exact number of rows beyond `high`."""

    low: int | None
    high: int | None
    above: int
    inside: int


def features(text: Column, max_n: int = MAX_N) -> Column:
    """Runs of 1 to max_n consecutive words of the lower-cased text, joined by one space."""
    words = F.regexp_extract_all(ascii_lower(text), F.lit(WORD), F.lit(0))
    if max_n == 1:
        return words

    def runs(n: int) -> Column:
        starts = F.when(F.size(words) >= n, F.sequence(F.lit(1), F.size(words) - n + 1)).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.array_join(F.slice(words, i, n), " "))

    return F.concat(*[runs(n) for n in range(1, max_n + 1)])


def hashed(text: Column, max_n: int = MAX_N, buckets: int = BUCKETS) -> Column:
    """The bucket of every feature."""
    return F.transform(features(text, max_n), lambda f: (F.crc32(f.cast("binary")) % buckets).cast("int"))


def bucket_counts(hashes: DataFrame, name: str) -> DataFrame:
    """bucket and its number of features; summed in each task before at most `buckets` rows a task are shuffled."""
    return hashes.select(F.explode("hashes").alias("bucket")).groupBy("bucket").agg(F.count("*").alias(name))


def bucket_gains(raw: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """bucket and gain of all buckets, from two tables with `hashes`."""
    spark = raw.sparkSession
    every = spark.range(buckets).select(F.col("id").cast("int").alias("bucket"))
    counted = (
        every.join(bucket_counts(raw, "s"), "bucket", "left")
        .join(bucket_counts(target, "t"), "bucket", "left")
        .fillna(0, ["s", "t"])
    )
    totals = counted.agg(F.sum("s").alias("all_s"), F.sum("t").alias("all_t"))

    def of(c: str) -> Column:
        return F.col(c).cast("double")

    ratio = (of("t") + 1) * (of("all_s") + buckets) / ((of("s") + 1) * (of("all_t") + buckets))
    # One row of totals; `buckets` rows on the other side.
    return counted.join(F.broadcast(totals)).select("bucket", F.floor(F.lit(1000.0) * F.log(ratio)).alias("gain"))


def gumbel(doc_id: Column, seed: int = SEED) -> Column:
    """Floored thousandths of Gumbel noise from a hash of the id."""
    mark = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null")))
    h = F.conv(F.substring(F.sha2(mark.cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0))))


def scored(hashes: DataFrame, gains: DataFrame, seed: int = SEED) -> DataFrame:
    """doc_id, n_words, n_features, weight, score of every row of `hashes` (doc_id, n_words, hashes)."""
    # As many numbers as there are buckets, whatever the corpus; a literal array, read by position.
    ordered = [str(r["gain"]) for r in gains.orderBy("bucket").collect()]
    array = F.split(F.lit(",".join(ordered)), ",").cast("array<bigint>")
    total = F.aggregate("hashes", F.lit(0).cast("bigint"), lambda a, b: a + F.get(array, b))
    summed = hashes.select("doc_id", "n_words", F.size("hashes").cast("bigint").alias("n_features"), total.alias("_total"))
    weight = F.when(F.col("n_features") > 0, F.expr("(_total - pmod(_total, n_features)) div n_features")).otherwise(F.lit(0))
    weighed = summed.withColumn("weight", weight.cast("bigint")).drop("_total")
    return weighed.withColumn("score", F.col("weight") + gumbel(F.col("doc_id"), seed))


def bracket(rows: DataFrame, total: int, k: int, accuracy: int = ACCURACY) -> Bracket:
    """Two scores around that of the k-th highest of `total` rows, checked by exact counts."""
    at, margin = 1 - k / total, 2 / accuracy
    while True:
        lower, upper = at - margin, at + margin
        sketch = rows.agg(
            F.percentile_approx("score", [max(lower, 0.0), min(upper, 1.0)], accuracy).alias("at")
        ).first()["at"]
        low = None if lower <= 0 else sketch[0]
        high = None if upper >= 1 else sketch[1]
        above = F.lit(False) if high is None else F.col("score") > high
        below = F.lit(False) if low is None else F.col("score") < low
        n = rows.agg(F.count_if(above).alias("above"), F.count_if(~above & ~below).alias("inside")).first()
        if n["above"] < k <= n["above"] + n["inside"]:
            return Bracket(low, high, n["above"], n["inside"])
        margin *= 4


def order() -> list[Column]:
    return [
        F.col("score").desc(),
        F.col("doc_id").asc_nulls_last(),
        F.col("n_features").desc(),
        F.col("weight").desc(),
    ]


def draw(rows: DataFrame, percent: int = PERCENT, min_words: int = MIN_WORDS, accuracy: int = ACCURACY) -> DataFrame:
    """All rows of `scored` with rank (1, 2, ...), null where a row isn't drawn."""
    written = stored(rows, "scores")
    eligible = written.filter(F.col("n_words") >= min_words)
    total = eligible.count()
    k = percent * total // 100
    nobody = F.lit(None).cast("bigint")
    if k == 0:
        return written.withColumn("rank", nobody)
    found = bracket(eligible, total, k, accuracy)
    between = eligible
    if found.low is not None:
        between = between.filter(F.col("score") >= found.low)
    if found.high is not None:
        between = between.filter(F.col("score") <= found.high)
    # Where a single score is left, the bracket is that score and its sort only orders ids.
    at = global_positions(between.select("doc_id", "n_features", "weight", "score"), order(), "at")
    last = at.filter(F.col("at") == k - found.above - 1).first()
    same = F.col("score") == last["score"]
    upto = F.col("doc_id") <= last["doc_id"] if last["doc_id"] is not None else F.lit(True)
    taken = (F.col("n_words") >= min_words) & ((F.col("score") > last["score"]) | (same & F.coalesce(upto, F.lit(False))))
    taken = F.coalesce(taken, F.lit(False))
    ranked = global_positions(written.filter(taken), order(), "rank")
    # Rows beyond k share score and id with the last one.
    numbered = ranked.withColumn("rank", F.when(F.col("rank") < k, F.col("rank") + 1))
    return numbered.unionByName(written.filter(~taken).withColumn("rank", nobody))


def resample(
    docs: DataFrame,
    target: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    max_n: int = MAX_N,
    buckets: int = BUCKETS,
    seed: int = SEED,
    percent: int = PERCENT,
    min_words: int = MIN_WORDS,
    accuracy: int = ACCURACY,
) -> DataFrame:
    """Per row of `docs`: doc_id, n_words, n_features, weight, score, rank; `target` has texts like those wanted."""
    n_words = F.size("hashes") if max_n == 1 else F.size(features(F.col(text)))
    hashes = stored(
        docs.select(F.col(doc_id).alias("doc_id"), F.col(text), hashed(F.col(text), max_n, buckets).alias("hashes")).select(
            "doc_id", n_words.alias("n_words"), "hashes"
        ),
        "hashes",
    )
    wanted = target.select(hashed(F.col(text), max_n, buckets).alias("hashes"))
    gains = bucket_gains(hashes, wanted, buckets)
    return draw(scored(hashes, gains, seed), percent, min_words, accuracy)
