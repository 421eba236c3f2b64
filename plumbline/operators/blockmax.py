"""Word search over blocks of postings, skipping blocks that cannot reach the best.

Texts of about the same length are dealt to blocks by a hash, so that texts of a
block weigh a term alike and a posting's block follows from its own columns. Of
every term and block the postings are stored as one array beside the largest
weight among them. A question's bound for a block is
the sum of these weights over its terms, which reads no posting. The blocks with
the highest bounds are scored first; the last of the best found there is a
threshold, and blocks whose bound stays below it are never opened. What is left
out could not have been among the best, so the result equals that of scoring
every posting.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plumbline.functions.skew import MAX_HOT_KEYS, ROWS_PER_SALT, few_rows, hot_keys, salted_join
from plumbline.operators.lexical import B, CANDIDATES, K1, SCORE_DIGITS, Index, doc_stats
from plumbline.session import stored

BLOCK_ROWS = 64
FIRST_BLOCKS = 2
# Blocks are numbered by their class, then their part of it.
CLASS_STEP = 2**32
# Bounds are sums in another order than scores; more than the difference is left as room.
SLACK = 1e-6


@dataclass(frozen=True)
class BlockIndex:
    """maxima (term, block, peak, n); blocks (term, block, postings); terms (term, df, n_blocks); totals (n, words)."""

    maxima: DataFrame
    blocks: DataFrame
    terms: DataFrame
    totals: DataFrame


def _weight(tf: Column, length: Column, mean_length: Column) -> Column:
    """The part of a term's score that doesn't depend on the question."""
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / mean_length))


def build_blocks(index: Index, path: str, block_rows: int = BLOCK_ROWS) -> BlockIndex:
    """Store an index by blocks of about `block_rows` texts, with one shuffle of the postings."""
    # As many classes as the root of the longest length at most.
    length_class = F.floor(F.sqrt(F.col("length"))).cast("bigint")
    sizes = doc_stats(index.postings).groupBy(length_class.alias("class")).agg(F.ceil(F.count("*") / block_rows).alias("n_parts"))
    part = F.conv(F.substring(F.md5(F.col("id").cast("string").cast("binary")), 1, 8), 16, 10).cast("bigint") % F.col("n_parts")
    placed = index.postings.withColumn("class", length_class).join(F.broadcast(stored(sizes, "length-classes")), "class")
    block = F.col("class") * CLASS_STEP + part
    mean_length = index.totals.select("words").scalar() / index.totals.select("n").scalar()
    weighed = placed.select(
        "term", block.alias("block"), "id", "tf", "length", _weight(F.col("tf"), F.col("length"), mean_length).alias("weight")
    )
    # Dealt by block before they are gathered, as arrays of a map side would only be copied along.
    grouped = weighed.repartition("block").groupBy("term", "block").agg(
        F.max("weight").alias("peak"), F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct("id", "tf", "length"))).alias("postings")
    )
    # Sorted by term within files, so that bounds read runs of one term.
    grouped.sortWithinPartitions("term", "block").write.parquet(f"{path}/blocks")
    spark = index.postings.sparkSession
    blocks = spark.read.parquet(f"{path}/blocks")
    counted = blocks.groupBy("term").agg(F.sum("n").alias("df"), F.count("*").alias("n_blocks"))
    counted.write.parquet(f"{path}/terms")
    index.totals.write.parquet(f"{path}/totals")
    return load_blocks(spark, path)


def load_blocks(spark: SparkSession, path: str) -> BlockIndex:
    blocks = spark.read.parquet(f"{path}/blocks")
    # The postings are pruned from the scan of the maxima.
    return BlockIndex(
        blocks.select("term", "block", "peak", "n"),
        blocks.select("term", "block", "postings"),
        spark.read.parquet(f"{path}/terms"),
        spark.read.parquet(f"{path}/totals"),
    )


def _scores(entries: DataFrame, chosen: DataFrame, index: BlockIndex) -> DataFrame:
    """(question_id, id, score) of all texts in the chosen (question_id, block) that share a term."""
    n = index.totals.select("n").scalar()
    mean_length = index.totals.select("words").scalar() / n
    norm = K1 * (1 - B + B * F.col("length") / mean_length)
    share = F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + norm)
    wanted = stored(entries.join(chosen, ["question_id", "block"], "left_semi").select("question_id", "block", "term", "idf"), "opened-entries")
    if few_rows(wanted):
        opened = index.blocks.join(F.broadcast(wanted), ["term", "block"])
    else:
        terms = stored(wanted.select("term").distinct(), "opened-terms")
        # Postings of terms that nobody asks for stay where they are.
        asked_for = index.blocks.join(F.broadcast(terms), "term", "left_semi") if few_rows(terms) else index.blocks
        opened = asked_for.join(wanted, ["term", "block"])
    return (
        opened.select("question_id", "idf", F.inline("postings"))
        .groupBy("question_id", "id")
        .agg(F.round(F.sum(share), SCORE_DIGITS).alias("score"))
    )


def _first_blocks(bounds: DataFrame, limit: int, least_blocks: int) -> DataFrame:
    """(question_id, block) with the highest bounds, as many as surely hold `limit` texts.

    Every block holds one text at least, so more than `limit` are never ranked.
    """
    order = W.partitionBy("question_id").orderBy(F.desc(F.round("bound", SCORE_DIGITS)), "block")
    head = bounds.withColumn("nth", F.row_number().over(order)).filter(F.col("nth") <= max(limit, least_blocks))
    before = F.sum("sure").over(W.partitionBy("question_id").orderBy("nth").rowsBetween(W.unboundedPreceding, -1))
    return head.withColumn("before", F.coalesce(before, F.lit(0))).filter(
        (F.col("nth") <= least_blocks) | (F.col("before") < limit)
    ).select("question_id", "block")


def block_topk(
    questions: DataFrame,
    index: BlockIndex,
    limit: int = CANDIDATES,
    first_blocks: int = FIRST_BLOCKS,
    rows_per_salt: int = ROWS_PER_SALT,
    max_hot: int = MAX_HOT_KEYS,
) -> tuple[DataFrame, DataFrame]:
    """(hits, report): (question_id, id, score, rank) as `lexical_topk` gives them, and per question
    (question_id, n_blocks, n_first, n_opened, n_skipped) of the blocks that hold one of its terms.
    """
    n, df = index.totals.select("n").scalar(), F.col("df")
    weight = F.log(1 + (n - df + 0.5) / (df + 0.5))
    asked = stored(
        questions.select("question_id", "term").join(index.terms, "term").select("question_id", "term", weight.alias("idf")),
        "asked-terms",
    )
    if few_rows(asked):
        met = index.maxima.join(F.broadcast(asked), "term")
    else:
        met = salted_join(index.maxima, asked, "term", hot_keys(index.terms, "term", "n_blocks", rows_per_salt, max_hot), "block")
    entries = stored(met.select("question_id", "block", "term", "idf", "peak", "n"), "block-entries")
    # A block has at least as many texts with a term as its longest array.
    bounds = stored(
        entries.groupBy("question_id", "block").agg(F.sum(F.col("idf") * F.col("peak")).alias("bound"), F.max("n").alias("sure")),
        "block-bounds",
    )
    first = stored(_first_blocks(bounds, limit, first_blocks), "first-blocks")
    opened = stored(_scores(entries, first, index), "first-scores")
    best = W.partitionBy("question_id").orderBy(F.desc("score"), "id")
    # With fewer texts than asked for there is no threshold.
    thresholds = stored(
        opened.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") == limit).select("question_id", F.col("score").alias("least")),
        "thresholds",
    )
    judged = (
        bounds.join(first.withColumn("is_first", F.lit(True)), ["question_id", "block"], "left")
        .join(thresholds, "question_id", "left")
        .select(
            "question_id",
            "block",
            F.coalesce("is_first", F.lit(False)).alias("is_first"),
            (F.col("is_first").isNull() & F.coalesce(F.col("bound") + SLACK < F.col("least"), F.lit(False))).alias("skipped"),
        )
    )
    rest = judged.filter(~F.col("is_first") & ~F.col("skipped"))
    hits = (
        opened.unionByName(_scores(entries, rest, index))
        .withColumn("rank", F.row_number().over(best))
        .filter(F.col("rank") <= limit)
    )
    report = judged.groupBy("question_id").agg(
        F.count("*").alias("n_blocks"),
        F.count_if("is_first").alias("n_first"),
        F.count_if(~F.col("is_first") & ~F.col("skipped")).alias("n_opened"),
        F.count_if("skipped").alias("n_skipped"),
    )
    return hits, report
