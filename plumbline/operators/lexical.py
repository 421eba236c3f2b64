"""Word search: terms, postings and BM25 ranking."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plumbline.functions.ranking import split_groups
from plumbline.functions.skew import MAX_HOT_KEYS, ROWS_PER_SALT, few_rows, hot_keys, salted_join
from plumbline.functions.text import STOP_WORDS, stem, words
from plumbline.session import stored

CANDIDATES = 30
SCORE_DIGITS = 9
# The usual BM25 parameters.
K1 = 1.2
B = 0.75


def _kept(text: str) -> Column:
    return F.filter(words(F.col(text)), lambda w: (w != "") & ~w.isin(STOP_WORDS))


def _counted_in_place(corpus: DataFrame, key: str, text: str) -> DataFrame:
    """Terms of rows with an id of their own, counted inside each row: equal stems lie together once sorted."""
    length, terms, starts = F.col("length"), F.col("terms"), F.col("starts")
    places = F.when(length > 0, F.sequence(F.lit(0), length - 1))
    counted = F.transform(
        starts, lambda i, nth: F.struct(F.get(terms, i).alias("term"), (F.coalesce(F.get(starts, nth + 1), length) - i).cast("bigint").alias("tf"))
    )
    return (
        corpus.select(F.col(key).alias("id"), _kept(text).alias("kept"))
        .select("id", F.size("kept").alias("length"), F.array_sort(F.transform("kept", stem)).alias("terms"))
        .select("id", "length", "terms", F.filter(places, lambda i: (i == 0) | (F.get(terms, i) != F.get(terms, i - 1))).alias("starts"))
        # Outer, as else a filter on the array's size is put below and counts every text twice.
        .select("id", "length", F.explode_outer(counted).alias("t"))
        .select("id", "t.term", "t.tf", "length")
        .filter("term IS NOT NULL")
    )


def _counted_by_id(corpus: DataFrame, key: str, text: str) -> DataFrame:
    """Terms of texts that may share an id: those of one id and length count as one text."""
    return (
        corpus.select(F.col(key).alias("id"), _kept(text).alias("kept"))
        .select("id", F.size("kept").alias("length"), F.explode("kept").alias("word"))
        .groupBy("id", "length", stem(F.col("word")).alias("term"))
        .agg(F.count("*").alias("tf"))
        .select("id", "term", "tf", "length")
    )


def tokenize(corpus: DataFrame, key: str = "id", text: str = "text") -> DataFrame:
    """(id, term, tf, length): stems of every text without stop words.

    `length` is the number of kept words of the text, so that no second
    aggregate per text is needed. Ids are read first: only texts that share one
    are shuffled.
    """
    shared = stored(corpus.groupBy(key).agg(F.count("*").alias("_n")).filter("_n > 1").select(key), "shared-ids")
    if shared.isEmpty():
        return _counted_in_place(corpus, key, text)
    if not few_rows(shared):
        return _counted_by_id(corpus, key, text)
    own, common = split_groups(corpus, [key], F.broadcast(shared))
    return _counted_in_place(own, key, text).unionByName(_counted_by_id(common, key, text))


def term_stats(postings: DataFrame) -> DataFrame:
    """(term, df): texts per term."""
    return postings.groupBy("term").agg(F.count("*").alias("df"))


def doc_stats(postings: DataFrame) -> DataFrame:
    """(id, length, n_terms) per text."""
    return postings.groupBy("id").agg(F.max("length").alias("length"), F.count("*").alias("n_terms"))


@dataclass(frozen=True)
class Index:
    """A stored inverted index: postings (id, term, tf, length), terms (term, df), totals (n, words)."""

    postings: DataFrame
    terms: DataFrame
    totals: DataFrame


def build_index(corpus: DataFrame, path: str, key: str = "id", text: str = "text") -> Index:
    """Tokenize a corpus once and store what searches read."""
    tokenize(corpus, key, text).write.parquet(f"{path}/postings")
    postings = corpus.sparkSession.read.parquet(f"{path}/postings")
    term_stats(postings).write.parquet(f"{path}/terms")
    postings.agg(F.count_distinct("id").alias("n"), F.sum("tf").alias("words")).write.parquet(f"{path}/totals")
    return load_index(corpus.sparkSession, path)


def load_index(spark: SparkSession, path: str) -> Index:
    return Index(*(spark.read.parquet(f"{path}/{part}") for part in ("postings", "terms", "totals")))


def write_bucketed(index: Index, table: str, buckets: int) -> None:
    """Postings as a table bucketed by term, which word search joins without an exchange."""
    index.postings.write.bucketBy(buckets, "term").sortBy("term").mode("overwrite").saveAsTable(table)


def lexical_topk(
    questions: DataFrame,
    index: Index,
    limit: int = CANDIDATES,
    rows_per_salt: int = ROWS_PER_SALT,
    max_hot: int = MAX_HOT_KEYS,
) -> DataFrame:
    """(question_id, id, score, rank): per question the best items sharing any term.

    questions: (question_id, term), one row per distinct term. Items without a
    term cannot be found and do not count.
    """
    n = index.totals.select("n").scalar()
    mean_length = index.totals.select("words").scalar() / n
    df = F.col("df")
    weight = F.log(1 + (n - df + 0.5) / (df + 0.5))
    # Stored and counted: few questions are broadcast and the postings stay where they are.
    asked = stored(
        questions.select("question_id", "term").join(index.terms, "term").select("question_id", "term", weight.alias("idf")),
        "asked-terms",
    )
    if few_rows(asked):
        met = index.postings.join(F.broadcast(asked), "term")
    else:
        met = salted_join(index.postings, asked, "term", hot_keys(index.terms, "term", "df", rows_per_salt, max_hot), "id")
    norm = K1 * (1 - B + B * F.col("length") / mean_length)
    share = F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + norm)
    best = W.partitionBy("question_id").orderBy(F.desc("score"), "id")
    return (
        met.groupBy("question_id", "id")
        .agg(F.round(F.sum(share), SCORE_DIGITS).alias("score"))
        .withColumn("rank", F.row_number().over(best))
        .filter(F.col("rank") <= limit)
    )
