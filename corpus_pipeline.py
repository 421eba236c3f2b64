"""From raw documents to training ids: quality, exact copies, near copies, mixing, tokens."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from plumbline.llm import exact_dedup, jaccard_join, mixing, quality, sentencepiece
from plumbline.llm.registry import VOCABULARY
from plumbline.plans.tables import load
from plumbline.session import scratch_path

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier predicts as good; it learns from the given documents' labels."""
    model = quality.fit(docs, load(spark, sf_dir, "labels"))
    scored = quality.classify(docs, model)
    return scored.filter("predicted = 1").select(*docs.columns)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of every group of equal texts, that with the largest id."""
    return exact_dedup.drop_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every group linked by a Jaccard similarity of 0.8 on five-word shingles."""
    return jaccard_join.drop_near_duplicates(docs, words=5, percent=80)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated to the target weights of their sources, dealt out anew."""
    return mixing.mix(docs).select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and ids of every copy."""
    vocabulary = sentencepiece.load_vocabulary(VOCABULARY)
    return sentencepiece.encode_texts(docs.select("doc_id", "text"), vocabulary).select("doc_id", "n_tokens", "ids")


STAGES: list[tuple[str, Stage]] = [
    ("quality_classifier", keep_good),
    ("exact_dedup", drop_exact_copies),
    ("ngram_jaccard_join", drop_near_copies),
    ("mixing", mix_sources),
    ("sentencepiece", encode),
]

# A trained classifier, exact set joins and subword encoding are beyond SQL; tests hold the rows
# against a brute-force version of the stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to documents, each written as Parquet and read again by the next."""
    docs = load(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
