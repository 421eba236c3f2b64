"""Registered queries of the corpus operators; each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import (
    chat,
    exact_dedup,
    jaccard_join,
    katz,
    licenses,
    line_templates,
    mixing,
    pii,
    quality,
    resampling,
    sentencepiece,
    spelling,
    syncmers,
)
from plumbline.llm.common import id_hash
from plumbline.plans.tables import load

Query = Callable[[SparkSession, str], DataFrame]

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
# Both turns of the conversation that op13 adds.
MARKS_SAID = "</s>[INST] ok [/INST]"


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(load(spark, sf_dir, "documents"))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    found = pii.find_spans(docs, pii.fit(docs))
    base = F.filter("spans", lambda s: s["base"])

    def written(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def count(kind):
        return F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")

    counts = [count(kind) for kind in pii.KINDS]
    return found.select(
        "doc_id", *counts, F.sha2(written(base).cast("binary"), 256).alias("base_sha256"), written(F.col("spans")).alias("spans")
    )


def op3_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.near_duplicates(load(spark, sf_dir, "documents"))


def op4_line_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_templates.drop_recurring_lines(load(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")


def op5_syncmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return syncmers.fingerprints(load(spark, sf_dir, "documents"))


def op6_sentencepiece(spark: SparkSession, sf_dir: str, model_file: str = VOCABULARY) -> DataFrame:
    """Ids of every text, and whether decoding gives the text back."""
    vocabulary = sentencepiece.load_vocabulary(model_file)
    docs = load(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    decoded = sentencepiece.decode_ids(sentencepiece.encode_texts(docs, vocabulary), vocabulary)
    return decoded.select(
        "doc_id",
        "n_tokens",
        "ids",
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
        (F.col("decoded") == F.col("text")).alias("round_trip"),
    )


def op7_katz(spark: SparkSession, sf_dir: str) -> DataFrame:
    return katz.score(load(spark, sf_dir, "documents"))


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.summary(licenses.scan(load(spark, sf_dir, "documents")))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(load(spark, sf_dir, "documents"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.fit(docs, load(spark, sf_dir, "labels"))
    held_out = F.coalesce(id_hash(F.col("doc_id")) % 4 == 2, F.lit(False))
    return quality.classify(docs, model).select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op11_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = resampling.resample(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"))
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(load(spark, sf_dir, "documents"))


def op13_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The given conversations and one, -1, whose texts consist of marks."""
    given = load(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    marks = [(-1, 0, "user", MARKS_SAID), (-1, 1, "assistant", MARKS_SAID)]
    own = spark.createDataFrame(marks, "conv_id bigint, turn bigint, role string, text string")
    return chat.digest(chat.expand(given.unionByName(own)))


def queries() -> dict[str, Query]:
    return {
        "op1_exact_dedup": op1_exact_dedup,
        "op2_pii": op2_pii,
        "op3_ngram_jaccard": op3_ngram_jaccard,
        "op4_line_templates": op4_line_templates,
        "op5_syncmers": op5_syncmers,
        "op6_sentencepiece": op6_sentencepiece,
        "op7_katz": op7_katz,
        "op8_licenses": op8_licenses,
        "op9_mixing": op9_mixing,
        "op10_quality": op10_quality,
        "op11_resampling": op11_resampling,
        "op12_spelling": op12_spelling,
        "op13_chat": op13_chat,
    }
