"""Registered queries: search over documents and over the catalog."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions.text import estimate_tokens
from plumbline.operators import fusion, lexical, vectors
from plumbline.plans import retrieval as r
from plumbline.plans.registry_eval import Query
from plumbline.session import stored


def _rounded(df: DataFrame, column: str, digits: int) -> DataFrame:
    return df.withColumn(column, F.round(column, digits) + F.lit(0.0))


def _text_vectors(spark: SparkSession, sf: str) -> DataFrame:
    hashed = stored(vectors.hashed_terms(r.document_postings(spark, sf), r.DIM), "hashed-terms")
    made = vectors.text_vectors(hashed, vectors.fit_idf(hashed), r.DIM)
    return (
        # Outer, as else vectors are made twice, once for a filter on their size.
        made.select("id", F.posexplode_outer("embedding").alias("bucket", "weight"))
        .withColumn("weight", F.round("weight", 6))
        .filter("weight <> 0")
    )


def _approx(spark: SparkSession, sf: str) -> DataFrame:
    """Recall of the approximate search against the exact one."""
    questions, corpus = r.all_vectors(spark, sf)
    found = vectors.dense_topk_approx(questions, corpus, n_probe=8)
    return vectors.recall(found, vectors.dense_topk(questions, corpus))


def _schema_columns(df: DataFrame) -> DataFrame:
    text = F.col("schema_text")
    return df.select("question_id", F.md5(text).alias("schema_md5"), estimate_tokens(text).alias("est_tokens"), "n_tables")


def _prompts(spark: SparkSession, sf: str) -> DataFrame:
    text = F.col("prompt")
    return r.prompts(spark, sf).select("question_id", F.md5(text).alias("prompt_md5"), estimate_tokens(text).alias("est_tokens"))


def _recall(spark: SparkSession, sf: str) -> DataFrame:
    return fusion.retrieval_recall(r.selected(spark, sf), r.gold(spark, sf))


def queries() -> dict[str, Query]:
    return {
        "text_vectors": _text_vectors,
        "dense_topk": lambda s, d: _rounded(vectors.dense_topk(*r.every_vector(s, d)), "dist", 6),
        "dense_topk_blocked": lambda s, d: _rounded(vectors.dense_topk_blocked(*r.every_vector(s, d)), "dist", 6),
        "dense_topk_approx": _approx,
        "tokenize": r.document_postings,
        "postings": lambda s, d: lexical.term_stats(r.document_postings(s, d)),
        "doc_stats": lambda s, d: lexical.doc_stats(r.document_postings(s, d)),
        "lexical_topk": lambda s, d: _rounded(r.document_lexical(s, d), "score", 6),
        "block_topk": lambda s, d: _rounded(r.document_blocks(s, d)[0], "score", 6),
        "block_report": lambda s, d: r.document_blocks(s, d)[1],
        "rrf": lambda s, d: _rounded(r.document_rrf(s, d), "score", 9),
        "hybrid_topk": lambda s, d: _rounded(r.document_hits(s, d), "score", 9),
        "fk_edges": r.edge_report,
        "table_hits": lambda s, d: _rounded(r.table_hits(s, d), "score", 9),
        "expand_fk": lambda s, d: _rounded(
            fusion.expand_fk(r.table_hits(s, d), r.edges(s, d), r.TABLE_TOTAL), "score", 9
        ),
        "select_tables_baseline": lambda s, d: r.selected(s, d, "baseline"),
        "select_tables": r.selected,
        "retrieval_recall": _recall,
        "mean_recall": lambda s, d: fusion.mean_recall(_recall(s, d)),
        "render_schema": lambda s, d: _schema_columns(r.schema_texts(s, d)),
        "build_prompt": _prompts,
    }
