"""Rank fusion, foreign-key expansion and table selection."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plumbline.functions.frames import union_all

# The constant of reciprocal rank fusion (Cormack et al. 2009)
# and the number of items kept.
RRF_K = 60
TOP_K = 10


def rrf(rankings: dict[str, DataFrame], k: int = RRF_K) -> DataFrame:
    """(question_id, id, score, <name>_rank ...): sum of 1 / (k + rank) over all rankings."""
    long = union_all(
        [r.select("question_id", "id", "rank", F.lit(name).alias("signal")) for name, r in rankings.items()]
    )
    return long.groupBy("question_id", "id").agg(
        F.sum(F.lit(1.0) / (F.lit(k) + F.col("rank"))).alias("score"),
        *[F.max(F.when(F.col("signal") == name, F.col("rank"))).alias(f"{name}_rank") for name in rankings],
    )


def hybrid_topk(dense: DataFrame, lexical: DataFrame, top_k: int = TOP_K, k: int = RRF_K) -> DataFrame:
    """(question_id, id, score, dense_rank, lexical_rank, pos): both rankings fused.

    Equal scores keep the dense order, then the lexical one.
    """
    best = W.partitionBy("question_id").orderBy(
        F.desc("score"), F.asc_nulls_last("dense_rank"), F.asc_nulls_last("lexical_rank")
    )
    return (
        rrf({"dense": dense, "lexical": lexical}, k)
        .withColumn("pos", F.row_number().over(best))
        .filter(F.col("pos") <= top_k)
    )


def fk_edges(fk: DataFrame) -> DataFrame:
    """(src, dst): tables linked by a foreign key, in both directions."""
    there = fk.select(F.col("table").alias("src"), F.col("references_table").alias("dst"))
    back = fk.select(F.col("references_table").alias("src"), F.col("table").alias("dst"))
    return there.unionByName(back).distinct()


def expand_fk(hits: DataFrame, edges: DataFrame, max_total: int = TOP_K) -> DataFrame:
    """Append tables one foreign key away, up to `max_total` per question.

    New tables follow in the order of the hit that brought them, then by name;
    they score 0 and have no ranks. With max_total at the number of hits nothing
    is added.
    """
    none = F.lit(None).cast("int")
    old = hits.select(
        "question_id",
        "id",
        F.lit(0).alias("is_new"),
        "pos",
        F.struct("score", "dense_rank", "lexical_rank").alias("hit"),
    )
    new = hits.join(edges, hits["id"] == edges["src"]).select(
        "question_id",
        F.col("dst").alias("id"),
        F.lit(1).alias("is_new"),
        "pos",
        F.struct(F.lit(0.0).alias("score"), none.alias("dense_rank"), none.alias("lexical_rank")).alias("hit"),
    )
    # A table that is already a hit keeps its own entry: is_new = 0 is smaller.
    merged = old.unionByName(new).groupBy("question_id", "id").agg(
        F.min(F.struct("is_new", "pos", "hit")).alias("m")
    )
    order = W.partitionBy("question_id").orderBy("m.is_new", "m.pos", "id")
    return (
        merged.withColumn("_nth", F.row_number().over(order))
        .filter((F.col("m.is_new") == 0) | (F.col("_nth") <= max_total))
        .select(
            "question_id",
            "id",
            F.col("m.hit.score").alias("score"),
            F.col("m.hit.dense_rank").alias("dense_rank"),
            F.col("m.hit.lexical_rank").alias("lexical_rank"),
            F.col("_nth").alias("pos"),
        )
    )


def select_tables(
    mode: str,
    questions: DataFrame,
    tables: list[str],
    hits: DataFrame | None = None,
    edges: DataFrame | None = None,
    max_total: int = TOP_K,
) -> DataFrame:
    """(question_id, table, pos): the tables whose schema a question gets.

    'baseline' gives all tables in name order; 'hybrid' and 'agent' the hits,
    expanded along foreign keys when `edges` are given. Unknown names are dropped.
    """
    if mode == "baseline":
        names = F.array(*[F.lit(t) for t in sorted(tables)])
        return questions.select("question_id", F.posexplode(names).alias("pos", "table")).select(
            "question_id", "table", (F.col("pos") + 1).alias("pos")
        )
    if mode not in ("hybrid", "agent"):
        raise ValueError(f"unknown mode: {mode}")
    if hits is None:
        raise ValueError(f"mode {mode} needs the hits of a search")
    chosen = expand_fk(hits, edges, max_total) if edges is not None else hits
    return chosen.filter(F.col("id").isin(tables)).select("question_id", F.col("id").alias("table"), "pos")


def retrieval_recall(selected: DataFrame, gold: DataFrame) -> DataFrame:
    """(question_id, n_gold, recall): share of the gold tables (question_id, table) selected."""
    found = selected.select("question_id", "table").distinct().withColumn("hit", F.lit(1))
    return (
        gold.select("question_id", "table")
        .distinct()
        .join(found, ["question_id", "table"], "left")
        .groupBy("question_id")
        .agg(F.count("*").alias("n_gold"), F.round(F.count("hit") / F.count("*"), 6).alias("recall"))
    )


def mean_recall(recalls: DataFrame) -> DataFrame:
    """One row: the mean over all questions with gold tables."""
    return recalls.agg(F.count("*").alias("questions"), F.round(F.avg("recall"), 6).alias("mean_recall"))
