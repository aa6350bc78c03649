"""Reciprocal rank fusion (R4, R5, A6, JN5, W3) for batches of queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions import numbers
from quillspark.operators.bm25 import top_k

RRF_K, DEPTH = 10, 50


def positions(ranked: DataFrame, by: tuple[str, ...] = ("query_id",)) -> DataFrame:
    """First position of each uid in its list; positions count duplicates and aren't compacted.

    ranked: query_id, uid, score, rank. Lists that come with distinct uids are unchanged.
    """
    at = F.row_number().over(Window.partitionBy(*by).orderBy("rank", "uid"))
    placed = ranked.withColumn("uid", F.trim(F.col("uid"))) if dict(ranked.dtypes)["uid"] == "string" else ranked
    return (
        placed.withColumn("position", at)
        .groupBy(*by, "uid")
        .agg(F.min(F.struct("position", "score")).alias("p"))
        .select(*by, "uid", F.col("p.position").alias("rank"), F.col("p.score").alias("score"))
    )


def fuse(bm25: DataFrame, dense: DataFrame, k: int | Column = RRF_K, top: int | None = None, digits: int | None = None, by: tuple[str, ...] = ("query_id",), unique: bool = False) -> DataFrame:
    """unique: lists are known to hold each uid once; otherwise its first position counts (W3). query_id, uid, bm25_rank, bm25_score, dense_rank, dense_score, rrf_score, hybrid_rank."""
    if isinstance(k, bool) or isinstance(k, int) and k <= 0:
        raise ValueError("k is positive")
    bm25, dense = (bm25, dense) if unique else (positions(bm25, by), positions(dense, by))
    named = lambda df, name: df.select(*by, "uid", F.col("rank").alias(f"{name}_rank"), F.col("score").alias(f"{name}_score"))
    both = named(bm25, "bm25").join(named(dense, "dense"), [*by, "uid"], "full_outer")
    part = lambda c: F.coalesce(numbers.rrf_term(F.col(c), k), F.lit(0.0))
    score = part("bm25_rank") + part("dense_rank")
    scored = both.withColumn("rrf_score", score if digits is None else F.round(score, digits))
    order = Window.partitionBy(*by).orderBy(F.desc("rrf_score"), "uid")
    ranked = scored.withColumn("hybrid_rank", F.row_number().over(order))
    return ranked if top is None else ranked.where(F.col("hybrid_rank") <= top)


def candidate_counts(fused: DataFrame) -> DataFrame:
    """How many candidates came from either list, both, and together."""
    return fused.groupBy("query_id").agg(
        F.count("bm25_rank").alias("bm25_candidates"),
        F.count("dense_rank").alias("dense_candidates"),
        F.count_if(F.col("bm25_rank").isNotNull() & F.col("dense_rank").isNotNull()).alias("common_candidates"),
        F.count("*").alias("candidates"),
    )


__all__ = ["DEPTH", "RRF_K", "candidate_counts", "fuse", "positions", "top_k"]
