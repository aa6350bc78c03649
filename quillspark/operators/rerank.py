"""Reranking (R6, R7, W4, W5): the best fused candidates are scored as (query, text) pairs in batches."""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions import text

CANDIDATES, TOP, BATCH = 30, 10, 16


class PairScorer(Protocol):
    """Scores of (query, text) pairs; runs on executors, one score a pair."""

    def score(self, pairs: list[tuple[str, str]]) -> list[float]: ...


def checked(scores: list[float], n: int) -> list[float]:
    """As many finite numbers as pairs."""
    out = [float(s) for s in scores]
    if len(out) != n or not all(map(math.isfinite, out)):
        raise ValueError("a scorer gives one finite number a pair")
    return out


def overlap(query, document):
    """A deterministic stand-in in the JVM: the share of the query's distinct tokens that the document has."""
    q = F.array_distinct(text.tokens(text.latin_fold(query)))
    d = text.tokens(text.latin_fold(document))
    return F.when(F.size(q) == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(q, d)) / F.size(q))


def rerank(candidates: DataFrame, scorer: PairScorer | None = None, candidate_k: int = CANDIDATES, top: int = TOP, batch: int = BATCH, digits: int | None = None) -> DataFrame:
    """Adds cross_encoder_score and reranked_rank to the best of `candidates` (query_id, query, uid, text, hybrid_rank …).

    Without a scorer: `overlap`. Ties: hybrid rank, then uid. At most min(candidate_k, top) rows a query.
    """
    if candidate_k <= 0 or top <= 0:
        raise ValueError("candidate_k and top are positive")
    some = candidates.where(F.col("hybrid_rank") <= candidate_k)
    if scorer is None:
        score = overlap(F.col("query"), F.col("text"))
    else:

        @F.pandas_udf("double")
        def model(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
            for q, t in parts:
                pairs = list(zip(q.fillna(""), t.fillna(""), strict=True))
                out: list[float] = []
                for k in range(0, len(pairs), batch):
                    out += checked(scorer.score(pairs[k : k + batch]), len(pairs[k : k + batch]))
                yield pd.Series(out, dtype="float64")

        score = model("query", "text")
    scored = some.withColumn("cross_encoder_score", score if digits is None else F.round(score, digits))
    order = Window.partitionBy("query_id").orderBy(F.desc("cross_encoder_score"), "hybrid_rank", "uid")
    return scored.withColumn("reranked_rank", F.row_number().over(order)).where(F.col("reranked_rank") <= top)
