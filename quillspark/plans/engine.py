"""Facade (R10, F10, G5, V6, V7): search by mode, answer, research."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark import schemas
from quillspark.operators import bm25, claims, dense, evidence, fusion, rerank
from quillspark.operators.filters import Filters, with_filter_columns

MODES = ("bm25", "dense", "hybrid", "reranked")
_NATIVE = {"bm25": "rank", "dense": "rank", "hybrid": "hybrid_rank", "reranked": "reranked_rank"}


def project(results: DataFrame, mode: str) -> DataFrame:
    """the columns of RESULT; what the mode doesn't produce is null."""
    have = dict.fromkeys(results.columns)
    out: list[Column] = []
    for c in schemas.RESULT:
        if c == "final_rank":
            out.append(F.col(_NATIVE[mode]).alias(c))
        elif mode in ("bm25", "dense") and c in (f"{mode}_rank", f"{mode}_score"):
            out.append(F.col(c.removeprefix(f"{mode}_")).alias(c))
        elif c in have:
            out.append(F.col(c))
        else:
            out.append(F.lit(None).cast("int" if c.endswith("rank") else "double").alias(c))
    return results.select(*out)


@dataclass
class Engine:
    """Searches over docs (uid, text, court, case_number, judgment_date) and points (uid, embedding)."""

    docs: DataFrame
    points: DataFrame
    embedder: dense.Embedder
    scorer: rerank.PairScorer | None = None
    rrf_k: int = fusion.RRF_K
    depth: int = fusion.DEPTH
    candidate_k: int = rerank.CANDIDATES
    index: bm25.Index | None = field(default=None)

    def search(self, queries: DataFrame, mode: str = "reranked", top_k: int = 10, filters: Filters | None = None) -> DataFrame:
        """Results (F10) of a table with query_id, query."""
        if mode not in MODES or not 1 <= top_k <= 50:
            raise ValueError("unknown mode, or top_k isn't 1 to 50")
        eligible = with_filter_columns(self.docs).where((filters or Filters()).predicate()).select("uid")
        if mode == "bm25":
            return project(self._bm25(queries, eligible, top_k), mode)
        if mode == "dense":
            return project(self._dense(queries, eligible, top_k), mode)
        fused = fusion.fuse(self._bm25(queries, eligible, self.depth), self._dense(queries, eligible, self.depth), self.rrf_k, max(top_k, self.candidate_k) if mode == "reranked" else top_k)
        if mode == "hybrid":
            return project(fused, mode)
        full = fused.join(self.docs.select("uid", "text"), "uid").join(queries, "query_id")
        return project(rerank.rerank(full, self.scorer, self.candidate_k, top_k), mode)

    def _bm25(self, queries: DataFrame, eligible: DataFrame, k: int) -> DataFrame:
        if self.index is not None:
            return bm25.top_k(bm25.scores(self.index, bm25.query_terms(queries), eligible), k)
        marked = self.docs.join(eligible.withColumn("__eligible", F.lit(True)), "uid", "left")
        return bm25.search(marked, queries, k, F.coalesce("__eligible", F.lit(False)))

    def _dense(self, queries: DataFrame, eligible: DataFrame, k: int) -> DataFrame:
        vectors = dense.embed(queries, self.embedder, ("query_id",), "query").withColumnRenamed("embedding", "vector")
        return dense.search(self.points.join(eligible, "uid", "left_semi"), vectors, k)

    def evidence(self, queries: DataFrame, **options) -> DataFrame:
        """G1: evidence of reranked results, with texts."""
        found = self.search(queries, "reranked", **options)
        return evidence.assign(found).join(self.docs.select("uid", "text"), "uid").join(queries, "query_id")

    def answer(self, queries: DataFrame, provider=None, **options) -> DataFrame:
        """query_id, answer, used_evidence_ids, error. provider(DataFrame of G2 prompts) -> query_id, answer, declared; without
        one the extractive answers (G3).

        Queries without evidence get the fixed answer and don't reach the provider.
        """
        found = self.evidence(queries, **options)
        asked = evidence.prompts(found)
        said = asked.join(evidence.extractive_answers(found) if provider is None else provider(asked), "query_id", "left")
        error = F.when(F.col("answer").isNull(), "no answer").otherwise(evidence.integrity_error(F.col("answer"), F.col("declared"), F.col("evidence_ids")))
        good = said.select("query_id", "answer", F.col("declared").alias("used_evidence_ids"), error.alias("error"))
        bare = queries.join(asked.select("query_id"), "query_id", "left_anti")
        return good.unionByName(bare.select("query_id", F.lit(evidence.NO_EVIDENCE).alias("answer"), F.array().cast("array<string>").alias("used_evidence_ids"), F.lit(None).cast("string").alias("error")))


def research(answers: DataFrame, verdicts: DataFrame | None) -> DataFrame:
    """V6: query_id, answer, verification (complete, not_run, unavailable) and the summary, null where unavailable.

    answers: query_id, answer, used_evidence_ids. verdicts: None if the verifier failed; the answers are kept.
    """
    zero = F.lit(0).cast("long")
    bare = (F.size("used_evidence_ids") == 0) & (F.col("answer") == evidence.NO_EVIDENCE)
    names = [s.lower() for s in claims.STATUSES]
    if verdicts is None:
        return answers.select("query_id", "answer", F.when(bare, "not_run").otherwise("unavailable").alias("verification"), *[F.when(bare, zero).alias(n) for n in names])
    counted = claims.summary(claims.assemble(claims.claims(answers.select("query_id", "answer")), verdicts))
    joined = answers.join(counted, "query_id", "left")
    return joined.select("query_id", "answer", F.when(bare, "not_run").otherwise("complete").alias("verification"), *[F.coalesce(n, zero).alias(n) for n in names])


def state_errors(responses: DataFrame) -> DataFrame:
    """V7: responses whose state and summary contradict."""
    names = [s.lower() for s in claims.STATUSES]
    empty = F.lit(True)
    for n in names:
        empty = empty & F.col(n).isNull()
    total = sum((F.coalesce(F.col(n), F.lit(0)) for n in names), F.lit(0))
    problem = (
        F.when(~F.col("verification").isin("complete", "not_run", "unavailable"), "unknown state")
        .when((F.col("verification") == "unavailable") & ~empty, "a summary without verification")
        .when((F.col("verification") == "not_run") & (empty | (total > 0)), "verdicts without a run")
        .when((F.col("verification") == "complete") & empty, "no summary")
    )
    return responses.select("query_id", problem.alias("problem")).where("problem is not null")
