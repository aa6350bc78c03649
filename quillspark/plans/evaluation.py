"""Graded retrieval metrics and their checks (A7-A13, J4, E1, E2, JN7, JN12, JN14, W8) for all systems and queries at once.

rankings: system, query_id, position, uid. gold: query_id, uid, grade. Results carry system.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspark.functions import numbers

METRICS = ("recall_at_5", "recall_at_10", "reciprocal_rank", "ndcg_at_10")


def compacted(rankings: DataFrame, k: int) -> DataFrame:
    """Positions beyond k are cut, then repeated ids dropped, then ranks renumbered."""
    firsts = rankings.where(F.col("position") <= k).groupBy("system", "query_id", "uid").agg(F.min("position").alias("position"))
    return firsts.withColumn("rank", F.row_number().over(Window.partitionBy("system", "query_id").orderBy("position")))


def ideal(gold: DataFrame, k: int = 10) -> DataFrame:
    """query_id, n_gold, ideal (the best gain that k places can have)."""
    at = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("grade"), "uid"))
    placed = gold.withColumn("at", at)
    return placed.groupBy("query_id").agg(F.count("*").alias("n_gold"), F.sum(F.when(F.col("at") <= k, numbers.gain(F.col("grade"), F.col("at")))).alias("ideal"))


def per_query(rankings: DataFrame, gold: DataFrame, systems: DataFrame | None = None) -> DataFrame:
    """A row for each system and query of the gold set, also where nothing was retrieved."""
    systems = rankings.select("system").distinct() if systems is None else systems
    hits = compacted(rankings, 10).join(gold, ["query_id", "uid"])
    five = compacted(rankings, 5).join(gold, ["query_id", "uid"]).groupBy("system", "query_id").agg(F.count("*").alias("hits_5"))
    ten = hits.groupBy("system", "query_id").agg(
        F.count("*").alias("hits_10"), F.min("rank").alias("first_relevant_rank"), F.sum(numbers.gain(F.col("grade"), F.col("rank"))).alias("dcg")
    )
    frame = ideal(gold).crossJoin(systems)  # the queries of the gold set, for each system
    every = frame.join(ten, ["system", "query_id"], "left").join(five, ["system", "query_id"], "left")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return every.select(
        "system", "query_id",
        zero(F.col("hits_5") / F.col("n_gold")).alias("recall_at_5"),
        zero(F.col("hits_10") / F.col("n_gold")).alias("recall_at_10"),
        zero(F.lit(1.0) / F.col("first_relevant_rank")).alias("reciprocal_rank"),
        zero(F.col("dcg") / F.col("ideal")).alias("ndcg_at_10"),
        "first_relevant_rank", "n_gold",
    )


def macro(per_query_rows: DataFrame, by: tuple[str, ...] = ("system",)) -> DataFrame:
    """Unweighted means over queries."""
    return per_query_rows.groupBy(*by).agg(*[F.avg(m).alias(m) for m in METRICS], F.count("*").alias("n_queries"))


def diagnostics(per_query_rows: DataFrame, metric: str = "ndcg_at_10") -> DataFrame:
    """Counts, and the queries with the best and worst value of a metric (ties by M12)."""
    of = Window.partitionBy("system")
    marked = per_query_rows.withColumn("best", F.max(metric).over(of)).withColumn("worst", F.min(metric).over(of))
    ids = lambda c: F.array_sort(F.collect_list(F.when(numbers.nearly(F.col(metric), F.col(c)), F.col("query_id"))))
    return marked.groupBy("system").agg(
        F.count_if(F.col("first_relevant_rank").isNotNull()).alias("queries_with_hit"),
        F.count_if(F.col("first_relevant_rank").isNull()).alias("queries_without_hit"),
        F.count_if(F.col("first_relevant_rank") == 1).alias("hits_at_1"),
        ids("best").alias("best_queries"), ids("worst").alias("worst_queries"),
    )


def wins(per_query_rows: DataFrame, left: str, right: str, metric: str = "ndcg_at_10") -> DataFrame:
    """A13, JN14: where one system beats another (M12 decides on ties)."""
    side = lambda s, c: per_query_rows.where(F.col("system") == s).select("query_id", F.col(metric).alias(c))
    both = side(left, "l").join(side(right, "r"), "query_id")
    outcome = F.when(numbers.nearly(F.col("l"), F.col("r")), "tie").when(F.col("l") > F.col("r"), "win").otherwise("loss")
    return both.groupBy(outcome.alias("outcome")).agg(F.count("*").alias("n"), F.array_sort(F.collect_list("query_id")).alias("query_ids"))


def completeness(per_query_rows: DataFrame, queries: DataFrame, systems: list[str]) -> DataFrame:
    """JN12: (query_id, system, problem) of missing, unexpected and repeated records."""
    spark = per_query_rows.sparkSession
    want = queries.select("query_id").distinct().crossJoin(spark.createDataFrame([(s,) for s in systems], "system string"))  # a few systems
    have = per_query_rows.groupBy("query_id", "system").agg(F.count("*").alias("n"))
    both = want.withColumn("wanted", F.lit(True)).join(have, ["query_id", "system"], "full_outer")
    problem = F.when(F.col("n").isNull(), "missing").when(F.col("wanted").isNull(), "unexpected").when(F.col("n") > 1, "repeated")
    return both.select("query_id", "system", problem.alias("problem")).where("problem is not null")


def ranking_errors(rankings: DataFrame, limit: int = 10) -> DataFrame:
    """Lists that are too long or hold an id twice."""
    sizes = rankings.groupBy("system", "query_id").agg(F.count("*").alias("n"), F.count_distinct("uid").alias("u"))
    problem = F.when(F.col("n") > limit, "too long").when(F.col("u") < F.col("n"), "repeated id")
    return sizes.select("system", "query_id", problem.alias("problem")).where("problem is not null")


def recompute_errors(stored: DataFrame, rankings: DataFrame, gold: DataFrame, tolerance: float = 1e-12) -> DataFrame:
    """Stored records whose metrics aren't those of their rankings, or out of range."""
    again = per_query(rankings, gold, stored.select("system").distinct()).select("system", "query_id", *[F.col(m).alias(f"r_{m}") for m in METRICS])
    both = stored.join(again, ["system", "query_id"], "left")
    bad = [F.when(F.coalesce(F.abs(F.col(m) - F.col(f"r_{m}")) > tolerance, F.lit(True)) | ~F.col(m).between(0, 1), F.lit(m)) for m in METRICS]
    wrong = F.filter(F.array(*bad), lambda x: x.isNotNull())
    return both.select("system", "query_id", wrong.alias("metrics")).where(F.size("metrics") > 0)


def read_artifacts(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """(per query, macro) of written artifacts; raises ValueError where they aren't whole."""
    shape = ", ".join(["system string, query_id string", *(f"{m} double" for m in METRICS), "first_relevant_rank long, n_gold long, _corrupt string"])
    rows = spark.read.schema(shape).option("columnNameOfCorruptRecord", "_corrupt").json(f"{folder}/per_query.jsonl")
    if rows.where("_corrupt is not null or system is null or query_id is null").limit(1).count():
        raise ValueError("per_query.jsonl holds a line that is no record")
    means = json.loads("".join(r["value"] for r in spark.read.text(f"{folder}/metrics.json", wholetext=True).collect()))  # a row a system
    if not isinstance(means, dict) or not all(isinstance(v, dict) and set(METRICS) <= set(v) for v in means.values()):
        raise ValueError("metrics.json isn't an object of systems with all metrics")
    kept = [(s, *(float(v[m]) for m in METRICS)) for s, v in means.items()]
    return rows.drop("_corrupt"), spark.createDataFrame(kept, ", ".join(["system string", *(f"{m} double" for m in METRICS)]))


def artifact_errors(per_query_rows: DataFrame, means: DataFrame, tolerance: float = 1e-12) -> DataFrame:
    """(system, problem) of stored means that aren't those of the stored records, or of values out of range."""
    again = macro(per_query_rows).select("system", *[F.col(m).alias(f"r_{m}") for m in METRICS])
    both = means.join(again, "system", "full_outer")
    off = [F.coalesce(F.abs(F.col(m) - F.col(f"r_{m}")) > tolerance, F.lit(True)) for m in METRICS]
    wrong = F.filter(F.array(*[F.when(o, F.lit(f"{m} differs")) for m, o in zip(METRICS, off, strict=True)]), lambda x: x.isNotNull())
    bad = per_query_rows.where(" or ".join(f"not coalesce({m} between 0 and 1, false)" for m in METRICS))
    return both.select("system", F.explode(wrong).alias("problem")).union(bad.select("system", F.lit("a record is out of range")).distinct())
