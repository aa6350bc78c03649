"""Connected components of links, by alternating large-star and small-star steps.

Every step is a join and an aggregate over the edges, written as a table to the shared folder, so a lost executor costs
one step. Nothing but the number of edges and a checksum comes to the driver. A node's neighbours are never gathered:
minima are aggregated before they are shuffled, and what joins them is an equi-join that Spark may split when a hub is hot.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.written import Written


def _both(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))).alias("e")).select("e.*")


def _least(edges: DataFrame) -> DataFrame:
    """Of each node u the least of its neighbours and itself."""
    return edges.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))


def _large_star(both: DataFrame, least: DataFrame) -> DataFrame:
    """Larger neighbours of each node point to the least of its neighbourhood."""
    return both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()


def _small_star(edges: DataFrame, least: DataFrame) -> DataFrame:
    """edges with u > v: smaller neighbours and the node itself point to the least."""
    moved = edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).where("u != v").distinct()


def components(links: DataFrame, left: str = "u", right: str = "v") -> DataFrame:
    """node, component (the least node reachable), for each node that has a link. Nulls in links are left out."""
    ends = links.select(F.col(left).alias("a"), F.col(right).alias("b")).where("a is not null and b is not null and a != b")
    kept = Written(ends.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    before = None
    while True:
        # Minima are written, so that no aggregate stands between an exchange and a join: Spark can then split a hub.
        both = _both(kept.df)
        first = Written(_least(both), "least")
        large = Written(_large_star(both, first.df), "edges")
        second = Written(_least(large.df), "least")
        small = Written(_small_star(large.df, second.df), "edges")
        for done in (kept, first, large, second):
            done.drop()
        kept = small
        now = tuple(kept.df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == before or not now[0]:
            break
        before = now
    edges = kept.df
    nodes = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return nodes.union(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
