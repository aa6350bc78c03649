"""Corpus audit (A18-A20, F11, F12, JN13, M9-M11, O2, O3, W13)."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions import numbers


def missing(column: str) -> Column:
    """F11."""
    return F.col(column).isNull() | (F.trim(F.col(column)) == "")


def corpus_audit(cases: DataFrame, paragraphs: DataFrame, very_short: int = 20) -> DataFrame:
    """A18 in one row: paragraphs a case (also none), missing metadata, empty and short texts, page coverage."""
    size = F.length(F.trim("text"))
    per_case = cases.select("case_id").join(paragraphs.groupBy("case_id").agg(F.count("*").alias("n")), "case_id", "left").select(F.coalesce("n", F.lit(0)).alias("n"))
    counts = per_case.agg(
        F.count("*").alias("cases"), F.min("n").alias("min_paragraphs"), F.median("n").alias("median_paragraphs"),
        F.expr("percentile_disc(0.95) WITHIN GROUP (ORDER BY n)").cast("long").alias("p95_paragraphs"), F.max("n").alias("max_paragraphs"),
    )
    holes = cases.agg(*[F.count_if(missing(c) if t == "string" else F.col(c).isNull()).alias(f"missing_{c}") for c, t in cases.dtypes if c in ("title", "case_number", "court", "judgment_date", "source_url")])
    texts = paragraphs.agg(
        F.count("*").alias("paragraphs"), F.count_if(size == 0).alias("empty"), F.count_if((size > 0) & (size < very_short)).alias("very_short"),
        F.count("page_number").alias("with_page"), F.count_if(F.col("page_number").isNull()).alias("without_page"),
        numbers.percent(F.count("page_number"), F.count("*")).alias("page_coverage"),
    )
    return counts.crossJoin(holes).crossJoin(texts)  # one row each


def duplicates(rows: DataFrame, key: str) -> DataFrame:
    """Groups of equal keys, and rows beyond the first of each."""
    groups = rows.groupBy(key).agg(F.count("*").alias("n"))
    return groups.agg(F.count_if(F.col("n") > 1).alias("groups"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("extra_rows"))


def vector_coverage(stored: DataFrame, indexed: DataFrame, key: str = "uid") -> DataFrame:
    """A20, JN13: missing, stale and repeated ids of an index, in one row."""
    s = stored.select(key).where(F.col(key).isNotNull()).distinct().withColumn("s", F.lit(1))
    i = indexed.groupBy(key).agg(F.count("*").alias("n"))
    both = s.join(i, key, "full_outer")
    common = F.count_if(F.col("s").isNotNull() & F.col("n").isNotNull())
    return both.agg(
        F.count("s").alias("stored"), F.coalesce(F.sum("n"), F.lit(0)).alias("indexed"), common.alias("common"),
        F.count_if(F.col("n").isNull()).alias("missing"), F.count_if(F.col("s").isNull()).alias("stale"),
        F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("repeated"), numbers.percent(common, F.count("s")).alias("coverage"),
    )


def coverage_samples(stored: DataFrame, indexed: DataFrame, key: str = "uid", n: int = 20) -> DataFrame:
    """The first ids that are missing or stale."""
    lack = stored.select(key).join(indexed.select(key), key, "left_anti").distinct().orderBy(key).limit(n).withColumn("problem", F.lit("missing"))
    stale = indexed.select(key).join(stored.select(key), key, "left_anti").distinct().orderBy(key).limit(n).withColumn("problem", F.lit("stale"))
    return lack.union(stale)


def merged_counts(spark: SparkSession, audits: dict[str, str]) -> DataFrame:
    """label, counter, n of earlier audit documents (label: JSON text); counters are integers of 0 or more."""
    rows = []
    for label, document in audits.items():
        counts = json.loads(document).get("counts")
        if not isinstance(counts, dict) or any(type(n) is not int or n < 0 for n in counts.values()):
            raise ValueError(f"{label}: counts are missing, or not all of them are integers of 0 or more")
        rows += [(label, name, n) for name, n in counts.items()]
    return spark.createDataFrame(rows, "label string, counter string, n long")


def defects(coverage: DataFrame) -> int:
    """Missing, stale and repeated ids of a coverage row: the command ends with 1 if there are any."""
    row = coverage.select((F.col("missing") + F.col("stale") + F.col("repeated")).alias("n")).first()
    return row["n"]
