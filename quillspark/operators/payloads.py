"""Payloads of vector points (F9, F16): written from paragraphs and cases, read back with their types checked."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.functions import numbers
from quillspark.operators.filters import with_filter_columns


def payloads(paragraphs: DataFrame, cases: DataFrame, stable: bool = False) -> DataFrame:
    """F9, JN1: the 13 keys of each paragraph's point. paragraphs: paragraph_uid, case_id, paragraph_number, page_number, text;
    cases: id and the canonical fields."""
    facts = with_filter_columns(cases.select(F.col("id").alias("case_id"), "title", "case_number", "court", "judgment_date", "source_url"), stable)
    return paragraphs.join(facts, "case_id").select(
        "case_id", "paragraph_uid", "title", "case_number", "case_number_filter", "court", "court_filter",
        numbers.iso(F.col("judgment_date")).alias("judgment_date"), "source_url", "year", "paragraph_number", "page_number", "text",
    )


def decoded(hits: DataFrame) -> DataFrame:
    """F16: hits (query_id, point_id, score, rank and a payload of strings) as results; error names the first rule that a payload
    breaks, null if none. Blank strings are null; later repeats of a point in a list are dropped (W2)."""
    p = lambda key: F.col("payload")[key]
    uid = F.coalesce(F.nullif(p("paragraph_uid"), F.lit("")), "point_id")
    number = lambda key: p(key).try_cast("long")
    blank = lambda key: F.nullif(F.trim(p(key)), F.lit(""))
    day = F.try_to_date(F.nullif(p("judgment_date"), F.lit("")), "yyyy-MM-dd")
    error = (
        F.when(F.col("point_id") != uid, "point and paragraph differ")
        .when(number("case_id").isNull() | number("paragraph_number").isNull(), "case_id or paragraph_number isn't an integer")
        .when(p("page_number").isNotNull() & number("page_number").isNull(), "page_number isn't an integer")
        .when((F.coalesce(p("judgment_date"), F.lit("")) != "") & day.isNull(), "judgment_date isn't an ISO date")
    )
    first = hits.withColumn("uid", uid).groupBy("query_id", "uid").agg(F.min("rank").alias("rank"))
    rows = hits.withColumn("uid", uid).join(first, ["query_id", "uid", "rank"], "left_semi")
    return rows.select(
        "query_id", "uid", F.coalesce(p("text"), F.lit("")).alias("text"), number("case_id").alias("case_id"),
        F.coalesce(p("title"), F.lit("")).alias("title"), blank("case_number").alias("case_number"), blank("court").alias("court"),
        day.alias("judgment_date"), blank("source_url").alias("source_url"), number("paragraph_number").alias("paragraph_number"),
        number("page_number").alias("page_number"), "score", "rank", error.alias("error"),
    )
