"""Ingestion (S1, S11, S16, S17, W11, JN15, A24): lines to cases and paragraphs, each line with one outcome."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspark.operators import paragraphs as P
from quillspark.operators.records import normalize_records


def prepared(lines: DataFrame, default_source: str | None = None, stable: bool = False, textless: Column | None = None) -> DataFrame:
    """Normalised records whose paragraphs can be stored: a record with a paragraph of a bad number fails as a whole. Lines that
    their source calls a problem fail with it. textless: lines that may lack text (`normalize_records`)."""
    rows = normalize_records(lines, default_source=default_source, stable=stable, textless=textless)
    if "problem" in lines.columns:
        rows = rows.withColumn("reason", F.coalesce("problem", "reason"))
    bad = F.col("reason").isNull() & P.paragraphs_of(F.when(F.col("reason").isNull(), F.col("raw_text"))).isNull()
    return rows.withColumn("reason", F.when(bad, "bad paragraph number").otherwise(F.col("reason")))


def outcomes(good_and_bad: DataFrame, stored: DataFrame | None = None, order: tuple[str, ...] = ("line_number",)) -> DataFrame:
    """Adds outcome: failed, duplicate (its hash is stored, or stands at an earlier line) or inserted."""
    # Failed lines have no hash that counts: each is a group of its own, so they don't meet in one task.
    own = F.concat(F.lit("line "), F.concat_ws(" ", *[F.col(c).cast("string") for c in order]))
    group = F.when(F.col("reason").isNull(), F.col("document_hash")).otherwise(own)
    first = F.row_number().over(Window.partitionBy(group).orderBy(*order))
    ranked = good_and_bad.withColumn("nth", first)
    known = F.lit(False)
    if stored is not None:
        marks = stored.select("document_hash").distinct().withColumn("known", F.lit(True))
        ranked = ranked.join(marks, "document_hash", "left")
        known = F.coalesce(F.col("known"), F.lit(False))
    outcome = F.when(F.col("reason").isNotNull(), "failed").when(known | (F.col("nth") > 1), "duplicate").otherwise("inserted")
    return ranked.withColumn("outcome", outcome).drop("nth", "known")


def counters(outcome: DataFrame) -> DataFrame:
    """Inserted, duplicates, failed in one row."""
    n = lambda kind: F.count_if(F.col("outcome") == kind)
    return outcome.agg(n("inserted").alias("inserted"), n("duplicate").alias("duplicates"), n("failed").alias("failed"))


def failures(outcome: DataFrame, raw: str = "value") -> DataFrame:
    """Quarantine: line number, reason and the record, or the raw line where it is no JSON."""
    parsed = F.col("reason").isin("not JSON", "blank line", "not UTF-8")
    return outcome.where(F.col("outcome") == "failed").select(
        "line_number", "reason", F.when(~parsed, F.col(raw)).alias("record"), F.when(parsed, F.rtrim(F.col(raw), F.lit("\r\n"))).alias("raw_line")
    )


def ingest(spark: SparkSession, lines: DataFrame, store: str, default_source: str | None = None) -> DataFrame:
    """Appends new cases and their paragraphs below `store`; returns the outcomes.

    Cases are written last: a run that dies between the two leaves paragraphs without a case, which the next run writes
    again and readers, who join with cases, take once (`read_store` drops repeated ids).
    """
    stored = read_cases(spark, store)
    order = ("path", "line_number") if "path" in lines.columns else ("line_number",)
    out = outcomes(prepared(lines, default_source), stored, order).persist()
    new = out.where(F.col("outcome") == "inserted")
    fields = ["title", "case_number", "court", "judgment_date", "source", "source_url", "raw_text", "document_hash"]
    found = P.with_uids(P.deduplicate(P.extract_paragraphs(new)))
    found.write.mode("append").parquet(f"{store}/paragraphs")
    new.select(*fields).write.mode("append").parquet(f"{store}/cases")
    failures(out).write.mode("append").parquet(f"{store}/failures")
    return out


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def read_cases(spark: SparkSession, store: str) -> DataFrame | None:
    return spark.read.parquet(f"{store}/cases") if _exists(spark, f"{store}/cases") else None


def read_store(spark: SparkSession, store: str) -> tuple[DataFrame, DataFrame]:
    """Cases, and paragraphs of stored cases, each id once (S5, JN1)."""
    cases = spark.read.parquet(f"{store}/cases")
    paragraphs = spark.read.parquet(f"{store}/paragraphs").join(cases.select("document_hash"), "document_hash", "left_semi")
    return cases, paragraphs.dropDuplicates(["paragraph_uid"])


def backfill_uids(paragraphs: DataFrame, cases: DataFrame) -> DataFrame:
    """Ids for paragraphs without one; refuses rows whose id can't be made or isn't unique."""
    out = P.with_uids(paragraphs.join(cases.select(F.col("id").alias("case_id"), "document_hash"), "case_id"))
    n = out.agg(F.count("*").alias("n"), F.count("paragraph_uid").alias("valid"), F.count_distinct("paragraph_uid").alias("uids")).first()
    if n["n"] != paragraphs.count() or not n["n"] == n["valid"] == n["uids"]:
        raise ValueError("paragraph ids can't be made for all rows, or aren't unique")
    return out


def check_resume(progress: DataFrame, path: str, sha256: str, store: str) -> int:
    """The last line done of an input; refuses an input or a store that has changed."""
    row = progress.where(F.col("path") == path).orderBy(F.desc("line_number")).first()
    if row is None:
        return 0
    if row["sha256"] != sha256 or row["store"] != store:
        raise ValueError("the input or the store isn't that of the checkpoint")
    return row["line_number"]
