"""Acquisition and extraction checks (S2, S9, S10, F6-F8, F21, T16): validation, categories, resume."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspark import schemas
from quillspark.functions import text

# Required fields; hosts that count as official; an archive that may hold files.
REQUIRED = (
    "title", "case_number", "court", "judgment_date", "source_name", "source_page_url", "direct_pdf_url", "local_filename", "document_type",
)
OFFICIAL = ("gov.in", "nic.in")
ARCHIVES = ("indian-supreme-court-judgments.s3.amazonaws.com",)
DOCUMENT_TYPE = "judgment"
CATEGORIES = ("missing_metadata", "failed_urls", "invalid_pdfs", "scanned_pdfs", "duplicates", "downloaded")
MIN_CHARACTERS = 200


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """The 13 fields of each line; blank lines skipped, missing fields null."""
    return spark.read.schema(schemas.MANIFEST).json(path)


def _host(url: Column) -> Column:
    return F.lower(F.try_parse_url(url, F.lit("HOST")))


def official(url: Column, suffixes: tuple[str, ...] = OFFICIAL) -> Column:
    host = _host(url)
    fits = [(host == s) | F.endswith(host, F.lit("." + s)) for s in suffixes]
    any_ = fits[0]
    for f in fits[1:]:
        any_ = any_ | f
    return F.coalesce((F.try_parse_url(url, F.lit("PROTOCOL")) == "https") & any_, F.lit(False))


def trusted(url: Column, suffixes: tuple[str, ...] = OFFICIAL, archives: tuple[str, ...] = ARCHIVES) -> Column:
    archive = (F.try_parse_url(url, F.lit("PROTOCOL")) == "https") & _host(url).isin(*archives)
    return official(url, suffixes) | F.coalesce(archive, F.lit(False))


def source_error(suffixes: tuple[str, ...] = OFFICIAL, archives: tuple[str, ...] = ARCHIVES) -> Column:
    """the first rule that a manifest row breaks, else null."""
    blank = F.filter(F.array(*[F.when(F.trim(F.coalesce(F.col(c), F.lit(""))) == "", F.lit(c)) for c in REQUIRED]), lambda x: x.isNotNull())
    day = F.col("judgment_date").rlike(r"^\d{4}-\d{1,2}-\d{1,2}$") & F.try_to_date("judgment_date", "yyyy-M-d").isNotNull()
    name = F.col("local_filename")
    return (
        F.when(F.size(blank) > 0, F.concat(F.lit("missing: "), F.array_join(blank, ", ")))
        .when(~day, "judgment_date isn't an ISO date")
        .when(name.rlike("[/\\\\]") | ~F.lower(name).endswith(".pdf"), "local_filename isn't a plain .pdf name")
        .when(F.lower(F.trim("document_type")) != DOCUMENT_TYPE, "document_type is another")
        .when(~official(F.col("source_page_url"), suffixes), "source_page_url isn't official")
        .when(~trusted(F.col("direct_pdf_url"), suffixes, archives), "direct_pdf_url isn't trusted")
    )


def acquired_error() -> Column:
    """of a row that claims to be downloaded."""
    return (
        F.when(~F.coalesce(F.col("sha256").rlike("^[0-9a-fA-F]{64}$"), F.lit(False)), "sha256 isn't 64 hex digits")
        .when(~F.coalesce(F.col("file_size") > 0, F.lit(False)), "file_size isn't positive")
        .when(~F.coalesce(F.col("mime_type") == "application/pdf", F.lit(False)), "mime_type is another")
        .when(F.trim(F.coalesce("retrieval_timestamp", F.lit(""))) == "", "retrieval_timestamp is missing")
    )


def categorize(rows: DataFrame, min_characters: int = MIN_CHARACTERS, **hosts) -> DataFrame:
    """Adds category and n_characters. rows: the manifest with record_number, fetched, readable, content_sha256, raw_text.

    In this order: metadata, fetch, readable file, text layer, heading, repeated content, manifest hash. Of equal contents
    that got so far the first record is the original, even where its own manifest hash is wrong it doesn't count as one.
    """
    chars = F.length(F.regexp_replace(F.coalesce("raw_text", F.lit("")), r"(?U)\s+", ""))
    expected = F.lower(F.trim(F.coalesce("sha256", F.lit(""))))
    early = (
        F.when(source_error(**hosts).isNotNull(), "missing_metadata")
        .when(~F.coalesce("fetched", F.lit(False)), "failed_urls")
        .when(~F.coalesce("readable", F.lit(False)), "invalid_pdfs")
        .when(chars < min_characters, "scanned_pdfs")
        .when(~text.has_judgment_mark(F.col("raw_text")), "invalid_pdfs")
    )
    wrong = (expected != "") & (expected != F.col("content_sha256"))
    kept = rows.withColumn("early", early).withColumn("wrong", wrong).withColumn("n_characters", chars)
    good = F.col("early").isNull() & ~F.col("wrong")
    first = F.min(F.when(good, F.col("record_number"))).over(Window.partitionBy("content_sha256"))
    category = (
        F.when(F.col("early").isNotNull(), F.col("early"))
        .when(F.col("record_number") > F.col("first"), "duplicates")
        .when(F.col("wrong"), "invalid_pdfs")
        .otherwise("downloaded")
    )
    return kept.withColumn("first", first).withColumn("category", category).drop("early", "wrong", "first")


def canonical_records(manifest: DataFrame, raw_text: str = "raw_text") -> DataFrame:
    """what an extracted document brings to the ingest."""
    names = {"source": "source_name", "source_url": "direct_pdf_url", "raw_text": raw_text}
    fields = ("title", "case_number", "court", "judgment_date", "source", "source_url", "raw_text")
    return manifest.select(*[F.col(names.get(f, f)).cast("string").alias(f) for f in fields])


def failure_records(categorized: DataFrame, error: str = "error") -> DataFrame:
    """category, record_number, title, direct_pdf_url, error of what wasn't downloaded."""
    failed = categorized.where(F.col("category") != "downloaded")
    return failed.select("category", "record_number", "title", "direct_pdf_url", F.col(error).cast("string").alias("error"))


def audit_document(categorized: DataFrame) -> DataFrame:
    """a row for each category, also empty ones: count, judgments (downloaded ones of that type), and record_numbers in order."""
    every = categorized.sparkSession.createDataFrame([(c,) for c in CATEGORIES], "category string")
    judgment = (F.col("category") == "downloaded") & (F.lower(F.trim("document_type")) == DOCUMENT_TYPE)
    found = categorized.groupBy("category").agg(F.count("*").alias("n"), F.count_if(judgment).alias("judgments"))
    zero = F.lit(0).cast("long")
    return every.join(found, "category", "left").select("category", F.coalesce("n", zero).alias("n"), F.coalesce("judgments", zero).alias("judgments"))


RESUME_KEYS = ("title", "case_number", "court", "judgment_date", "source_name", "direct_pdf_url", "sha256")


def to_extract(manifest: DataFrame, done: DataFrame, keys: tuple[str, ...] = RESUME_KEYS) -> DataFrame:
    """Rows that aren't in `done` with the same values (nulls agree)."""
    cond = F.lit(True)
    for c in keys:
        cond = cond & manifest[c].eqNullSafe(done[c])
    return manifest.join(done, cond, "left_anti")


def extraction_totals(done: DataFrame) -> DataFrame:
    """A25."""
    return done.agg(F.count("*").alias("documents"), F.sum("page_count").alias("pages"), F.sum("text_characters").alias("characters"))


def read_pdfs(spark: SparkSession, path: str, extractor) -> DataFrame:
    """Path, content_sha256, file_size, readable, raw_text, page_count; `extractor(bytes) -> list of page texts` is a plugin."""
    import pandas as pd

    @F.pandas_udf("struct<readable: boolean, raw_text: string, page_count: int>")
    def pages(content: pd.Series) -> pd.DataFrame:
        rows = []
        for c in content:
            try:
                if not c.startswith(b"%PDF-"):
                    raise ValueError("no PDF signature")
                found = extractor(c)
                rows.append((True, "\f".join(found), len(found)))
            except Exception:  # a broken file is a category, not a failed job
                rows.append((False, None, None))
        return pd.DataFrame(rows, columns=["readable", "raw_text", "page_count"])

    files = spark.read.format("binaryFile").load(path)
    out = files.select("path", F.sha2("content", 256).alias("content_sha256"), F.col("length").alias("file_size"), pages("content").alias("p"))
    return out.select("path", "content_sha256", "file_size", "p.*")


