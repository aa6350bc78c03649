"""Pipeline over documents: quality rules, line dedup, near-dedup, benchmark decontamination, packing.

Each stage is (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame, which is written as
Parquet and read again as the next stage's docs. All but the last return the columns of documents; further columns go.

Defined results, of all stages: null texts count as empty, so quality rules reject them; null ids are kept and come after all
others where ids are ordered. Repeated rows and rows with equal ids are judged each, until near dedup keeps one of each group of
equal or similar texts: that with the smallest id, of equal ids that with the smallest hash of its text. Very long texts go
through whole. Empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.deploy import shared_dir, ship, table
from quillspark.llm import decontaminate, lines, packing, quality, simhash_groups, tokens
from quillspark.llm.written import Written

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the current policy keeps."""
    ship(spark)
    judged = quality.ledger(quality.measure(docs, keep=COLUMNS))
    return judged.where(quality.passes()).select(*COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines of later repeated runs; documents that have lost every line go."""
    ship(spark)
    left = lines.dedup_lines(docs.select(*COLUMNS))
    kept = left.where((F.col("n_removed") == 0) | (F.col("text") != ""))
    return kept.select("doc_id", "text", "lang", "source", F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")).alias("n_chars"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents with 5-word Jaccard similarity of 0.8 or more the one with the smallest id."""
    ship(spark)
    return simhash_groups.group_heads(docs.select(*COLUMNS))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark passage."""
    ship(spark)
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark")).select(*COLUMNS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences, with their ids."""
    ship(spark)
    return packing.pack(docs, tokens.default_path(), end_id=1)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("near dedup", near_dedup),
    ("decontamination", decontamination),
    ("packing", pack_sequences),
]

#: The stages with tokenizers, XXH64 and a singular value decomposition are beyond SQL.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage."""
    ship(spark)
    shared_dir(spark)
    docs, last = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        kept = Written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        if last is not None:
            last.drop()
        docs, last = kept.df, kept
    return docs
