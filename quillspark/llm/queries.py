"""Queries opN_<name>: each applies an operator of this subpackage to its whole table. SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.deploy import fresh_path, shared_dir, ship, table
from quillspark.llm import decontaminate, licenses, lines, packing, quality, simhash, substrings, token_files, tokens, url_filter, warc


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack(table(spark, sf_dir, "documents"), tokens.default_path(), end_id=1)
    return packed.select(
        "doc_id", "start", "length", F.crc32("piece_ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.labelled(licenses.scan_licenses(table(spark, sf_dir, "documents")))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.attributed(quality.apply_policy(quality.ledger(quality.measure(table(spark, sf_dir, "documents")))))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        (~quality.passes("base")).alias("base_failed"), "kept", "failed_bits", "n_lines", "n_caps_words", "n_shouts", "kept_by", "sole_rule",
    )


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contaminations(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "cosine", "lcs", "answer")


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = lines.dedup_lines(table(spark, sf_dir, "documents"))
    return left.select("doc_id", "n_lines", "n_removed", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "warc")
    files = [m["file"] for m in warc.write_warc(table(spark, sf_dir, "pages"), path)]
    captures = warc.transactions(warc.read_warc(spark, path, files)).where("response.record_type is not null")
    return captures.select(*[f"response.{c}" for c in ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")])


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = url_filter.judge_urls(table(spark, sf_dir, "pages"))
    return judged.select("page_id", "host", "path", "rule", "verdict")


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = substrings.dedup_substrings(table(spark, sf_dir, "documents"))
    return left.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "tokens")
    manifest = token_files.write_token_files(table(spark, sf_dir, "documents"), path, tokens.default_path(), end_id=0)
    read = token_files.read_token_files(spark, path, manifest)
    return read.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


_QUERIES = {
    "op1_packing": op1_packing,
    "op2_license_scan": op2_license_scan,
    "op3_quality_rules": op3_quality_rules,
    "op4_simhash": op4_simhash,
    "op5_decontaminate": op5_decontaminate,
    "op6_line_dedup": op6_line_dedup,
    "op7_warc": op7_warc,
    "op8_url_filter": op8_url_filter,
    "op9_substring_dedup": op9_substring_dedup,
    "op10_token_files": op10_token_files,
}


def _shipped(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        shared_dir(spark)
        return query(spark, sf_dir)

    return run


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: _shipped(q) for name, q in _QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    from quillspark.llm.oracles import SQL

    return dict(SQL)
