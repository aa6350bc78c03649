"""Sources and sinks (S1-S4, S15, S16, S18, S20 of the engine): JSON lines with line numbers, processed files, reports."""

from __future__ import annotations

import json
import os
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Path, line_number (1-based within a file), value, and problem (not UTF-8) of each line.

    Line numbers need the whole file in order, so each file is split in one task; use many files for large inputs. A byte
    order mark at the start is dropped, line ends are left out.
    """
    return numbered(spark.read.format("binaryFile").load(path).select("path", "content"))


def numbered(files: DataFrame) -> DataFrame:
    """The lines of files (path, content); what follows the last line feed counts only if there is any."""
    whole = F.regexp_replace(F.decode("content", "ISO-8859-1"), r"\n\z", "")
    lines = files.where(F.octet_length("content") > 0).select("path", F.posexplode(F.split(whole, "\n", -1)).alias("k", "raw"))
    raw = F.encode(F.when(F.col("k") == 0, F.regexp_replace("raw", "^ï»¿", "")).otherwise(F.col("raw")), "ISO-8859-1")
    ok = F.is_valid_utf8(raw.cast("string"))
    value = F.rtrim(F.when(ok, raw.cast("string")).otherwise(F.col("raw")), F.lit("\r"))
    return lines.select("path", (F.col("k") + 1).cast("long").alias("line_number"), value.alias("value"), F.when(~ok, "not UTF-8").alias("problem"))


def file_hashes(spark: SparkSession, path: str) -> DataFrame:
    """path, sha256, size."""
    return spark.read.format("binaryFile").load(path).select("path", F.sha2("content", 256).alias("sha256"), F.col("length").alias("size"))


def read_processed(spark: SparkSession, path: str, ddl: str) -> tuple[DataFrame, DataFrame]:
    """Rows of a processed file, and source urls that stand in several rows."""
    rows = spark.read.schema(ddl).json(path)
    repeated = rows.where("source_url is not null").groupBy("source_url").count().where("count > 1")
    return rows, repeated


def write_report(text: str, path: str) -> None:
    """One small local file, whole or not at all."""
    folder = os.path.dirname(os.path.abspath(path))
    os.makedirs(folder, exist_ok=True)
    with tempfile.NamedTemporaryFile("w", dir=folder, delete=False, encoding="utf-8") as f:
        f.write(text)
        f.flush()
        os.fsync(f.fileno())
    os.replace(f.name, path)


def write_artifacts(per_query: DataFrame, macro: DataFrame, folder: str, order: tuple[str, ...]) -> None:
    """Records by query and then by system as listed, means as JSON, and a Markdown table."""
    place = F.lit(len(order))
    for k, s in reversed(list(enumerate(order))):
        place = F.when(F.col("system") == s, F.lit(k)).otherwise(place)
    ordered = per_query.withColumn("place", place).orderBy("query_id", "place").drop("place")
    records = [r.asDict(recursive=True) for r in ordered.collect()]  # a row a query and system
    means = {r["system"]: {k: v for k, v in r.asDict().items() if k != "system"} for r in macro.collect()}
    write_report("".join(json.dumps(r, default=str) + "\n" for r in records), f"{folder}/per_query.jsonl")
    write_report(json.dumps(means, indent=2, sort_keys=True, default=str) + "\n", f"{folder}/metrics.json")
    names = [c for c in macro.columns if c != "system"]
    table = [f"| system | {' | '.join(names)} |", "|" + "---|" * (len(names) + 1)]
    table += [f"| {s} | {' | '.join(f'{means[s][c]:.6f}' if isinstance(means[s][c], float) else str(means[s][c]) for c in names)} |" for s in order if s in means]
    write_report("# Retrieval evaluation\n\n" + "\n".join(table) + "\n", f"{folder}/report.md")
