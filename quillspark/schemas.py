"""Schemas of the engine's tables, and checks against them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def _schema(ddl: str) -> StructType:
    return StructType.fromDDL(ddl)


CASE = "id LONG, title STRING, case_number STRING, court STRING, judgment_date DATE, source STRING, source_url STRING, raw_text STRING, document_hash STRING"
PARAGRAPH = "paragraph_uid STRING, case_id LONG, paragraph_number INT, page_number INT, text STRING, text_hash STRING"
STATUTE = "id LONG, act_name STRING, section STRING, title STRING, text STRING"
MANIFEST = (
    "title STRING, case_number STRING, court STRING, judgment_date STRING, source_name STRING, source_page_url STRING, direct_pdf_url STRING, "
    "local_filename STRING, document_type STRING, retrieval_timestamp STRING, sha256 STRING, file_size LONG, mime_type STRING"
)
LABEL = "STRUCT<paragraph_uid: STRING, relevance: INT, case_name: STRING, case_number: STRING, paragraph_number: INT, page_number: INT, reason: STRING>"
GOLD = f"query_id STRING, query STRING, query_type STRING, difficulty STRING, notes STRING, relevant_paragraphs ARRAY<{LABEL}>"

#: Columns of a ranked result; what a mode doesn't produce is null.
RESULT = (
    "query_id", "uid", "bm25_rank", "bm25_score", "dense_rank", "dense_score", "rrf_score", "hybrid_rank", "cross_encoder_score", "final_rank",
)


def check_schema(df: DataFrame, ddl: str, not_null: tuple[str, ...] = (), unique: tuple[tuple[str, ...], ...] = ()) -> list[str]:
    """what differs from the expected columns and types, and violated null and uniqueness rules."""
    want, have = {f.name: f.dataType.simpleString() for f in _schema(ddl)}, dict(df.dtypes)
    out = [f"missing column {c}" for c in want if c not in have] + [f"unknown column {c}" for c in have if c not in want]
    out += [f"column {c} is {have[c]}, not {t}" for c, t in want.items() if c in have and have[c] != t]
    for c in not_null:
        if c in have and df.where(F.col(c).isNull()).limit(1).count():
            out.append(f"column {c} has nulls")
    for key in unique:
        if all(c in have for c in key) and df.groupBy(*key).count().where("count > 1").limit(1).count():
            out.append(f"{', '.join(key)} is not unique")
    return out


def orphans(child: DataFrame, key: str, parent: DataFrame, parent_key: str) -> DataFrame:
    """Rows whose foreign key has no parent."""
    return child.where(F.col(key).isNotNull()).join(parent.select(F.col(parent_key).alias(key)).distinct(), key, "left_anti")
