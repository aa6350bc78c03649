"""Paragraphs of documents (U1, U2, T18, F14, W10): pages, markers, numbers, ids.

Numbering without markers is sequential through a document, so a document is one call of an Arrow function; the rest is
columns. Memory: one document.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

from quillspark.functions import text
from quillspark.functions.identity import paragraph_uid

# Fixed value: the namespace of paragraph ids, part of their identity.
NAMESPACE = "e61a47e8-5f0b-5df5-a8d6-84cb84760e42"
_MARKER = re.compile(text.MARKER)
_MAX = 2**31 - 1
_PARAGRAPHS = ArrayType(StructType().add("paragraph_number", "integer").add("page_number", "integer").add("text", "string"))


def split_paragraphs(raw: str | None) -> list[dict] | None:
    """(number, page, text) of each paragraph in order; null if a paragraph with text has number 0 or one that no integer holds."""
    clean = text.clean_text(raw or "")
    if not clean:
        return []
    pages = clean.split("\f")
    marked = [[(m, line) for line in page.split("\n") for m in [_MARKER.match(line)]] for page in pages]
    number = lambda m: int(next(g for g in m.groups()[:4] if g))
    taken = {number(m) for page in marked for m, _ in page if m}
    free = (n for n in range(1, _MAX) if n not in taken)
    out: list[dict] = []
    for at, page in enumerate(marked, 1):
        # A paragraph is a marker's number, or none, and the lines up to the next marker or blank line.
        runs: list[tuple[int | None, list[str]]] = [(None, [])]
        for m, line in page:
            if m:
                runs.append((number(m), [m[5]]))
            elif line:
                runs[-1][1].append(line)
            else:
                runs.append((None, []))
        for n, lines in runs:
            body = text.clean_text(" ".join(x for x in lines if x))
            if body and n is not None and not 0 < n <= _MAX:
                return None
            if body:
                out.append({"paragraph_number": next(free) if n is None else n, "page_number": at if len(pages) > 1 else None, "text": body})
    return out


@F.pandas_udf(_PARAGRAPHS)
def paragraphs_of(raw: pd.Series) -> pd.Series:
    return raw.map(split_paragraphs)


def extract_paragraphs(docs: DataFrame, text_column: str = "raw_text", keep: tuple[str, ...] = ("document_hash",)) -> DataFrame:
    """The columns of `keep`, seq (order in the document), paragraph_number, page_number, text, text_hash."""
    split = docs.select(*keep, F.posexplode(paragraphs_of(F.col(text_column))).alias("seq", "p"))
    return split.select(*keep, "seq", "p.*").withColumn("text_hash", text.document_hash(F.col("text")))


def deduplicate(paragraphs: DataFrame, by: str = "document_hash") -> DataFrame:
    """Of equal paragraphs of a document the first. Only ids and hashes are ranked."""
    first = F.row_number().over(Window.partitionBy(by, "text_hash").orderBy("seq"))
    return paragraphs.withColumn("n", first).where("n = 1").drop("n")


def with_uids(paragraphs: DataFrame, namespace: str = NAMESPACE) -> DataFrame:
    """T4."""
    return paragraphs.withColumn("paragraph_uid", paragraph_uid(F.col("document_hash"), F.col("paragraph_number"), F.col("text_hash"), namespace))


@F.udtf(returnType="paragraph_number int, page_number int, text string")
class Paragraphs:
    """U2 as a table function: the paragraphs of a text; none if it has a bad number."""

    def eval(self, raw: str):
        for p in split_paragraphs(raw) or ():
            yield p["paragraph_number"], p["page_number"], p["text"]


def register(spark) -> None:
    """extract_paragraphs(text) for SQL."""
    spark.udtf.register("extract_paragraphs", Paragraphs)
