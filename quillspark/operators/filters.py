"""Metadata filters (D10, F2, F3, F15): exact normalised equality, all of them, before ranking."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions import text


def _value(x: str | None, what: str) -> str | None:
    if x is None:
        return None
    if not isinstance(x, str):
        raise TypeError(f"{what} is text")
    out = " ".join(text.nfkc(x).casefold().split())
    if not out:
        raise ValueError(f"{what} is blank")
    return out


@dataclass(frozen=True)
class Filters:
    court: str | None = None
    year: int | None = None
    case_number: str | None = None

    def __post_init__(self) -> None:
        object.__setattr__(self, "court", _value(self.court, "court"))
        object.__setattr__(self, "case_number", _value(self.case_number, "case_number"))
        if self.year is not None and (isinstance(self.year, bool) or not isinstance(self.year, int)):
            raise TypeError("year is an integer")
        if self.year is not None and not 1 <= self.year <= 9999:
            raise ValueError("year is 1 to 9999")

    def predicate(self) -> Column:
        """Over the helper columns of `with_filter_columns`; null metadata never matches."""
        wanted = {"court_filter": self.court, "year": self.year, "case_number_filter": self.case_number}
        out = F.lit(True)
        for column, value in wanted.items():
            if value is not None:
                out = out & (F.col(column) == F.lit(value))
        return out


def with_filter_columns(docs: DataFrame, stable: bool = False) -> DataFrame:
    """Adds court_filter, case_number_filter, year (M2, T6). Stored with the documents they are pushed into the scan."""
    folded = (lambda c: text.latin_fold(F.col(c))) if stable else (lambda c: text.fold(F.col(c)))
    return (
        docs.withColumn("court_filter", text.metadata_value(folded("court")))
        .withColumn("case_number_filter", text.metadata_value(folded("case_number")))
        .withColumn("year", F.year("judgment_date"))
    )


def check_request(query: str, top_k: int, filters: Filters | None = None) -> None:
    """F5."""
    import re

    if not isinstance(query, str) or not re.search(r"[^\W_]", text.nfkc(query)):
        raise ValueError("a query has at least one letter or digit")
    if isinstance(top_k, bool) or not isinstance(top_k, int) or not 1 <= top_k <= 50:
        raise ValueError("top_k is 1 to 50")
