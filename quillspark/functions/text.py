
from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

TOKEN = r"[\p{L}\p{N}]+(?:['’][\p{L}\p{N}]+)*"
# Citations of evidence.
CITATION = r"\[(E[1-9][0-9]*)\]"
CITATION_LIKE = r"\[([Ee][^\[\]]*)\]"
EVIDENCE_ID = r"^E[1-9][0-9]*$"
# Fixed value: a heading whose letters may stand apart.
JUDGMENT_MARK = r"(?i)\bJ\s*U\s*D\s*G\s*(?:E\s*)?M\s*E\s*N\s*T\b"
# Fixed value: paragraph markers; a digit behind the dot or bracket makes a decimal or date.
MARKER = r"(?i)^\s*(?:\[([0-9]+)\]|\(([0-9]+)\)|([0-9]+)[.)](?![0-9])|para(?:graph)?\.?\s+([0-9]+)[:.)-]?)\s*(.*)$"

# Words by which a query names a statute, or a citation or case number.
STATUTE_TERMS = r"\b(?:section|article|rule|regulation|statute|act)\b"
CITATION_TERMS = r"\b(?:v\.?|versus|appeal no\.?|petition no\.?|application no\.?)\b"


def nfkc(text: str) -> str:
    return text if text.isascii() else unicodedata.normalize("NFKC", text)


def clean_text(text: str) -> str:
    """NFKC, line feeds, no control characters, single spaces, at most one blank line, form feeds between pages."""
    text = nfkc(text).replace("\r\n", "\n").replace("\r", "\n")
    text = "".join(c for c in text if c in "\n\f\t" or unicodedata.category(c)[0] != "C")
    pages = []
    for page in text.split("\f"):
        lines = (re.sub(r"[^\S\n\f]+", " ", line).strip() for line in page.split("\n"))
        pages.append(re.sub(r"\n{3,}", "\n\n", "\n".join(lines).strip()))
    return "\f".join(pages).strip(" \n\f")


@F.pandas_udf(StringType())
def normalize_text(texts: pd.Series) -> pd.Series:
    """T1 for all of Unicode; null stays null."""
    return texts.map(clean_text, na_action="ignore")


@F.pandas_udf(StringType())
def fold(texts: pd.Series) -> pd.Series:
    """NFKC and full case folding."""
    return texts.map(lambda x: nfkc(x).casefold(), na_action="ignore")


def latin_fold(text: Column) -> Column:
    """Case folding in the JVM; the same as `fold` for NFKC-stable texts in Latin and Greek letters."""
    return F.replace(F.replace(F.lower(text), F.lit("ß"), F.lit("ss")), F.lit("ς"), F.lit("σ"))


#: What T1 would change in an NFKC-stable text.
_UNCLEAN = r"(?U)[[\p{C}\s]&&[^\n ]]|  | \n|\n |\n\n\n|\A[ \n]|[ \n]\z"


def normalize_stable(text: Column) -> Column:
    """T1 in the JVM, for NFKC-stable texts. One pass tells whether there is anything to clean; most texts need no more."""
    unified = F.regexp_replace(F.regexp_replace(text, "\r\n?", "\n"), r"[\p{C}&&[^\n\f\t]]", "")
    page = lambda p: F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(p, r"(?U)[\s&&[^\n\f]]+", " "), " ?\n ?", "\n"), r"^[ \n]+|[ \n]+$", ""), r"\n{3,}", "\n\n")
    joined = F.array_join(F.transform(F.split(unified, "\f", -1), page), "\f")
    return F.when(text.rlike(_UNCLEAN), F.regexp_replace(joined, r"^[ \n\f]+|[ \n\f]+$", "")).otherwise(text)


def collapse(text: Column) -> Column:
    """Runs of white space become one space; none at the ends."""
    return F.trim(F.regexp_replace(text, r"(?U)[\s&&[^ ]]\s*| \s+", " "))  # single spaces stay untouched


def blank_to_null(text: Column) -> Column:
    """T7."""
    return F.nullif(collapse(text), F.lit(""))


def sha256_text(text: Column) -> Column:
    """T2."""
    return F.sha2(text.cast("binary"), 256)


def document_hash(normalized: Column) -> Column:
    """T3, of text that went through T1: insensitive to layout."""
    return sha256_text(collapse(normalized))


def tokens(folded: Column) -> Column:
    """T5, of folded text: runs of letters and digits, joined by inner apostrophes."""
    return F.regexp_extract_all(folded, F.lit(TOKEN), F.lit(0))


def metadata_value(folded: Column) -> Column:
    """T6, of folded text; blank is null."""
    return F.nullif(collapse(folded), F.lit(""))


def key_name(key: Column) -> Column:
    """T8."""
    return F.regexp_replace(latin_fold(key), "[^a-z0-9]+", "")


def snippet(text: Column, limit: int) -> Column:
    """T9."""
    flat = collapse(text)
    return F.when(F.length(flat) <= limit, flat).otherwise(F.concat(F.rtrim(F.left(flat, F.lit(limit - 1))), F.lit("…")))


def length_bucket(text: Column) -> Column:
    """T10."""
    n = F.length(text)
    return F.when(n < 20, "very_short_under_20").when(n < 200, "short_20_199").when(n < 1000, "medium_200_999").otherwise("long_1000_plus")


def tag_safe_json(value: Column) -> Column:
    """JSON without angle brackets."""
    return F.replace(F.replace(F.to_json(value), F.lit("<"), F.lit("\\u003c")), F.lit(">"), F.lit("\\u003e"))


def cited_ids(answer: Column) -> Column:
    """Distinct evidence ids in the order they appear."""
    return F.array_distinct(F.regexp_extract_all(answer, F.lit(CITATION), F.lit(1)))


def has_malformed_citation(answer: Column) -> Column:
    """T13."""
    return F.exists(F.regexp_extract_all(answer, F.lit(CITATION_LIKE), F.lit(1)), lambda x: ~x.rlike(EVIDENCE_ID))


def has_judgment_mark(text: Column) -> Column:
    """Within the first 50,000 characters."""
    return F.left(text, F.lit(50_000)).rlike(JUDGMENT_MARK)


def paragraph_marker(line: Column) -> Column:
    """(number, rest) of a line that begins with a marker, else null."""
    number = F.coalesce(*[F.nullif(F.regexp_extract(line, MARKER, k), F.lit("")) for k in range(1, 5)])
    return F.when(number.isNotNull(), F.struct(number.cast("long").alias("number"), F.trim(F.regexp_extract(line, MARKER, 5)).alias("rest")))


def query_features(query: Column, case_names: Column) -> Column:
    """Does a query name a statute, a citation, or two consecutive words of a case's name?"""
    folded = latin_fold(query)
    words = F.filter(F.transform(case_names, lambda n: tokens(latin_fold(n))), lambda w: F.size(w) > 1)
    pairs = F.flatten(F.transform(words, lambda w: F.transform(F.sequence(F.lit(0), F.size(w) - 2), lambda i: F.concat_ws(" ", F.get(w, i), F.get(w, i + 1)))))
    return F.struct(
        folded.rlike(STATUTE_TERMS).alias("names_statute"),
        folded.rlike(CITATION_TERMS).alias("names_citation"),
        F.coalesce(F.exists(pairs, lambda p: F.contains(folded, p)), F.lit(False)).alias("names_case"),
    )


def register(spark) -> None:
    """The functions for SQL: T1, folding, T5 and T6 of folded text; `paragraphs.register` adds the table function of U2."""
    spark.udf.register("normalize_text", normalize_text)
    spark.udf.register("fold_text", fold)
    quoted = TOKEN.replace("\\", "\\\\").replace("'", "\\'")
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION text_tokens(folded STRING) RETURNS ARRAY<STRING> RETURN regexp_extract_all(folded, '{quoted}', 0)")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION metadata_value(folded STRING) RETURNS STRING RETURN nullif(trim(regexp_replace(folded, '(?U)\\\\s+', ' ')), '')")
