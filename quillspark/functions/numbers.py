
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Accepted date forms beside ISO dates and times (pattern of the text, Spark format).
DATE_FORMS = (
    (r"^\d{1,2}-\d{1,2}-\d{4}$", "d-M-yyyy"),
    (r"^\d{1,2}/\d{1,2}/\d{4}$", "d/M/yyyy"),
    (r"^\d{4}/\d{1,2}/\d{1,2}$", "yyyy/M/d"),
    (r"^\d{1,2}\.\d{1,2}\.\d{4}$", "d.M.yyyy"),
    (r"^\d{1,2} [A-Za-z]{4,} \d{4}$", "d MMMM yyyy"),
    (r"^\d{1,2} [A-Za-z]{3} \d{4}$", "d MMM yyyy"),
    (r"^[A-Za-z]{4,} \d{1,2}, \d{4}$", "MMMM d, yyyy"),
    (r"^[A-Za-z]{3} \d{1,2}, \d{4}$", "MMM d, yyyy"),
)
ISO = r"^\d{4}-\d{2}-\d{2}(?:[T ]\d{2}:\d{2}(?::\d{2}(?:\.\d+)?)?(?:[+-]\d{2}:\d{2})?)?Z?$"


def parse_date(value: Column) -> Column:
    """M1; what fits no form is null (`date_failed` tells it from blank)."""
    v = F.trim(value)
    named = F.initcap(v)
    out = F.when(v.rlike(ISO), F.try_to_date(F.left(v, F.lit(10)), "yyyy-MM-dd"))
    for pattern, form in DATE_FORMS:
        out = out.when(v.rlike(pattern), F.try_to_date(named, form))
    return out


def date_failed(value: Column) -> Column:
    return (F.trim(F.coalesce(value, F.lit(""))) != "") & parse_date(value).isNull()


def iso(day: Column) -> Column:
    """M3."""
    return F.date_format(day, "yyyy-MM-dd")


def idf(n: Column, df: Column) -> Column:
    """M4."""
    return F.log(F.lit(1.0) + (n.cast("double") - df + F.lit(0.5)) / (df + F.lit(0.5)))


def bm25_term(qtf: Column, idf_: Column, tf: Column, length: Column, avgdl: Column, k1: float, b: float) -> Column:
    """M5."""
    tf = tf.cast("double")
    return qtf * idf_ * tf * F.lit(k1 + 1) / (tf + F.lit(k1) * (F.lit(1.0 - b) + F.lit(b) * length / avgdl))


def rrf_term(rank: Column, k: Column | int) -> Column:
    """M6."""
    return F.lit(1.0) / ((F.lit(k) if isinstance(k, int) else k) + rank)


def gain(grade: Column, rank: Column) -> Column:
    """M7."""
    return (F.pow(F.lit(2.0), grade) - 1) / F.log2(rank + F.lit(1.0))


def dot(a: Column, b: Column) -> Column:
    """M8 of unit vectors, accumulated in double."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def nearly(a: Column, b: Column, rel: float = 1e-9, abs_: float = 1e-15) -> Column:
    """M12."""
    return F.abs(a - b) <= F.greatest(F.lit(rel) * F.greatest(F.abs(a), F.abs(b)), F.lit(abs_))


def finite(x: Column) -> Column:
    """M13."""
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))


def percent(part: Column, whole: Column) -> Column:
    """Two digits; 0.0 of nothing."""
    return F.when(whole == 0, F.lit(0.0)).otherwise(F.round(part * 100.0 / whole, 2))
