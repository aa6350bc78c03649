"""Durable ids (T4): a name-based UUID, version 5, in a fixed namespace, by built-in functions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

HASH = r"^[0-9a-f]{64}$"


def uuid5(namespace_hex: str, name: Column) -> Column:
    """The UUID of a name, as text."""
    digest = F.sha1(F.concat(F.unhex(F.lit(re.sub("[^0-9a-f]", "", namespace_hex))), F.encode(name, "UTF-8")))
    part = lambda at, n: F.substring(digest, at, n)
    variant = F.translate(part(17, 1), "0123456789abcdef", "89ab89ab89ab89ab")
    return F.concat_ws("-", part(1, 8), part(9, 4), F.concat(F.lit("5"), part(14, 3)), F.concat(variant, part(18, 3)), part(21, 12))


def paragraph_uid(document_hash: Column, number: Column, text_hash: Column, namespace_hex: str) -> Column:
    """The id of a paragraph; null where a hash or the number isn't valid."""
    valid = document_hash.rlike(HASH) & text_hash.rlike(HASH) & (number > 0)
    return F.when(valid, uuid5(namespace_hex, F.concat_ws(":", document_hash, number.cast("string"), text_hash)))
