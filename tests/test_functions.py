import uuid
from datetime import date

import pytest
from pyspark.sql import functions as F

from quillspark.functions import identity, numbers, text
from quillspark.operators import paragraphs


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f(F.col("x")).alias("y")).first()["y"]


def test_normalize_text(spark):
    raw = "﻿ A  b \r\n\r\n\r\n\r\nc​d\x0b \fﬁ\t x\n\f"
    want = "A b\n\ncd\ffi x"
    assert text.clean_text(raw) == want
    assert one(spark, raw, text.normalize_text) == want
    stable = "  A  b \r\n \r\n\n\nc\td \f\n e\x00f\n \f"
    assert one(spark, stable, text.normalize_stable) == text.clean_text(stable) == "A b\n\nc d\fef"
    assert one(spark, None, text.normalize_text) is None


def test_tokens(spark):
    fold = lambda c: text.tokens(text.fold(c))
    assert one(spark, "Section ７—the “Judge’s” O'Neil's straße foo_bar ½", fold) == ["section", "7", "the", "judge’s", "o'neil's", "strasse", "foo", "bar", "1", "2"]
    assert one(spark, "ΣΑΣ Straße", lambda c: text.tokens(text.latin_fold(c))) == ["σασ", "strasse"]
    assert one(spark, " _ ", fold) == []


def test_uid(spark):
    row = spark.createDataFrame([("a" * 64, 12, "b" * 64), ("A" * 64, 12, "b" * 64), ("a" * 64, 0, "b" * 64), ("a" * 63, 1, "b" * 64), ("a" * 64, 1, None)], "d string, n int, t string")
    got = [r[0] for r in row.select(identity.paragraph_uid(F.col("d"), F.col("n"), F.col("t"), paragraphs.NAMESPACE)).collect()]
    assert got[0] == "57eb9eb2-206c-572e-bc7a-f8b57f606d4a" == str(uuid.uuid5(uuid.UUID(paragraphs.NAMESPACE), f"{'a' * 64}:12:{'b' * 64}"))
    assert got[1:] == [None] * 4


@pytest.mark.parametrize("raw", ["2024-05-10", "2024-05-10T01:02:03Z", "10-05-2024", "10/5/2024", "2024/05/10", "10.05.2024", "10 May 2024", "10 MAY 2024", "May 10, 2024"])
def test_dates(spark, raw):
    assert one(spark, f" {raw} ", numbers.parse_date) == date(2024, 5, 10)
    assert one(spark, raw, numbers.date_failed) is False


def test_bad_dates(spark):
    for raw in ("2024-13-10", "31-02-2024", "10 Foo 2024", "soon"):
        assert one(spark, raw, numbers.parse_date) is None
        assert one(spark, raw, numbers.date_failed) is True
    assert one(spark, " ", numbers.date_failed) is False


def test_citations(spark):
    assert one(spark, "a [E2] b [E1][E2] [E01] [e3]", text.cited_ids) == ["E2", "E1"]
    assert [one(spark, x, text.has_malformed_citation) for x in ("[E1]", "[E01]", "[e1]", "[Exhibit]", "[1]")] == [False, True, True, True, False]


def test_small_functions(spark):
    assert one(spark, "a  bc " * 3, lambda c: text.snippet(c, 6)) == "a bc…"
    assert one(spark, "Case-Number 1", text.key_name) == "casenumber1"
    assert one(spark, "x J U D G M E N T y", text.has_judgment_mark) is True
    assert one(spark, "misjudgments", text.has_judgment_mark) is False
    got = [one(spark, x, text.paragraph_marker) for x in ("1. a", "[7] b", "(12)", "13) c", "Para 4: d", "2.1 x", "2024.05.10")]
    assert [(r["number"], r["rest"]) if r else None for r in got] == [(1, "a"), (7, "b"), (12, ""), (13, "c"), (4, "d"), None, None]
    assert one(spark, "a<b>", lambda c: text.tag_safe_json(F.struct(c))) == '{"x":"a\\u003cb\\u003e"}'
