import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, failed string"


@pytest.fixture(scope="session")
def documents(spark):
    """The sf0.001 documents and their rows, oldest first."""
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = sorted(((r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()), key=lambda r: r[0])
    return df, rows


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in any column, empty and long texts, ties, repeated rows, a column more."""
    long = " ".join(f"w{i % 997}" for i in range(30_000))
    rows = [
        (1, "a b c d e f g h i j k l m n o p q r s", "en", "s", 1, "x"),
        (1, "a b c d e f g h i j k l m n o p q r s", "en", "s", 1, "x"),
        (2, None, None, None, None, None),
        (3, "", "en", "s", 0, "x"),
        (None, "a b c d e f g h i j k l m n o p q r s", "en", None, None, "x"),
        (None, None, None, None, None, None),
        (4, long, "en", "s", 2, "x"),
        (5, long + " tail", "en", "s", 2, "x"),
        (6, " \n\t\n  ", "en", "s", 2, "x"),
        (7, "one line\nsecond line\n\nthird line\n", "en", "s", 2, "x"),
        (8, "zero line\none line\n  second line\r\n\nthird line", "en", "s", 2, "x"),
        (9, "Released under the MIT License.", "en", "s", 2, "x"),
        (9, "Licensed under the apache license, version 2.0; ünïcode MIT LICENSE", "en", "s", 2, "x"),
    ]
    return spark.createDataFrame(rows, SCHEMA), rows


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
