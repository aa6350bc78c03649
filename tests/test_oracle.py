"""Every query of the catalogue against its SQL, and the driver's contract."""

import oracle
import pytest

import __spark_entry__ as entry
from quillspark.plans import catalogue

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return oracle.connect(SF)


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_against_sql(spark, con, name):
    assert oracle.same_rows(catalogue.queries()[name](spark, SF), con, catalogue.SQL[name]) is None


def test_contract(spark):
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0


@pytest.fixture(scope="module")
def bare(spark, tmp_path_factory):
    """Documents of which many have a null, empty or blank text, of all kinds of records."""
    folder = tmp_path_factory.mktemp("bare")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    lacks = docs.selectExpr("doc_id", "CASE doc_id DIV 12 % 4 WHEN 0 THEN text WHEN 1 THEN NULL WHEN 2 THEN '' ELSE ' \\n ' END AS text", "lang", "source", "n_chars")
    lacks.coalesce(2).write.parquet(f"{folder}/documents.parquet")
    return str(folder)


@pytest.mark.parametrize("name", ["record_normalize", "ingest_counters", "ingest_failures"])
def test_documents_without_text(spark, bare, name):
    assert oracle.same_rows(catalogue.queries()[name](spark, bare), oracle.connect(bare), catalogue.SQL[name]) is None
