"""Queries of this subpackage against their SQL; names and columns of the contracts."""

import oracle
import pytest

from quillspark.llm import queries

SF = "/root/testdata/sf0.001"
COLUMNS = {
    1: "doc_id start length ids_crc32 doc_tokens sequence_id offset",
    2: "doc_id n_words n_base first_word last_word base_labels labels score",
    3: "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept",
    4: "doc_id fingerprint component_id",
    7: "page_id payload_bytes payload_digest record_type refers_to",
    8: "page_id host path rule verdict",
    9: "doc_id n_words n_removed kept_sha256",
    10: "doc_id start n_tokens ids_crc32",
}


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_against_sql(spark, name):
    assert oracle.same_rows(queries.queries()[name](spark, SF), oracle.connect(SF), queries.oracle_sql()[name]) is None


@pytest.mark.parametrize("n", sorted(COLUMNS))
def test_columns(spark, n):
    name = next(q for q in queries.queries() if q.startswith(f"op{n}_"))
    df = queries.queries()[name](spark, SF)
    want = COLUMNS[n].split()
    assert df.columns[: len(want)] == want
    kinds = dict(df.dtypes)
    assert all(kinds[c] == "bigint" for c in want if c.startswith(("n_", "doc_", "page_", "start", "length", "ids_", "offset", "sequence", "payload_bytes", "refers", "component", "first_", "last_", "word_")))
