import json

import pytest
from pyspark.sql import functions as F

from quillspark import schemas
from quillspark.operators import acquisition, bm25, claims, dense, evidence, filters, fusion, ingest, paragraphs, records, rerank
from quillspark.plans import audit, engine, evaluation, gold, tuning
from quillspark.sources import lines
from quillspark.streaming import ingest as stream


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


# ---------------------------------------------------------------- corpus

def test_paragraphs():
    got = paragraphs.split_paragraphs("1. one\nwrapped\n[7] seven\n\f(12) twelve\n\n13) thirteen\n2.1 more")
    assert [(p["paragraph_number"], p["page_number"], p["text"]) for p in got] == [(1, 1, "one wrapped"), (7, 1, "seven"), (12, 2, "twelve"), (13, 2, "thirteen 2.1 more")]
    got = paragraphs.split_paragraphs("a\nb\n\nc\n\n1. d\n\n3.\n\ne")
    assert [(p["paragraph_number"], p["page_number"], p["text"]) for p in got] == [(2, None, "a b"), (4, None, "c"), (1, None, "d"), (5, None, "e")]
    assert paragraphs.split_paragraphs("0. x") is None and paragraphs.split_paragraphs("20240510123. x") is None
    assert paragraphs.split_paragraphs(None) == paragraphs.split_paragraphs(" \f ") == []


def test_paragraph_table(spark):
    docs = spark.createDataFrame([("d1", "1. Same text\n\n2. same  text\n\n3. Same   text"), ("d2", "1. Same text"), ("d3", "0. bad")], "document_hash string, raw_text string")
    assert rows(paragraphs.deduplicate(paragraphs.extract_paragraphs(docs)), "document_hash", "paragraph_number") == [("d1", 1), ("d1", 2), ("d2", 1)]


def test_records():
    nested = {"Case-Name": " A  v. B ", "metadata": {"courtName": "High  Court", "date": "10-05-2024"}, "content": [{"text": "p1"}, "", "p2"]}
    assert records.resolve(json.dumps(nested)) == (None, "A v. B", None, "High Court", "10-05-2024", None, None, "p1\n\np2")
    assert records.resolve('{"court": ["x"], "court_name": "y", "text": "t", "title": " ", "case_title": "z"}')[1:4] == ("z", None, None)
    assert [records.resolve(x)[0] for x in ("", "{", "[1]", '{"text": {"body": " "}}')] == ["blank line", "not JSON", "not an object", "no text"]


def test_records_without_text(spark):
    df = spark.createDataFrame([(k, json.dumps({"title": "A"} | t)) for k, t in enumerate([{}, {"text": " "}, {"body": "b"}, {"text": "\u200b"}])] + [(4, "{"), (5, None)], "k long, value string")
    seen = lambda **o: [r[1:] for r in rows(records.normalize_records(df, **o), "k", "reason", "raw_text")]
    rest = [("not JSON", None), ("blank line", None)]
    assert seen() == [("no text", None), ("no text", None), (None, "b"), ("empty text", ""), *rest]
    assert seen(textless=F.col("k") != 1) == [(None, ""), ("no text", None), (None, "b"), (None, ""), *rest]


LINES = [
    json.dumps({"title": "A", "text": "1. First  paragraph.\n\n2. Second."}),
    json.dumps({"title": "B", "raw_text": "1. First paragraph.\n\n2.  Second."}),
    '{"broken": ',
    json.dumps({"title": "C"}),
    json.dumps({"case_title": "D", "judgment-text": "Only one.", "decided_on": "1 May 2020"}),
]


def test_ingest(spark, tmp_path):
    src, store = tmp_path / "in", f"file://{tmp_path}/store"
    src.mkdir()
    (src / "a.jsonl").write_bytes(b"\xef\xbb\xbf" + "\r\n".join(LINES).encode() + b"\n\xff\n")
    read = lines.read_lines(spark, str(src))
    assert rows(read.where("problem is not null"), "line_number") == [(6,)] and read.count() == 6
    good = read.where("problem is null")
    out = ingest.ingest(spark, good, store)
    assert tuple(ingest.counters(out).first()) == (2, 1, 2)
    assert rows(ingest.failures(out), "line_number", "reason") == [(3, "not JSON"), (4, "no text")]
    cases, found = ingest.read_store(spark, store)
    assert cases.count() == 2 and found.count() == 3
    assert tuple(ingest.counters(ingest.ingest(spark, good, store)).first()) == (0, 3, 2)


def test_stream(spark, tmp_path):
    src, store, mark = tmp_path / "in", f"file://{tmp_path}/store", f"file://{tmp_path}/mark"
    src.mkdir()
    (src / "a.jsonl").write_text("\n".join(LINES[:2]) + "\n")
    stream.ingest_folder(spark, str(src), store, mark)
    (src / "b.jsonl").write_text("\n".join(LINES) + "\n")
    stream.ingest_folder(spark, str(src), store, mark)
    assert ingest.read_cases(spark, store).count() == 2


def test_schema_checks(spark):
    df = spark.createDataFrame([(1, "a"), (1, None)], "id long, title string")
    got = schemas.check_schema(df, "id LONG, title INT, text STRING", ("title",), (("id",),))
    assert got == ["missing column text", "column title is string, not int", "column title has nulls", "id is not unique"]
    with pytest.raises(ValueError):
        p = spark.createDataFrame([(1, 1, "b" * 64)], "case_id long, paragraph_number int, text_hash string")
        ingest.backfill_uids(p.union(p), spark.createDataFrame([(1, "a" * 64)], "id long, document_hash string"))


def test_manifest(spark):
    base = {c: "x" for c in acquisition.REQUIRED} | {"judgment_date": "2024-01-31", "local_filename": "x.pdf", "document_type": "judgment", "source_page_url": "https://court.gov.in/x", "direct_pdf_url": "https://indian-supreme-court-judgments.s3.amazonaws.com/x.pdf"}
    bad = [{}, {"court": " "}, {"judgment_date": "31-01-2024"}, {"local_filename": "a/x.pdf"}, {"document_type": "order"}, {"source_page_url": "http://court.gov.in"}, {"source_page_url": "https://notgov.in"}, {"direct_pdf_url": "https://x.org/x.pdf"}]
    df = spark.createDataFrame([(k, *[(base | b)[c] for c in acquisition.REQUIRED]) for k, b in enumerate(bad)], ["k", *acquisition.REQUIRED])
    got = dict(rows(df.select("k", acquisition.source_error().alias("e")).fillna("", "e"), "k", "e"))
    assert got[0] == "" and got[1] == "missing: court" and all(got[k] for k in range(1, 8))


# ---------------------------------------------------------------- retrieval

DOCS = [("u1", "alpha beta beta", "Court A", "2024-01-01", "N1"), ("u2", "alpha gamma", "court  a", "2023-01-01", "N2"), ("u3", "", None, None, None), ("u4", "beta", "COURT B", "2024-05-05", "n1")]


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(DOCS, "uid string, text string, court string, judgment_date string, case_number string")
    return filters.with_filter_columns(df.withColumn("judgment_date", F.to_date("judgment_date")))


def brute_bm25(query, texts, k1=1.5, b=0.75):
    import math
    from collections import Counter

    toks = {u: t.split() for u, t in texts.items()}
    avg = sum(map(len, toks.values())) / len(toks)
    out = {}
    for t, q in Counter(query.split()).items():
        df = sum(t in x for x in toks.values())
        for u, x in toks.items():
            if t in x:
                tf = x.count(t)
                out[u] = out.get(u, 0) + q * math.log(1 + (len(toks) - df + 0.5) / (df + 0.5)) * tf * (k1 + 1) / (tf + k1 * (1 - b + b * len(x) / avg))
    return out


def test_bm25(spark, docs, tmp_path):
    texts = {d[0]: d[1] for d in DOCS}
    queries = spark.createDataFrame([("q1", "Alpha beta BETA"), ("q2", "nothing"), ("q3", "gamma")], "query_id string, query string")
    got = {(r["query_id"], r["uid"]): r["score"] for r in bm25.search(docs, queries, 10).collect()}
    want = {(q, u): s for q, t in (("q1", "alpha beta beta"), ("q3", "gamma")) for u, s in brute_bm25(t, texts).items()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)
    index = bm25.build(docs)
    index.write(str(tmp_path / "ix"))
    again = bm25.top_k(bm25.scores(bm25.Index.read(spark, str(tmp_path / "ix")), bm25.query_terms(queries)), 1)
    assert rows(again, "query_id", "uid", "rank") == [("q1", "u1", 1), ("q3", "u2", 1)]
    some = bm25.search(docs, queries, 10, filters.Filters(court="ＣOURT a").predicate())
    assert {(r["query_id"], r["uid"]): r["score"] for r in some.collect()} == {k: v for k, v in got.items() if k[1] in ("u1", "u2")}
    for k1, b in ((0, 0.5), (1, 2)):
        with pytest.raises(ValueError):
            bm25.build(docs, k1, b)


def test_filters(docs):
    pick = lambda **f: [r[0] for r in rows(docs.where(filters.Filters(**f).predicate()), "uid")]
    assert pick(court="court A") == ["u1", "u2"] and pick(year=2024) == ["u1", "u4"] and pick(case_number=" n1 ") == ["u1", "u4"]
    assert pick(court="court b", year=2024, case_number="N1") == ["u4"] and len(pick()) == 4
    for bad in ({"court": " "}, {"year": 0}):
        with pytest.raises(ValueError):
            filters.Filters(**bad)
    with pytest.raises(TypeError):
        filters.Filters(year=True)
    for q, k in (("", 5), ("?!", 5), ("a", 0), ("a", 51)):
        with pytest.raises(ValueError):
            filters.check_request(q, k)


def test_dense(spark):
    pts = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 1.0]), ("c", [0.6, 0.8]), ("d", [0.6, 0.8])], "uid string, embedding array<float>").repartition(3)
    qs = spark.createDataFrame([("q", [1.0, 0.0]), ("r", [0.0, -1.0])], "query_id string, vector array<float>")
    want = [("q", "a", 1), ("q", "c", 2), ("q", "d", 3), ("r", "a", 1), ("r", "c", 2), ("r", "d", 3)]
    assert rows(dense.search(pts, qs, 3, digits=6), "query_id", "uid", "rank") == want == rows(dense.search_expression(pts, qs, 3, digits=6), "query_id", "uid", "rank")
    assert dense.bad_vectors(pts.union(spark.createDataFrame([("e", [2.0, 0.0]), ("f", [1.0])], pts.schema)), 2).count() == 2
    embedded = dense.embed(spark.createDataFrame([("x", "a b"), ("y", None)], "uid string, text string"), dense.HashingEmbedder(8)).collect()
    assert [len(r["embedding"]) for r in embedded] == [8, 8]


def ranked(spark, *uids):
    return spark.createDataFrame([("q", u, 1.0 - k / 10, k + 1) for k, u in enumerate(uids)], "query_id string, uid string, score double, rank int")


def test_fusion(spark):
    got = {r["uid"]: r for r in fusion.fuse(ranked(spark, "a", "b"), ranked(spark, "b", "c"), 60).collect()}
    assert got["b"]["rrf_score"] == 1 / 62 + 1 / 61 and got["a"]["rrf_score"] == 1 / 61 and got["c"]["rrf_score"] == 1 / 62
    assert [got[u]["hybrid_rank"] for u in "bac"] == [1, 2, 3] and got["a"]["dense_rank"] is None
    assert rows(fusion.positions(ranked(spark, "a", "a", " b ")), "uid", "rank") == [("a", 1), ("b", 3)]
    assert fusion.fuse(ranked(spark, "a"), ranked(spark, "b")).first()["rrf_score"] == 1 / 11
    with pytest.raises(ValueError):
        fusion.fuse(ranked(spark, "a"), ranked(spark, "b"), 0)


class Fixed:
    def score(self, pairs):
        return [{"x": -2.0, "y": 3.5, "z": 0.25}.get(t, 0.0) for _, t in pairs]


class Broken:
    def score(self, pairs):
        return [float("nan")] * len(pairs)


def test_rerank(spark):
    c = spark.createDataFrame([("q", "query", u, t, k) for k, (u, t) in enumerate(zip("abcde", "xyzvw", strict=True), 1)], "query_id string, query string, uid string, text string, hybrid_rank int")
    assert [r["uid"] for r in rerank.rerank(c, Fixed(), 3, 10, 2).orderBy("reranked_rank").collect()] == ["b", "c", "a"]
    assert [r["uid"] for r in rerank.rerank(c, Fixed(), 50, 10).orderBy("reranked_rank").collect()] == ["b", "c", "d", "e", "a"]
    assert rerank.rerank(c, None, 3, 2).count() == 2
    with pytest.raises(Exception, match="finite"):
        rerank.rerank(c, Broken()).collect()


def test_engine(spark, docs):
    e = engine.Engine(docs, dense.embed(docs, dense.HashingEmbedder()), dense.HashingEmbedder())
    qs = spark.createDataFrame([("q", "alpha beta"), ("r", "gamma")], "query_id string, query string")
    for mode in engine.MODES:
        got = e.search(qs, mode, 2)
        assert tuple(got.columns) == schemas.RESULT
        assert [r["final_rank"] for r in got.where("query_id = 'q'").orderBy("final_rank").collect()] == [1, 2]
    answers = e.answer(qs, lambda p: p.select("query_id", F.concat(F.lit("Found here. ["), F.get("evidence_ids", F.lit(0)), F.lit("]")).alias("answer"), F.slice("evidence_ids", 1, 1).alias("declared")))
    assert [r["error"] for r in answers.collect()] == [None, None]
    none = e.answer(qs, lambda p: p.select("query_id", F.lit("x").alias("answer"), F.array().cast("array<string>").alias("declared")), filters=filters.Filters(court="no such"))
    assert {r["answer"] for r in none.collect()} == {evidence.NO_EVIDENCE}
    assert {r["verification"] for r in engine.research(none, None).collect()} == {"not_run"}
    down = engine.research(answers, None)
    assert {r["verification"] for r in down.collect()} == {"unavailable"} and engine.state_errors(down).count() == 0


# ---------------------------------------------------------------- answers

@pytest.mark.parametrize(
    ("answer", "want"),
    [
        ("SUMMARY\nTherefore, in summary: the appeal failed. [E1] This answer is not legal advice.", [("the appeal failed.", ["E1"])]),
        ("Smith v. Jones Ltd. was cited [E2]. It held so [E1][E2].", [("Smith v. Jones Ltd. was cited.", ["E2"]), ("It held so.", ["E1", "E2"])]),
        ("It was Acme Ltd. [E1] The court agreed.", [("It was Acme Ltd.", ["E1"]), ("The court agreed.", [])]),
        ("1. Appeal allowed\n- No", [("Appeal allowed", [])]),
        ("# Heading\nKey points:\n[E1]\nConsult a lawyer now.", []),
        (evidence.NO_EVIDENCE, []),
    ],
)
def test_claims(spark, answer, want):
    got = spark.createDataFrame([(answer,)], "answer string").select(claims.extract_claims(F.col("answer"))).first()[0]
    assert [(c["text"], c["citation_ids"]) for c in got] == want
    assert [c["claim_id"] for c in got] == [f"C{k + 1}" for k in range(len(got))]


def test_integrity(spark):
    cases = [("a [E1]", ["E1"]), ("a [E2] b [E1]", ["E2", "E1"]), ("a [E3]", ["E3"]), ("a [E1]", []), ("a [E2][E1]", ["E1", "E2"]), ("a [E01]", []), ("a [E1]", ["E01"])]
    df = spark.createDataFrame([(k, a, d, ["E1", "E2"]) for k, (a, d) in enumerate(cases)], "k int, answer string, declared array<string>, supplied array<string>")
    got = [r["e"] for r in df.orderBy("k").select(evidence.integrity_error(F.col("answer"), F.col("declared"), F.col("supplied")).alias("e")).collect()]
    assert got == [None, None, "unknown evidence id", "declared ids differ from citations", "declared ids differ from citations", "malformed citation", "malformed declared id"]


def test_verdicts(spark):
    found = claims.claims(spark.createDataFrame([("q", "One thing here [E1]. Another thing here. Third thing here [E2].")], "query_id string, answer string"))
    v = spark.createDataFrame([("q", "C1", "SUPPORTED", "see E1"), ("q", "C9", "PARTIAL", "x"), ("q", "C3", "PARTIAL", "like E1")], "query_id string, claim_id string, status string, reason string")
    e = spark.createDataFrame([("q", "E1", "one <x>"), ("q", "E2", "two")], "query_id string, evidence_id string, text string")
    asked = claims.verifier_prompts(found, e).first()
    assert asked["claim_ids"] == ["C1", "C3"] and "one \\u003cx\\u003e" in asked["prompt"]
    assert rows(claims.verdict_errors(found, v), "claim_id", "error") == [("C3", "reason names other evidence"), ("C9", "unexpected")]
    assert rows(claims.assemble(found, v), "claim_id", "status") == [("C1", "SUPPORTED"), ("C2", "UNSUPPORTED"), ("C3", "PARTIAL")]
    assert tuple(claims.summary(claims.assemble(found, v)).first()) == ("q", 1, 1, 1, 3)


# ---------------------------------------------------------------- evaluation

def test_metrics(spark):
    import math

    ranking = spark.createDataFrame([("s", "q", k + 1, u) for k, u in enumerate(["a", "a", "x", "b", "x2", "c"])] + [("s", "r", 1, "g2"), ("s", "r", 2, "g3"), ("s", "t", 11, "z")], "system string, query_id string, position int, uid string")
    labels = spark.createDataFrame([("q", "a", 3), ("q", "b", 2), ("q", "c", 1), ("r", "g2", 2), ("r", "g3", 3), ("t", "z", 1)], "query_id string, uid string, grade int")
    got = {r["query_id"]: r for r in evaluation.per_query(ranking, labels).collect()}
    assert abs(got["q"]["recall_at_5"] - 2 / 3) < 1e-12 and got["q"]["recall_at_10"] == 1
    assert abs(got["r"]["ndcg_at_10"] - (3 + 7 / math.log2(3)) / (7 + 3 / math.log2(3))) < 1e-12
    assert got["t"]["reciprocal_rank"] == got["t"]["recall_at_10"] == 0
    stored = evaluation.per_query(ranking, labels)
    assert evaluation.recompute_errors(stored, ranking, labels).count() == 0
    assert evaluation.recompute_errors(stored.withColumn("recall_at_5", F.col("recall_at_5") * 0.5), ranking, labels).count() == 2
    assert rows(evaluation.ranking_errors(ranking), "query_id", "problem") == [("q", "repeated id")]


def test_tuning(spark):
    assert tuning.grid(spark).count() == 10
    e = spark.createDataFrame([("b", 0.5, 0.5, 0.5, 2.0, 50, 50), ("a", 0.5, 0.5, 0.5, 1.0, 50, 50), ("c", 0.4, 0.9, 0.9, 0.1, 1, 1)], "experiment_id string, ndcg_at_10 double, recall_at_10 double, mrr double, runtime_seconds double, bm25_depth int, dense_depth int")
    assert tuning.best_experiment(e).first()["experiment_id"] == "a"
    assert rows(tuning.experiment_errors(e), "problem") == [("repeated configuration",)]


def test_audit(spark):
    cases = spark.createDataFrame([(1, "t", " "), (2, "t", "c"), (3, None, "c")], "case_id long, title string, court string")
    p = spark.createDataFrame([(1, "", 1), (1, "short", None), (2, "long enough text", None)], "case_id long, text string, page_number int")
    got = audit.corpus_audit(cases, p, 10).first().asDict()
    want = {"cases": 3, "min_paragraphs": 0, "median_paragraphs": 1, "p95_paragraphs": 2, "max_paragraphs": 2, "missing_title": 1, "missing_court": 1, "empty": 1, "very_short": 1, "with_page": 1, "without_page": 2, "page_coverage": 33.33}
    assert {k: got[k] for k in want} == want
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "uid string")
    got = audit.vector_coverage(ids("a", "b"), ids("b", "c", "c")).first().asDict()
    assert (got["missing"], got["stale"], got["repeated"], got["coverage"]) == (1, 1, 1, 50.0)


def test_gold(spark, tmp_path):
    label = {"paragraph_uid": "p1", "relevance": 3, "case_name": "c", "case_number": "n", "paragraph_number": 1, "page_number": None, "reason": "r"}
    q = {"query_id": "q1", "query": "What?", "query_type": "procedural", "difficulty": "easy", "notes": "", "relevant_paragraphs": [label]}
    bad = q | {"query_id": "q2", "query": " what? ", "difficulty": "x", "relevant_paragraphs": [label | {"relevance": 4}, label | {"relevance": 2, "paragraph_uid": "p1"}]}
    odd = {k: v for k, v in q.items() if k != "notes"} | {"more": 1}
    (tmp_path / "g.jsonl").write_text("\n".join(map(json.dumps, (q, bad))) + "\n")
    (tmp_path / "o.jsonl").write_text(json.dumps(odd) + "\n")
    good, problems = gold.read(spark, str(tmp_path / "g.jsonl"))
    assert problems.count() == 0
    assert gold.read(spark, str(tmp_path / "o.jsonl"))[1].first()[1:] == (["notes"], ["more"])
    store = spark.createDataFrame([("p1", "c", "other", 1, None)], "paragraph_uid string, case_name string, case_number string, paragraph_number int, page_number int")
    got = rows(gold.violations(good, store, 2), "query_id", "problem")
    assert ("q1", "provenance differs") in got and {p for i, p in got if i == "q2"} >= {"bad grade", "no label of the best grade", "repeated label", "unknown difficulty", "repeated query"}
    assert "grade 3" in gold.review(good, store.withColumn("text", F.lit("t")))


def test_command_line(spark, tmp_path, capsys):
    from quillspark import cli

    src, store = tmp_path / "in", f"file://{tmp_path}/store"
    src.mkdir()
    (src / "a.jsonl").write_text("\n".join(LINES) + "\n")
    cli.main(["ingest", str(src), store])
    cli.main(["search", store, "second paragraph", "--mode", "hybrid"])
    cli.main(["audit", store])
    assert "Second." in capsys.readouterr().out


# ---------------------------------------------------------------- round trips and small operators

def test_ingest_without_loss(spark, tmp_path):
    """A paragraph of number 0 fails its record; byte order marks, bad bytes and blank lines fail alone, with their numbers."""
    from quillspark.streaming import ingest as stream

    folder = tmp_path / "in"
    folder.mkdir()
    good = json.dumps({"title": "A", "text": "1. first\n2. second"})
    bad = json.dumps({"title": "B", "text": "1. first\n0. zero here"})
    bare = json.dumps({"title": "C", "text": "1. other\n0.\n\ntwo"})
    (folder / "a.jsonl").write_bytes(b"\xef\xbb\xbf" + good.encode() + b"\n" + bad.encode() + b"\r\n\xff\xfe\n\n" + bare.encode())
    store = str(tmp_path / "store")
    stream.ingest_folder(spark, str(folder), store, str(tmp_path / "progress"))
    cases, paragraphs = ingest.read_store(spark, store)
    assert sorted(r["title"] for r in cases.collect()) == ["A", "C"]
    assert sorted(r["text"] for r in paragraphs.collect()) == ["first", "other", "second", "two"]
    failed = spark.read.parquet(f"{store}/failures").collect()
    assert sorted((r["line_number"], r["reason"]) for r in failed) == [(2, "bad paragraph number"), (3, "not UTF-8"), (4, "blank line")]


def test_repeated_ids(spark):
    """Repeated ids count once."""
    from quillspark.operators import dense, fusion

    docs = spark.createDataFrame([(1, "apple pie"), (2, "pear tart"), (1, "apple pie")], "uid long, text string")
    queries = spark.createDataFrame([(1, "apple")], "query_id long, query string")
    once = bm25.search(docs.dropDuplicates(["uid"]), queries).collect()
    assert bm25.search(docs, queries).collect() == once
    points = spark.createDataFrame([(1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [0.6, 0.8])], "uid long, embedding array<double>")
    vector = spark.createDataFrame([(1, [1.0, 0.0])], "query_id long, vector array<double>")
    assert [(r["uid"], r["rank"]) for r in dense.search(points.coalesce(1), vector, 2).orderBy("rank").collect()] == [(1, 1), (3, 2)]
    new = spark.createDataFrame([(1, 5, "a"), (1, 7, "b"), (9, 1, "c")], "uid long, at long, v string")
    assert sorted((r["uid"], r["v"]) for r in dense.latest(new, "at").collect()) == [(1, "b"), (9, "c")]
    ranked = spark.createDataFrame([(1, 10, 3.0, 1), (1, 10, 3.0, 2), (1, 11, 1.0, 3)], "query_id long, uid long, score double, rank int")
    fused = fusion.fuse(ranked, ranked.where("uid = 10"), 10).orderBy("hybrid_rank").collect()
    assert [(r["uid"], r["bm25_rank"], r["dense_rank"], r["hybrid_rank"]) for r in fused] == [(10, 1, 1, 1), (11, 3, None, 2)]


def test_artifacts_round_trip(spark, tmp_path):
    from quillspark.plans import audit, evaluation
    from quillspark.sources import lines

    rankings = spark.createDataFrame([("a", 1, 1, 5), ("a", 1, 2, 6), ("b", 1, 1, 7)], "system string, query_id long, position int, uid long")
    labels = spark.createDataFrame([(1, 6, 3), (1, 8, 1)], "query_id long, uid long, grade int")
    per_query = evaluation.per_query(rankings, labels)
    lines.write_artifacts(per_query, evaluation.macro(per_query), str(tmp_path), ("a", "b"))
    assert evaluation.artifact_errors(*evaluation.read_artifacts(spark, str(tmp_path))).count() == 0
    text = (tmp_path / "metrics.json").read_text()
    (tmp_path / "metrics.json").write_text(text.replace('"recall_at_10": 0.5', '"recall_at_10": 0.25'))
    assert [(r["system"], r["problem"]) for r in evaluation.artifact_errors(*evaluation.read_artifacts(spark, str(tmp_path))).collect()] == [("a", "recall_at_10 differs")]
    (tmp_path / "per_query.jsonl").write_text("{\n")
    with pytest.raises(ValueError):
        evaluation.read_artifacts(spark, str(tmp_path))
    merged = audit.merged_counts(spark, {"x": '{"counts": {"pages": 3}}'})
    assert tuple(merged.first()) == ("x", "pages", 3)
    for wrong in ('{"counts": {"pages": -1}}', '{"counts": {"pages": true}}', "{}"):
        with pytest.raises(ValueError):
            audit.merged_counts(spark, {"x": wrong})


def test_error_sets(spark):
    from quillspark.plans import tuning

    rows = [(s, 1, r, n) for s, r, n in (("bm25", 0.5, 0.4), ("dense", 0.0, 0.0), ("hybrid", 0.5, 0.3), ("reranked", 0.5, 0.9))]
    df = spark.createDataFrame(rows, "system string, query_id long, recall_at_10 double, ndcg_at_10 double")
    assert sorted(r["error_set"] for r in tuning.error_sets(df).collect()) == ["bm25_succeeds_dense_fails", "hybrid_hurts_bm25", "reranker_helps_hybrid"]


def test_extractive_answers_and_functions(spark):
    from quillspark.functions import text
    from quillspark.operators import paragraphs

    e = spark.createDataFrame([(1, "E2", "Second  text."), (1, "E1", "First [E9] text!"), (1, "E4", "no")], "query_id long, evidence_id string, text string")
    r = evidence.extractive_answers(e).first()
    assert (r["answer"], r["declared"]) == ("First  text [E1].\nSecond text [E2].", ["E1", "E2"])
    text.register(spark)
    paragraphs.register(spark)
    assert tuple(spark.sql("SELECT text_tokens('a b''s c'), metadata_value('  x \u00a0 y '), metadata_value(' ')").first()) == (["a", "b's", "c"], "x y", None)
    assert [tuple(x) for x in spark.sql("SELECT * FROM extract_paragraphs('2. b\n\nc')").collect()] == [(2, None, "b"), (1, None, "c")]
    failed = spark.createDataFrame([("failed_urls", 3, "t", "u", "boom", "judgment"), ("downloaded", 4, "t", "u", None, "Judgment ")], "category string, record_number long, title string, direct_pdf_url string, error string, document_type string")
    from quillspark.operators import acquisition

    assert [tuple(x) for x in acquisition.failure_records(failed).collect()] == [("failed_urls", 3, "t", "u", "boom")]
