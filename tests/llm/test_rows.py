"""Operators that judge rows: quality rules, license scans, url filters, WARC."""

import gzip
import hashlib
import io
import random
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quillspark.llm import licenses, quality, url_filter, warc


def brute_measures(text):
    text = text or ""
    words = text.encode().split()
    grams = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    covered = {i + k for i in range(len(words) - 2) if grams[tuple(words[i : i + 3])] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if x.encode().split()]
    return len(words), sum(len(w.decode()) for w in words), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def test_quality(spark, documents, odd, empty):
    for df, rows in (documents, odd):
        got = quality.apply_policy(quality.ledger(quality.measure(df))).collect()
        key = lambda r: (r[0] is not None, r[0], *r[1:])
        have = sorted(((r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) for r in got), key=lambda r: str(key(r)))
        assert have == sorted(((r[0], *brute_measures(r[1])) for r in rows), key=lambda r: str(key(r)))
        assert all(r["kept"] == (r["failed_bits"] == 0) for r in got)
    assert quality.ledger(quality.measure(empty)).count() == 0
    with pytest.raises(ValueError):
        quality.measure(odd[0].withColumnRenamed("lang", "n_words"), keep=("n_words",))


def test_repeated_words_beyond_one_key():
    words = [b"%d" % (i % 5) for i in range(40)]
    assert quality.repeated_words(words) == 40
    many = [b"%d" % i for i in range(3000)] * 2
    assert quality.repeated_words(many, 8) == 6000


def test_ablation(spark, documents):
    led = quality.ledger(quality.measure(documents[0])).persist()
    bits = [r["failed_bits"] for r in led.select("failed_bits").collect()]
    for version, names in quality.POLICIES.items():
        mask = quality.policy_mask(version)
        got = {r["rule"]: (r["n_failed"], r["n_only"], r["n_kept"], r["n_kept_without"]) for r in quality.ablation(led, version).collect()}
        for name in names:
            bit = quality.BIT[name]
            assert got[name] == (sum(b & bit > 0 for b in bits), sum(b & mask == bit for b in bits), sum(b & mask == 0 for b in bits), sum(b & mask & ~bit == 0 for b in bits))


def brute_matches(text):
    words = licenses.word_list(text or "")
    out = set()
    for label, terms, step in licenses.template_sets(licenses.TEMPLATES):
        for b in (set(words[k : k + 2 * step]) for k in range(0, max(1, len(words)), step)):
            if len(terms & b) >= licenses.THRESHOLD * len(terms) - 1e-9:
                out.add(label)
    return out


def test_licenses(spark, documents, odd, empty):
    more = [(100, " ".join(["filler"] * 40) + " " + licenses.TEMPLATES[6][1].upper() + " tail"), (101, "under the License MIT released"), (102, "general public licence"), (103, "MIT  license. mit-LICENSE")]
    extra = spark.createDataFrame(more, "doc_id long, text string")
    for df, rows in (documents, odd, (extra, more)):
        got = sorted(((str(r["doc_id"]), r["n_words"], r["n_base"], r["labels"]) for r in licenses.labelled(licenses.scan_licenses(df)).collect()))
        want = []
        for r in rows:
            words = licenses.word_list(r[1] or "")
            base = [(i, label) for i in range(len(words)) for phrase, label in licenses.PHRASES if words[i : i + len(phrase.split())] == phrase.split()]
            want.append((str(r[0]), len(words), len(base), ",".join(sorted({b[1] for b in base} | brute_matches(r[1])))))
        assert got == sorted(want)
    assert licenses.scan_licenses(empty).count() == 0
    r = licenses.labelled(licenses.scan_licenses(extra)).where("doc_id = 103").first()
    assert (r["first_word"], r["last_word"], r["base_labels"], r["score"]) == (0, 2, "mit", 1.0)


URLS = [
    (1, "https://a.EXAMPLE.org/en/1x?y"), (2, "http://example.org/es/"), (3, "http://example.org"), (4, "https://x.com/fr/p"), (5, "https://x.com/de/p#z"), (6, "https://xcom/de/"),
    (7, "https://m.free-bets.example.net/a"), (8, "https://essex.net/Sex-ed"), (9, "https://essex.net/bets/bets"), (10, "no scheme"), (11, None), (12, "x://h?q"), (None, "https://casino.net/poker"), (12, "x://h?q"), (13, "https://u@h.net:80/win_free"),
]


def test_urls(spark):
    df = spark.createDataFrame([(*u, "x") for u in URLS], "page_id long, url string, verdict string")
    got = [(r["page_id"], r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.judge_urls(df).collect()]
    assert sorted(got, key=str) == sorted([
        (1, "a.example.org", "/en/1x", "example.org/en/1", "block"), (2, "example.org", "/es/", "example.org/es/", "block"), (3, "example.org", "", None, "allow"),
        (4, "x.com", "/fr/p", "com/fr/", "allow"), (5, "x.com", "/de/p", "com/de/", "block"), (6, "xcom", "/de/", None, "allow"), (7, "m.free-bets.example.net", "/a", None, "block"),
        (8, "essex.net", "/Sex-ed", None, "block"), (9, "essex.net", "/bets/bets", None, "allow"), (10, "", "", None, "allow"), (11, "", "", None, "allow"), (12, "h", "", None, "allow"),
        (None, "casino.net", "/poker", None, "block"), (12, "h", "", None, "allow"), (13, "u@h.net:80", "/win_free", None, "block"),
    ], key=str)
    assert url_filter.judge_urls(df.limit(0)).count() == 0


def test_warc(spark, tmp_path):
    big = "é" * 600 + "\r\n\r\nWARC/1.1\r\nContent-Length: 3\r\n\r\n"
    rows = [(1, "http://a/", big), (2, "http://b/\r\nX: y", big), (3, None, "x"), (4, "http://d/", "x"), (5, "u", None), (6, "u", big), (None, "n", big), (7, "u", "z" * 2000), (7, "u", "q")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, kind string")
    manifest = warc.write_warc(df, str(tmp_path / "w"), file_bytes=2000, date="2026-01-02T03:04:05Z")
    assert len(manifest) > 3 and sum(m["records"] for m in manifest) == 27 + len(manifest)
    records = warc.read_warc(spark, str(tmp_path / "w"))
    assert Counter(r["record_type"] for r in records.collect()) == {"request": 9, "metadata": 9, "response": 6, "revisit": 3}
    got = [(r["response"]["page_id"], r["response"]["record_type"], r["response"]["refers_to"], r["response"]["payload_bytes"], r["response"]["payload_digest"]) for r in warc.transactions(records).collect()]
    want = []
    for i, _, html in rows:
        body = (html or "").encode()
        again = html == big and i != 6
        want.append((i, "revisit" if again else "response", 6 if again else None, len(body), hashlib.sha1(body).hexdigest()))
    assert sorted(got, key=str) == sorted(want, key=str)
    whole = warc.transactions(records).where("response.page_id = 6").first()
    assert whole["response"]["payload"] == big.encode() and whole["request"]["payload"].startswith(b"GET ") and whole["metadata"]["payload"].startswith(b"page-id: 6")
    revisits = [r for r in records.collect() if r["record_type"] == "revisit"]
    assert {r["refers_to_id"] for r in revisits} == {r["record_id"] for r in records.collect() if r["payload"] == big.encode()}
    ids = [r["record_id"] for r in records.collect()]
    assert len(set(ids)) == len(ids) and {r["date"] for r in records.collect()} == {"2026-01-02T03:04:05Z"}
    for m in manifest:  # each record is a gzip member of its own, and begins with what the format asks for
        raw, n = (tmp_path / "w" / m["file"]).read_bytes(), 0
        while raw:
            z = zlib.decompressobj(31)
            [(fields, body)] = list(warc.parse(io.BytesIO(z.decompress(raw))))
            assert {"warc-type", "warc-record-id", "warc-date", "content-type", "content-length"} <= set(fields)
            assert fields["warc-type"] != "revisit" or {"warc-profile", "warc-refers-to"} <= set(fields)
            raw, n = z.unused_data, n + 1
        assert n == m["records"]
    warc.write_warc(df.limit(0), str(tmp_path / "e"))
    assert warc.read_warc(spark, str(tmp_path / "e")).count() == 0


def test_warc_parser():
    good = b"WARC/1.1\r\nWARC-Type: metadata\r\nContent-Length: 2\r\n\r\nab\r\n\r\n"
    assert [b for _, b in warc.parse(io.BytesIO(good * 2))] == [b"ab", b"ab"]
    for bad in (good[:-3], b"HTTP/1.1\r\n" + good, good.replace(b": 2", b": 9")):
        with pytest.raises(ValueError):
            list(warc.parse(io.BytesIO(bad)))
    assert gzip.decompress(gzip.compress(good)) == good


def test_lone_records(spark):
    rows = [("<a>", "metadata", "<gone>", "u", None, None, 1, None, None, 0, b"m")]
    got = warc.transactions(spark.createDataFrame(rows, warc.RECORD_SCHEMA)).first()
    assert got["response"]["record_type"] is None and got["metadata"]["payload"] == b"m"


def test_repeated_payload_heads(spark, tmp_path):
    """Repeated rows of a shared payload's largest id: each a response of its own; long payloads; a broken archive."""
    rows = [(1, "u", "y" * 3_000_000), (2, "u", "y" * 3_000_000), (2, "u", "y" * 3_000_000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    warc.write_warc(df, str(tmp_path / "w"))
    records = warc.read_warc(spark, str(tmp_path / "w")).collect()
    assert sorted((r["record_type"], r["refers_to_id"]) for r in records if r["record_type"] in ("response", "revisit")) == [("response", None)] * 2 + [("revisit", None)]
    assert sorted((r["page_id"], r["refers_to"]) for r in records if r["record_type"] == "metadata" and r["refers_to"]) == [(1, 2)]
    assert len({r["record_id"] for r in records}) == 9
    file = next((tmp_path / "w").glob("*.warc.gz"))
    (tmp_path / "b").mkdir()
    (tmp_path / "b" / "x.warc.gz").write_bytes(file.read_bytes()[:-20])
    with pytest.raises(Exception, match="x.warc.gz"):
        warc.read_warc(spark, str(tmp_path / "b")).count()


def test_stored_ledger(spark, documents, tmp_path, monkeypatch):
    """Policies over a stored ledger; a changed rule is refused."""
    df, rows = documents
    judged = quality.ledger(quality.measure(df))
    quality.store(judged, str(tmp_path / "q"))
    again = quality.stored(spark, str(tmp_path / "q"))
    for version in quality.POLICIES:
        want = sorted(r["doc_id"] for r in quality.apply_policy(judged, version).where("kept").collect())
        assert sorted(r["doc_id"] for r in quality.apply_policy(again, version).where("kept").collect()) == want
    sole = {r["sole_rule"]: r["n"] for r in quality.attributed(again).groupBy("sole_rule").agg(F.count("*").alias("n")).collect()}
    assert {r["rule"]: r["n_only"] for r in quality.ablation(again).collect() if r["n_only"]} == {k: n for k, n in sole.items() if k}
    monkeypatch.setattr(quality, "RULES", (("few_words", "n_words < 40"), *quality.RULES[1:]))
    with pytest.raises(ValueError):
        quality.stored(spark, str(tmp_path / "q"))


def test_url_vocabulary(spark):
    """Weights of a versioned table: one strict term, or soft ones that reach the limit; long urls, nulls, repeated terms."""
    terms = spark.createDataFrame(
        [("v1", "bad", 2.0), ("v1", "Meh_word", 0.5), ("v1", "poor", 1.5), ("v1", "poor", 1.0), ("v2", "good", 2.0), ("v1", None, 1.0), ("v1", "x", None)],
        "version string, term string, weight double",
    )
    vocabulary = url_filter.read_vocabulary(terms, "v1")
    assert dict(vocabulary.weights) == {"bad": 2.0, "Meh_word": 0.5, "poor": 1.5} and vocabulary.strict == ("bad",)
    urls = ["a://h.net/bad", "a://h.net/badly", "a://h.net/poor/poor", "a://h.net/poor/meh-word", "a://h.net/good", None, "a://h.net/" + "y" * 500_000 + "/bad"]
    df = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id long, url string")
    got = sorted((r["page_id"], r["verdict"], r["weight"]) for r in url_filter.judge_urls(df, vocabulary=vocabulary).collect())
    assert got == [(0, "block", 2.0), (1, "allow", 0.0), (2, "allow", 1.5), (3, "block", 2.0), (4, "allow", 0.0), (5, "allow", 0.0), (6, "block", 2.0)]
    with pytest.raises(ValueError):
        url_filter.Vocabulary("v", (("a", 0.0),))


def test_whole_licenses(spark):
    """Templates of any length, wherever they stand; a clause alone; a text with a tenth of its words missing; not a half."""
    rng = random.Random(3)
    filler = lambda n: " ".join(f"word{rng.randrange(500)}" for _ in range(n))
    rows, want = [], {}
    for k, (label, text) in enumerate(licenses.TEMPLATES):
        for at in (0, 5, 37, 300):
            rows.append((len(rows), f"{filler(at)} {text} {filler(60)}"))
            want[rows[-1][0]] = label
    n = len(rows)
    bsd = licenses.TEMPLATES[8][1].split()
    rows.append((n, " ".join(w for i, w in enumerate(bsd) if i % 20) + " " + filler(20)))
    rows.append((n + 1, " ".join(bsd[: len(bsd) // 2])))
    rows.append((n + 2, " ".join(f"// {w}" for w in bsd)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: set(r["labels"].split(",")) for r in licenses.labelled(licenses.scan_licenses(df)).collect()}
    assert all(label in got[d] for d, label in want.items())
    assert got[n] == {"bsd"} and got[n + 1] == {""} and got[n + 2] == {"bsd"}
    assert [licenses.step_of(k) for k in (1, 9, 10, 17, 18, 33, 34)] == [8, 8, 16, 16, 32, 32, 64]
    table = spark.createDataFrame([("own", "some very special words here"), (None, "x"), ("y", None)], "label string, text string")
    assert licenses.read_templates(table) == [("own", "some very special words here")]
    found = licenses.scan_licenses(df.limit(0).union(spark.createDataFrame([(1, "a SOME very special words here b")], "doc_id long, text string")), templates=licenses.read_templates(table))
    assert [m["label"] for m in found.first()["matches"]] == ["own"]
