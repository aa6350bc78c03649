"""Substring dedup, decontamination, the pipeline."""

import hashlib
import random
import time
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.llm import decontaminate, queries, substrings


def brute_substrings(rows, n=substrings.WINDOW):
    least = {}
    for d, t in rows:
        w = (t or "").encode().split()
        if d is not None:
            for i in range(len(w) - n + 1):
                g = tuple(w[i : i + n])
                least[g] = min(d, least.get(g, d))
    out = []
    for d, t in rows:
        w = (t or "").encode().split()
        gone = {i + k for i in range(len(w) - n + 1) if d is not None and least[tuple(w[i : i + n])] < d for k in range(n)}
        out.append((d, len(w), len(gone), hashlib.sha256(b" ".join(x for i, x in enumerate(w) if i not in gone)).hexdigest()))
    return Counter(out)


def test_cover():
    for d in range(substrings.PERIOD):
        for e in range(substrings.PERIOD):
            assert any((d + s) % substrings.PERIOD in substrings.COVER and (e + s) % substrings.PERIOD in substrings.COVER for s in range(substrings.PERIOD))


def test_substring_query(spark, documents):
    got = Counter(tuple(r) for r in queries.op9_substring_dedup(spark, "/root/testdata/sf0.001").collect())
    assert got == brute_substrings(documents[1])


@pytest.mark.parametrize("chunk", [2000, 3])
def test_substrings_of_few_words(spark, monkeypatch, chunk):
    """Texts over a tiny vocabulary, cut and pasted at any shift, over one or many chunks."""
    monkeypatch.setattr(substrings, "CHUNK_DOCS", chunk)
    rng = random.Random(chunk)
    base = [rng.choice("abcd") for _ in range(400)]
    rows = []
    for d in range(40):
        parts = []
        for _ in range(rng.randint(0, 4)):
            at = rng.randrange(380)
            parts += base[at : at + rng.randint(5, 30)] + [f"x{rng.random()}"] * rng.randint(0, 3)
        rows.append((d if d % 9 else None, "\n".join(parts)))
    rows += rows[:3]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = Counter((r["doc_id"], r["n_words"], r["n_removed"], hashlib.sha256(r["kept"].encode()).hexdigest()) for r in substrings.dedup_substrings(df).collect())
    assert got == brute_substrings(rows)


def test_substrings_odd_rows(spark, odd, empty):
    df, rows = odd
    got = substrings.dedup_substrings(df).collect()
    assert Counter((r["doc_id"], r["n_words"], r["n_removed"], hashlib.sha256(r["kept"].encode()).hexdigest()) for r in got) == brute_substrings([r[:2] for r in rows])
    assert [r["spans"] for r in got if r["doc_id"] == 5] == [[[0, 30_000]]]
    assert substrings.dedup_substrings(empty).count() == 0


# ---------------------------------------------------------------- decontamination

def brute_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def test_lcs():
    rng = random.Random(2)
    for _ in range(200):
        a, b = ([rng.randint(1, 4) for _ in range(rng.randint(1, 80))] for _ in range(2))
        assert decontaminate.lcs_length(decontaminate.lcs_table(np.array(a)), len(a), b) == brute_lcs(a, b)


def edited(rng, words, rate, pool):
    out = []
    for w in words:
        r = rng.random()
        if r < rate / 3:
            continue
        out.append(rng.choice(pool) if r < 2 * rate / 3 else w)
        if 2 * rate / 3 <= r < rate:
            out.append(rng.choice(pool))
    return out


def test_contaminations(spark, documents):
    df, rows = documents
    bench = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    items = [(r["item_id"], r["text"]) for r in bench.collect()]
    rng = random.Random(4)
    pool = [w for _, t in rows for w in t.split()]
    planted = []
    for k, (i, t) in enumerate(items):
        host = [rng.choice(pool) for _ in range(200)]
        at = rng.randrange(200)
        planted.append((10_000 + i, " ".join(host[:at] + edited(rng, t.split(), 0.1 * (k % 2), pool) + host[at:])))
    clean = [(20_000 + k, " ".join(rng.choice(pool) for _ in range(300))) for k in range(60)]
    both = df.select("doc_id", "text").union(spark.createDataFrame(planted + clean, "doc_id long, text string"))
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.contaminations(both, bench).collect()}
    exact = {(d, i) for i, t in items for d, x in rows if t in x}
    assert exact and exact <= got
    want = {(10_000 + i, i) for i, _ in items}
    assert len(want & got) >= 0.95 * len(want)
    assert not [g for g in got if g[0] >= 20_000]
    kept = {r["doc_id"] for r in decontaminate.clean(both, bench).collect()}
    assert kept == {r["doc_id"] for r in both.collect()} - {d for d, _ in got}


def test_contamination_odd_rows(spark, odd, empty):
    df, _ = odd
    bench = spark.createDataFrame([(1, "a b c d e f g h i j"), (2, None), (3, "too short"), (4, "zero line one line second line third line")], "item_id long, text string")
    got = Counter((r["doc_id"], r["item_id"]) for r in decontaminate.contaminations(df, bench).collect())
    assert got == {(1, 1): 2, (None, 1): 1, (7, 4): 1, (8, 4): 1}
    assert decontaminate.contaminations(empty, bench).count() == 0
    assert decontaminate.contaminations(df, bench.limit(0)).count() == 0
    left = decontaminate.clean(df, bench)
    assert left.columns == df.columns and left.count() == 8


def test_recall_against_all_pairs(spark, documents):
    """Every document against every item by the checks alone, without candidates: nearly all of those pairs are found."""
    df, rows = documents
    bench = [(r["item_id"], r["text"]) for r in spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").collect()]
    rng = random.Random(8)
    pool = [w for _, t in rows for w in t.split()]
    planted = []
    for k in range(240):
        i, t = bench[k % len(bench)]
        host = [rng.choice(pool) for _ in range(rng.randint(20, 400))]
        at = rng.randrange(len(host))
        planted.append((10_000 + k, " ".join(host[:at] + edited(rng, t.split(), rng.choice([0.1, 0.2, 0.3]), pool) + host[at:])))
    both = df.select("doc_id", "text").union(spark.createDataFrame(planted, "doc_id long, text string"))
    items = decontaminate.Items([(i, t.encode()) for i, t in bench])
    want = set()
    for d, t in [*rows, *planted]:
        doc = np.array([items.vocabulary.get(x, 0) for x in decontaminate.terms(t.encode())], np.uint32)
        for i, x in zip(items.ids, items.numbers, strict=True):
            if len(np.intersect1d(x, doc)) < 0.5 * len(np.unique(x)):
                continue
            n, tail = len(x), x[-max(1, len(x) // 4) :]
            got, at, to = decontaminate.best_stretch(n, decontaminate.lcs_table(x), doc, 0, len(doc))
            answer = decontaminate.lcs_length(decontaminate.lcs_table(tail), len(tail), doc[at : to + 8].tolist()) / len(tail)
            if got >= decontaminate.LCS * n or got >= decontaminate.LCS_ANSWER * n and answer >= decontaminate.ANSWER:
                want.add((d, i))
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.contaminations(both, spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")).collect()}
    assert len(want) > 150 and len(want & got) >= 0.97 * len(want)
    assert not [g for g in got if g[0] < 10_000 and g not in want]


def test_short_items(spark):
    """Items of 3 to 7 terms where they stand verbatim; fewer terms are no evidence."""
    items = spark.createDataFrame([(1, "alpha beta gamma"), (2, "one two"), (3, "x y z x y z w"), (4, None)], "item_id long, text string")
    docs = [(1, "so Alpha, beta gamma."), (2, "alpha beta. delta gamma"), (3, "one two"), (4, "x y z x y z x y z w"), (5, None), (6, "")]
    got = decontaminate.contaminations(spark.createDataFrame(docs, "doc_id long, text string"), items).collect()
    assert sorted((r["doc_id"], r["item_id"], r["lcs"]) for r in got) == [(1, 1, 1.0), (4, 3, 1.0)]


def test_space_is_added_up(spark):
    """The directions are those of a decomposition on one machine."""
    rng = np.random.default_rng(2)
    docs = [(k, " ".join(f"w{int(x)}" for x in rng.zipf(1.3, 80) % 60)) for k in range(300)]
    items = decontaminate.Items([(k, " ".join(f"w{int(x)}" for x in rng.integers(0, 60, 20)).encode()) for k in range(12)])
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    encoded = decontaminate._encoded(df, items, "doc_id", "text").persist()
    counted = decontaminate._document_frequency(encoded, items.size)
    blocks = []
    for _, t in docs:
        own = np.array([items.vocabulary.get(x, 0) for x in decontaminate.terms(t.encode())])
        blocks += [np.bincount(own[k : k + decontaminate.BLOCK], minlength=items.size) for k in range(0, len(own), decontaminate.BLOCK)]
    a = np.stack(blocks).astype(float)
    a[:, 0] = 0
    assert (counted[0][1:] == (a > 0).sum(axis=0)[1:]).all() and counted[1] == (a.sum(axis=1) > 0).sum()
    idf = items.weights(*counted)
    b = np.stack([np.bincount(x, minlength=items.size) for _, x in items.pieces()]) * idf
    a = a * idf
    share = (a**2).sum() / (b**2).sum()
    gram = a.T @ a + share * b.T @ b
    space = decontaminate.latent_space(encoded, items, counted, rank=10, rounds=4)
    full = idf > 0
    q = np.where(full[:, None], space / np.where(full, idf, 1)[:, None], 0)
    top = np.sort(np.linalg.eigvalsh(gram))[::-1][:10]
    assert np.allclose(q.T @ q, np.eye(10), atol=1e-4)
    assert np.trace(q.T @ gram @ q) >= 0.98 * top.sum()


def test_row_sums():
    """Row sums of keys with one to thousands of rows, in much less time than by reduceat, which was most of the cost."""
    rng = np.random.default_rng(3)
    keys = np.sort(np.minimum(rng.zipf(1.4, 40_000), 5_000))
    matrix, rows = rng.standard_normal((3_000, 72)).astype(np.float32), rng.integers(0, 3_000, len(keys))
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    got = decontaminate._sums(keys, matrix, rows)
    assert (got[0] == keys[first]).all() and np.allclose(got[1], np.add.reduceat(matrix[rows].astype(float), first, axis=0), atol=1e-1)
    assert not len(decontaminate._sums(keys[:0], matrix, rows[:0])[0])
    blocks = np.sort(rng.integers(0, 2_500, len(keys)))
    first = np.flatnonzero(np.append(True, blocks[1:] != blocks[:-1]))

    def best(run):
        took = []
        for _ in range(7):
            at = time.process_time()
            run()
            took.append(time.process_time() - at)
        return min(took)

    assert best(lambda: decontaminate._sums(blocks, matrix, rows)) < 0.7 * best(lambda: np.add.reduceat(matrix[rows], first, axis=0))


def test_windows_allow_what_stands_in_them(monkeypatch):
    """A window allows an item exactly if enough of its terms stand in it; so no stretch that holds it is left out."""
    rng = np.random.default_rng(6)
    numbers = [rng.integers(1, 90, n).astype(np.uint32) for n in (8, 20, 40, 64, 64, 300)]
    need = np.array([int(np.ceil(0.6 * len(x))) for x in numbers])
    docs = [np.where(rng.random(n) < 0.6, rng.integers(0, 90, n), 0).astype(np.uint16) for n in (0, 1, 40, 192, 193, 1000)]
    for cells in (1 << 22, 200):  # items together, or in groups
        monkeypatch.setattr(decontaminate, "_CELLS", cells)
        possible = decontaminate.Possible(numbers, need, 90)
        got, first = possible.windows(docs)
        assert first[-1] == len(got) and (len(possible.groups) > 1) == (cells == 200)
        for d, doc in enumerate(docs):
            for w in range(first[d], first[d + 1]):
                at = (w - first[d]) * decontaminate.WINDOW
                have = set(doc[at : at + 2 * decontaminate.WINDOW].tolist()) - {0}
                assert got[w].tolist() == [sum(t in have for t in x.tolist()) >= n for x, n in zip(numbers, need, strict=True)]


# ---------------------------------------------------------------- pipeline

def test_pipeline(spark, documents):
    pipeline = pytest.importorskip("corpus_pipeline")
    import test_simhash_groups

    from quillspark.llm import decontaminate, lines, quality
    from quillspark.llm.written import written

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    steps = {}
    for name, stage in pipeline.STAGES:
        steps[name] = docs = written(stage(spark, docs, sf), "step")
        if name != "packing":
            assert docs.columns == list(pipeline.COLUMNS)
    base = spark.read.parquet(f"{sf}/documents.parquet")
    ids = {n: {r["doc_id"] for r in df.select("doc_id").distinct().collect()} for n, df in steps.items()}
    good = {r["doc_id"] for r in quality.apply_policy(quality.ledger(quality.measure(base))).where("kept").collect()}
    assert ids["quality rules"] == good
    left = {r["doc_id"]: r["text"] for r in lines.dedup_lines(steps["quality rules"]).collect()}
    assert {r["doc_id"]: r["text"] for r in steps["line dedup"].collect()} == {d: t for d, t in left.items() if t}
    heads = test_simhash_groups.brute_heads(sorted((r["doc_id"], " ".join(r["text"].split())) for r in steps["line dedup"].collect()))
    assert sorted(ids["near dedup"]) == heads and steps["near dedup"].count() == len(heads)
    found = {r["doc_id"] for r in decontaminate.contaminations(steps["near dedup"], spark.read.parquet(f"{sf}/benchmark.parquet")).collect()}
    assert ids["decontamination"] == ids["near dedup"] - found and found and ids["packing"] == ids["decontamination"]
    total = lambda df: Counter(tuple(r) for r in df.drop("piece_ids", "sequence_id", "offset").collect())
    assert sum(r["length"] for r in pipeline.run(spark, sf).collect()) == sum(r["length"] for r in steps["packing"].collect())
    assert total(steps["packing"])


def test_pipeline_odd_rows(spark, odd, empty):
    """Nulls, ties, repeated rows, empty tables and a column more go through every stage."""
    pipeline = pytest.importorskip("corpus_pipeline")
    from quillspark.llm.written import written

    sf = "/root/testdata/sf0.001"
    for docs in (odd[0].withColumn("gone", F.lit(1)), empty):
        for name, stage in pipeline.STAGES:
            docs = written(stage(spark, docs, sf), "odd")
            assert name == "packing" or docs.columns == list(pipeline.COLUMNS)


def test_passage_that_most_documents_hold(spark):
    rng = random.Random(9)
    pool = [f"w{i}" for i in range(3000)]
    items = [(k, " ".join(rng.choice(pool[:1500]) for _ in range(30))) for k in range(40)]
    docs = [(d, " ".join([rng.choice(pool) for _ in range(80)] + (items[0][1].split() if d % 2 else []) + [rng.choice(pool) for _ in range(80)])) for d in range(200)]
    got = decontaminate.contaminations(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert sorted((r["doc_id"], r["item_id"]) for r in got.collect()) == [(d, 0) for d in range(1, 200, 2)]


def test_verbatim_items_of_any_length(spark):
    """Items much shorter or longer than a passage, among words of the benchmark's own vocabulary."""
    rng = random.Random(12)
    pool = [f"w{i}" for i in range(4000)]
    lengths = [n for n in (8, 9, 12, 15, 30, 64, 200, 900, 1500, 2500) for _ in range(12)]
    items = [(k, " ".join(rng.choice(pool) for _ in range(n))) for k, n in enumerate(lengths)]
    docs = []
    for k, text in items:
        a, b = ([rng.choice(pool) for _ in range(rng.randint(40, 300))] for _ in range(2))
        docs.append((k, " ".join([*a, *text.split(), *b])))
    got = decontaminate.contaminations(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    rows = {(r["doc_id"], r["item_id"]): r["lcs"] for r in got.collect()}
    lost = Counter(n for k, n in enumerate(lengths) if rows.get((k, k)) != 1.0)
    assert not lost and set(rows) == {(k, k) for k in range(len(lengths))}
