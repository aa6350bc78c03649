import random

import numpy as np

import corpus_pipeline
from quillspark.llm import bitslices, simhash_groups


def brute_heads(rows):
    """The smallest id of each component of 5-word Jaccard 0.8 or more, by comparing all pairs."""
    sets = []
    for d, t in rows:
        w = (t or "").lower().split(" ")
        sets.append((d, {tuple(w[i : i + 5]) for i in range(len(w) - 4)}))
    root = {d: d for d, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, (d, a) in enumerate(sets):
        for e, b in sets[:i]:
            if 5 * len(a & b) >= 4 * len(a | b):
                x, y = find(d), find(e)
                root[max(x, y)] = min(x, y)
    return sorted({find(d) for d, _ in rows})


def planted(seed):
    """Texts with few to many changed words, chains of changes, copies, and texts that share a passage."""
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(5000)}"
    bases = [[word() for _ in range(rng.randint(60, 300))] for _ in range(12)]
    shared = [word() for _ in range(60)]
    rows = [list(b) for b in bases]
    for b in bases:
        for share in (0.005, 0.01, 0.02, 0.025, 0.03, 0.05, 0.2):
            rows.append([word() if rng.random() < share else w for w in b])
        last = b
        for _ in range(4):
            last = [word() if rng.random() < 0.015 else w for w in last]
            rows.append(last)
        rows.append(list(b))
        rows.append(shared + [word() for _ in range(40)])
    rng.shuffle(rows)
    return [(i, " ".join(r)) for i, r in enumerate(rows)]


def test_near_copies_of_the_stage(spark):
    rows = planted(5)
    want = brute_heads(rows)
    df = spark.createDataFrame([(d, t, "en", "s", len(t)) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = corpus_pipeline.near_dedup(spark, df, "").collect()
    assert sorted(r["doc_id"] for r in got) == want
    assert len(want) < len(rows) - 60


def test_odd_rows(spark, odd, empty):
    df, rows = odd
    heads = simhash_groups.group_heads(df).collect()
    assert sorted(r["doc_id"] for r in heads) == [1, 2, 4, 7, 8, 9, 9]
    assert simhash_groups.group_heads(empty).count() == 0
    assert simhash_groups.group_heads(empty).columns == empty.columns


def test_bit_slices():
    """All pairs within the radius, and no others, whatever fills the lanes."""
    rng = np.random.default_rng(1)
    for members, words, levels in ((1, 2, 5), (63, 2, 5), (64, 1, 1), (300, 2, 5), (200, 1, 2), (129, 1, 5), (300, 3, 4)):
        fps = rng.integers(0, 1 << 63, (members, words), dtype=np.uint64) * np.uint64(2)
        for k in range(members // 2):
            fps[members - 1 - k] = fps[k]
            for _ in range(rng.integers(0, 60)):
                fps[members - 1 - k, rng.integers(words)] ^= np.uint64(1) << np.uint64(rng.integers(64))
        got = {(i, j) for a, b in bitslices.near_pairs(fps, levels, 100) for i, j in zip(a.tolist(), b.tolist(), strict=True)}
        ints = [sum(int(x) << 64 * k for k, x in enumerate(row)) for row in fps]
        assert got == {(i, j) for j in range(members) for i in range(j) if (ints[i] ^ ints[j]).bit_count() < 2**levels}


def test_split_buckets(spark, monkeypatch):
    """Large buckets in blocks: the same groups."""
    rows = planted(6)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(simhash_groups, "SPLIT", 7)
    assert sorted(r["doc_id"] for r in simhash_groups.group_heads(df).collect()) == brute_heads(rows)


def test_number_of_tables():
    """Long keys for many documents; a pair at 0.8 shares a bucket with probability 0.997 or more."""
    for n in (0, 1, 10**4, 10**6, 10**9):
        bits, tables = simhash_groups.tables_for(n)
        assert n / 2**bits <= simhash_groups.BUCKET
        assert (1 - simhash_groups.AGREE**bits) ** tables <= simhash_groups.MISSED
