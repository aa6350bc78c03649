import random
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from quillspark.llm import components, simhash


def brute_fingerprint(text):
    words = [w for w in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode().split()]
    if not words:
        return 0
    grams = [words[i : i + 3] for i in range(len(words) - 2)] or [words]
    hs = [xxhash.xxh64_intdigest(b" ".join(g), 42) for g in grams]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hs) > len(hs))


def brute_components(pairs):
    """doc -> smallest doc, of (doc, fp) rows, by comparing all distinct fingerprints."""
    fps = sorted({f for _, f in pairs})
    root = {f: f for f in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(fps):
        for b in fps[i + 1 :]:
            if (a ^ b).bit_count() <= 2:
                root[find(a)] = find(b)
    least = defaultdict(list)
    for d, f in pairs:
        least[find(f)].append(d)
    return {f: min((d for d in least[find(f)] if d is not None), default=None) for f in fps}


def test_whole_table(spark, documents):
    df, rows = documents
    pairs = [(d, brute_fingerprint(t)) for d, t in rows]
    of = brute_components(pairs)
    got = {(r["doc_id"], r["fingerprint"], r["component_id"]) for r in simhash.near_duplicates(df).collect()}
    assert got == {(d, f"{f:016x}", of[f]) for d, f in pairs}


def test_odd_rows(spark, odd, empty):
    df, rows = odd
    pairs = [(r[0], brute_fingerprint(r[1])) for r in rows]
    of = brute_components(pairs)
    got = Counter((r["doc_id"], r["fingerprint"], r["component_id"]) for r in simhash.near_duplicates(df).collect())
    assert got == Counter((d, f"{f:016x}", of[f]) for d, f in pairs)
    assert simhash.near_duplicates(empty).count() == 0


def planted(rng, n):
    """Chains and crowds of fingerprints near each other."""
    out = [rng.getrandbits(64) for _ in range(n)]
    for _ in range(n):
        x = rng.choice(out)
        for k in rng.sample(range(64), rng.randint(1, 3)):
            x ^= 1 << k
        out.append(x)
    crowd = rng.getrandbits(64)
    out += [crowd ^ 1 << a ^ 1 << b for a in range(12) for b in range(a)]
    return sorted(set(out))


@pytest.mark.parametrize("bucket", [8192, 8])
def test_links_lose_nothing(spark, bucket):
    """Also where buckets are too large and are dealt once more."""
    fps = planted(random.Random(bucket), 60)
    signed = [int(x) for x in np.array(fps, np.uint64).view(np.int64)]
    df = spark.createDataFrame([(x,) for x in signed], "fp long").repartition(3)
    links = simhash.links(df, bucket)
    assert all(((r["u"] ^ r["v"]) & (1 << 64) - 1).bit_count() <= 4 for r in links.collect())
    got = {r["node"]: r["component"] for r in components.components(links).collect()}
    groups = brute_components([(x, y) for x, y in zip(signed, fps, strict=True)])
    assert [got.get(s, s) for s in signed] == [groups[f] for f in fps]


def test_bit_slices():
    rng = random.Random(3)
    fps = np.array(planted(rng, 40), np.uint64)
    planes, values = simhash.planes_of(fps), fps.tolist()
    for radius in range(4):
        for x in values[:50]:
            near = simhash.within(planes, x, (1 << len(values)) - 1, list(range(64)), radius)
            assert near == sum(1 << j for j, y in enumerate(values) if (x ^ y).bit_count() <= radius)


def test_components_of_a_path(spark):
    n = 300
    links = spark.range(n).select(F.col("id").alias("u"), (F.col("id") + 1).alias("v"))
    got = components.components(links).collect()
    assert len(got) == n + 1 and {r["component"] for r in got} == {0}
