"""Groups of near-duplicates: wide SimHash fingerprints find candidates by bit slices, the exact Jaccard similarity decides.

`group_heads(docs)`: of each group the document with the smallest id. Two documents are linked if their sets of shingles of
`SHINGLE` words (A-Z lower-cased, words between 0x20 and 0x09-0x0D; fewer words: the whole sequence as one) have a Jaccard
similarity of `SIMILAR` or more; groups are the connected components of the links.
* Documents with equal sets are one node, so copies never meet in a comparison; those without words are copies.
* A node's fingerprint has as many 64-bit words as the keys need (a bit is 1 if over half of the shingles' hashes have it). Two
  sets of similarity 0.8 agree in a bit with a probability of `AGREE` or more, so tables of keys of a few bits each find them:
  the keys are as long as gives buckets of about `BUCKET` nodes, and there are as many tables as leave a pair at 0.8 apart with
  probability `MISSED`; both follow from the number of documents.
* In a bucket all members are compared by bit slices (`bitslices`) over the first `WORDS` words: at 0.8 they differ in 19 of
  128 bits on average and in over 31 once in 700 pairs, unrelated sets in 64. A bucket of more than `SPLIT` members is dealt in
  blocks, each pair of blocks a task, so no task holds more than about 2 * `SPLIT` members and no pair is left out.
* The comparison is run thrice. First it only marks nodes that have a near one; all else is done with these. Of their shingles
  those that no other such node has are counted: they bound each overlap from above, which rules out most pairs of a large
  group whose members differ by edits of their own. Then each node names the near one with the fewest shingles of its own, one
  pair a member however large the bucket. Last come the pairs whose groups still differ, once each. So a pair is left out only where a
  group links it already or it can't reach `SIMILAR`.
* Pairs are decided by the intersection of their sets, in the JVM.

Defined results: null text has no words. Null ids come after all others; rows with equal ids are told apart by a hash of the
text, and of rows that agree in both one stays. All columns are passed through; names beginning with "__" are refused. Very
long texts are read whole, one at a time. Empty tables give no rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.llm.bitslices import near_pairs
from quillspark.llm.components import components
from quillspark.llm.words import gram_hashes, hashes, mix, slices, texts
from quillspark.llm.written import written

SHINGLE = 5
SIMILAR = Fraction(4, 5)
#: Sets of equal size and Jaccard similarity J have the cosine 2J / (1 + J), and differ in a bit with its angle over pi.
AGREE = 1 - math.acos(8 / 9) / math.pi
MISSED = 0.003
BUCKET, SPLIT = 512, 4096
WORDS, LEVELS = 2, 5

_LAST = (1 << 63) - 1


def shingles(text: bytes, n: int = SHINGLE) -> np.ndarray:
    """The distinct shingles, sorted."""
    words = hashes(text.lower().split())  # of bytes: A-Z only
    return np.unique(gram_hashes(words, min(n, len(words)))) if len(words) else np.zeros(0, np.uint64)


def tables_for(n: int) -> tuple[int, int]:
    """(bits of a key, tables) for n documents."""
    bits = min(30, max(4, math.ceil(math.log2(max(1, n) / BUCKET))))
    return bits, math.ceil(math.log(MISSED) / math.log(1 - AGREE**bits))


def wide_bits(shingled: np.ndarray, words: int) -> np.ndarray:
    """The fingerprint's 64 * words bits, as booleans."""
    sums = np.zeros(64 * words, np.int64)
    salts = mix(np.arange(1, words + 1, dtype=np.uint64))
    for k in range(0, len(shingled), 255):  # so that the sums of a part fit a byte
        hashed = mix(shingled[k : k + 255, None] ^ salts)
        sums += np.unpackbits(hashed.view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint8)
    return 2 * sums > len(shingled)


def _fingerprinted(keyed: DataFrame, text: str, bits: int, tables: int) -> DataFrame:
    """__ord, __sig, node (a hash of the set), n (its size), f0, f1 (the words compared), keys (one a table)."""
    words = max(WORDS, -(-bits * tables // 64))
    powers = np.uint64(1) << np.arange(bits, dtype=np.uint64)
    table = np.arange(tables, dtype=np.uint64) << np.uint64(32)
    names = ["__ord", "__sig", "node", "n", "f0", "f1", "keys"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            nodes, sizes, fps, keys = [], [], np.zeros((b.num_rows, WORDS), np.uint64), []
            for i, t in enumerate(texts(b, "t")):
                own = shingles(t)
                nodes.append(xxhash.xxh3_64_intdigest(own.tobytes()))
                sizes.append(len(own))
                if not len(own):
                    keys.append(np.zeros(0, np.int64))
                    continue
                found = wide_bits(own, words)
                fps[i] = np.packbits(found[: 64 * WORDS], bitorder="little").view(np.uint64)
                keys.append((found[: bits * tables].reshape(tables, bits) @ powers | table).view(np.int64))
            columns = [
                b.column(0), b.column(1), pa.array(np.array(nodes, np.uint64).view(np.int64)), pa.array(sizes, pa.int64()),
                pa.array(fps[:, 0].view(np.int64)), pa.array(fps[:, 1].view(np.int64)), pa.array(keys, pa.list_(pa.int64())),
            ]
            yield pa.RecordBatch.from_arrays(columns, names)

    rows = keyed.select("__ord", "__sig", keyed[text].cast("string").alias("t"))
    return rows.mapInArrow(run, "__ord long, __sig long, node long, n long, f0 long, f1 long, keys array<long>")


def _sets(rows: DataFrame) -> DataFrame:
    """node, s (its shingles) of node, t."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            sets = pa.array([shingles(t).view(np.int64) for t in texts(b, "t")], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([b.column(0), sets], ["node", "s"])

    return rows.select("node", "t").mapInArrow(run, "node long, s array<long>")


def _cells(rows: DataFrame) -> DataFrame:
    """Adds cell and pair: buckets (key) of over SPLIT rows are dealt in blocks, and each pair of blocks is a cell."""
    large = written(rows.groupBy("key").count().where(F.col("count") > SPLIT), "large-buckets")
    blocks = F.coalesce(F.ceil(F.col("count") / SPLIT).cast("int"), F.lit(1))
    dealt = rows.join(large, "key", "left").withColumn("b", blocks).withColumn("own", F.pmod(F.xxhash64("node"), F.col("b")).cast("int"))
    pair = F.transform(F.sequence(F.lit(0), F.col("b") - 1), lambda j: F.least("own", j).cast("long") * F.lit(1 << 31) + F.greatest("own", j))
    return dealt.withColumn("pair", F.explode(pair)).drop("count", "b", "own").withColumnRenamed("key", "cell")


def _by_cell(rows: DataFrame, compare: Callable[[pa.Table], pa.Table], schema: str) -> DataFrame:
    """What `compare` finds in each cell of two rows or more. Cells stream through a task in order; one is held at a time."""
    dealt = _cells(rows).repartition("cell", "pair").sortWithinPartitions("cell", "pair")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, key = [], None

        def found() -> Iterator[pa.RecordBatch]:
            cell = pa.Table.from_batches(held)
            if cell.num_rows > 1:
                yield from compare(cell.combine_chunks()).to_batches()

        for b in batches:
            if not b.num_rows:
                continue
            keys = np.stack([b["cell"].to_numpy(), b["pair"].to_numpy()])
            cuts = (np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1).tolist()
            for s, e in zip([0, *cuts], [*cuts, b.num_rows], strict=True):
                own = tuple(keys[:, s].tolist())
                if held and own != key:
                    yield from found()
                    held = []
                key = own
                held.append(b.slice(s, e - s))
        if held:
            yield from found()

    return dealt.mapInArrow(run, schema)


def _can_reach(n: np.ndarray, m: np.ndarray, common: np.ndarray) -> np.ndarray:
    """Sets of these sizes, that share at most `common`, can have the Jaccard similarity SIMILAR."""
    num, den = SIMILAR.numerator, SIMILAR.denominator
    return (np.minimum(n, m) * den >= np.maximum(n, m) * num) & (common * (num + den) >= (n + m) * num)


def _fps(cell: pa.Table) -> np.ndarray:
    return np.stack([cell["f0"].to_numpy(), cell["f1"].to_numpy()], axis=1).view(np.uint64)


def _marked(rows: DataFrame) -> DataFrame:
    """node: those that have a near one in some bucket."""

    def run(cell: pa.Table) -> pa.Table:
        n = cell["n"].to_numpy()
        has = np.zeros(len(n), bool)
        for i, j in near_pairs(_fps(cell), LEVELS):
            ok = _can_reach(n[i], n[j], np.minimum(n[i], n[j]))
            has[i[ok]] = has[j[ok]] = True
        return pa.table({"node": pa.array(cell["node"].to_numpy()[has])})

    return _by_cell(rows, run, "node long").distinct()


def _central(rows: DataFrame) -> DataFrame:
    """u, v: each node with the near one that has the smallest share of shingles of its own (c: those that others have)."""

    def run(cell: pa.Table) -> pa.Table:
        n, c, node = (cell[x].to_numpy() for x in ("n", "c", "node"))
        order = np.lexsort((node, (n - c) / n))
        n, c, node = n[order], c[order], node[order]
        least = np.full(len(n), len(n))
        for i, j in near_pairs(_fps(cell)[order], LEVELS):
            ok = _can_reach(n[i], n[j], np.minimum(c[i], c[j]))
            np.minimum.at(least, j[ok], i[ok])
        own = np.flatnonzero(least < len(n))
        return pa.table({"u": pa.array(node[own]), "v": pa.array(node[least[own]])})

    return _by_cell(rows, run, "u long, v long").distinct()


def _crossing(rows: DataFrame) -> DataFrame:
    """u, v: the near nodes whose groups (g) differ, each pair in the first table in which they share a key."""

    def run(cell: pa.Table) -> pa.Table:
        n, c, node, g = (cell[x].to_numpy() for x in ("n", "c", "node", "g"))
        us, vs = [node[:0]], [node[:0]]
        if (g != g[0]).any():
            before = np.stack(cell["keys"].to_numpy())[:, : cell["cell"][0].as_py() >> 32]
            for i, j in near_pairs(_fps(cell), LEVELS):
                ok = np.flatnonzero((g[i] != g[j]) & _can_reach(n[i], n[j], np.minimum(c[i], c[j])))
                i, j = i[ok], j[ok]
                ok = ~(before[i] == before[j]).any(axis=1)
                i, j = i[ok], j[ok]
                us.append(np.maximum(node[i], node[j]))
                vs.append(np.minimum(node[i], node[j]))
        return pa.table({"u": pa.array(np.concatenate(us)), "v": pa.array(np.concatenate(vs))})

    return _by_cell(rows, run, "u long, v long").distinct()


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs u, v whose Jaccard similarity is SIMILAR or more."""
    a, b = sets.select(F.col("node").alias("u"), F.col("s").alias("a")), sets.select(F.col("node").alias("v"), F.col("s").alias("b"))
    both = pairs.join(a, "u").join(b, "v").select("u", "v", (F.size("a") + F.size("b")).alias("n"), F.size(F.array_intersect("a", "b")).alias("k"))
    return both.where(F.col("k") * SIMILAR.denominator >= (F.col("n") - F.col("k")) * SIMILAR.numerator).select("u", "v")


def _grouped(links: DataFrame, rows: DataFrame) -> DataFrame:
    """rows with g, the group of the node so far."""
    groups = written(components(links), "groups")
    return rows.join(groups, "node", "left").withColumn("g", F.coalesce("component", "node")).drop("component")


def links(nodes: DataFrame, sets_of) -> DataFrame:
    """Edges u, v among nodes (node, n, f0, f1, keys) whose components are those of all links. `sets_of` gives node, s of a
    table of nodes."""
    rows = nodes.select("node", "n", "f0", "f1", F.explode("keys").alias("key"))
    # Written, as all that is joined below: Spark can then broadcast what is small and split what is hot.
    marked = written(_marked(rows), "marked")
    sets = written(sets_of(marked), "shingles")
    alone = sets.select("node", F.explode("s").alias("h")).groupBy("h").agg(F.count("*").alias("k"), F.min("node").alias("node"))
    alone = written(alone.where("k = 1").groupBy("node").agg(F.count("*").alias("alone")), "alone")
    common = F.col("n") - F.coalesce("alone", F.lit(0))
    some = nodes.join(marked, "node").join(alone, "node", "left").withColumn("c", common).drop("alone")
    some = written(some.where(F.col("c") * SIMILAR.denominator >= F.col("n") * SIMILAR.numerator), "candidates")
    rows = some.select("node", "n", "c", "f0", "f1", F.explode("keys").alias("key"))
    near = written(_verified(written(_central(rows), "central"), sets), "near")
    met = written(_grouped(near, some), "grouped")
    rows = met.select("node", "n", "c", "g", "f0", "f1", "keys", F.explode("keys").alias("key"))
    return near.union(written(_verified(written(_crossing(rows), "crossing"), sets), "crossed"))


def group_heads(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each group of near-duplicates, all columns: that with the smallest id (null ids last), then the smallest
    hash of its text; of rows that agree in both, one."""
    if any(c.startswith("__") for c in docs.columns):
        raise ValueError("columns named __* can't be passed through")
    key = [F.coalesce(docs[id_column].cast("long"), F.lit(_LAST)).alias("__ord"), F.xxhash64(docs[text].cast("string")).alias("__sig")]
    keyed = docs.select("*", *key)
    every = written(_fingerprinted(keyed, text, *tables_for(docs.count())), "fingerprints")
    first = [F.first(c).alias(c) for c in ("n", "f0", "f1", "keys")]
    nodes = written(every.groupBy("node").agg(F.min(F.struct("__ord", "__sig")).alias("p"), *first), "nodes")

    def sets_of(some: DataFrame) -> DataFrame:
        places = written(nodes.join(some, "node").select("p.__ord", "p.__sig", "node"), "places")
        t: Column = docs[text].cast("string").alias("t")
        return _sets(docs.select(*key, t).join(places, ["__ord", "__sig"])).dropDuplicates(["node"])

    found = components(links(nodes, sets_of))
    roots = written(nodes.join(found, "node", "left").select("node", "p", F.coalesce("component", "node").alias("root")), "roots")
    heads = written(roots.groupBy("root").agg(F.min("p").alias("head")), "heads")
    head_of = written(roots.join(heads, "root").select("node", "head"), "head-of")
    of = every.groupBy("__ord", "__sig", "node").count().join(head_of, "node")
    lost = of.withColumn("__gone", F.struct("__ord", "__sig") != F.col("head")).where("__gone or count > 1")
    judged = keyed.join(written(lost.select("__ord", "__sig", "__gone"), "lost"), ["__ord", "__sig"], "left")
    alone = judged.where("__gone is null").select(*docs.columns)
    tied = judged.where("not __gone").dropDuplicates(["__ord", "__sig"]).select(*docs.columns)
    return alone.union(tied)
