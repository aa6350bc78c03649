"""SimHash near-duplicates: bit-sliced comparison of 64-bit fingerprints.

`fingerprints(docs)`: A-Z lower-cased, words between 0x20 and 0x09-0x0D, shingles of three words joined by spaces
(repeats count; fewer words: the whole sequence as one), XXH64 with seed 42 of each; a bit is set if it is in over half of
the hashes. No words: fingerprint zero, linked like any other. Null text is empty.

`links(fps)`: pairs of distinct fingerprints with at most `RADIUS` differing bits, each as an edge of a spanning forest.
* Equal fingerprints are one node, so copies never meet in a comparison.
* 64 bits are cut into four blocks of 16. Two differing bits touch at most two blocks, so linked fingerprints agree in two
  blocks: each fingerprint goes to six buckets, one for each pair of blocks, keyed by their 32 bits. No link is lost.
* A bucket's fingerprints are stored as vertical bit planes: plane k holds bit k of all members in one wide integer. A
  member is compared with all later ones at once: the planes' differences go through a carry-save counter (ones, twos,
  over), which saturates above the radius, and the comparison is abandoned once all have exceeded it. The 32 planes of the
  key agree and are skipped.
* Of a bucket only a spanning forest leaves (fewer edges than members).
* A bucket of more than `BUCKET` members is dealt once more in the same way: its members' other 32 bits are cut into four blocks of
  8, of which linked ones agree in two, so each goes to six smaller buckets, in which 48 bits agree. They are compared by the
  same bit slices over the 16 planes that are left, so at most 65,536 distinct fingerprints meet in one task. No link is lost.

`near_duplicates(docs)`: doc_id, fingerprint, component_id (the smallest doc_id that links reach, itself included).
Null doc_ids are kept: they link like others, and component_id is null if a component has no other. Repeated rows are
kept. Further columns are left out. Empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.components import components
from quillspark.llm.words import slices, texts
from quillspark.llm.written import written

RADIUS = 2
SHINGLE = 3
SEED = 42
BUCKET = 8192
BLOCK_BITS = 16
PAIRS = tuple(combinations(range(4), 2))


def fingerprint(text: bytes, n: int = SHINGLE) -> int:
    words = text.lower().split()  # of bytes: A-Z only
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= n:
        return xxhash.xxh64_intdigest(joined, SEED)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = (np.cumsum(lengths + 1) - 1).tolist()
    starts = [0, *(e + 1 for e in ends[: len(words) - n])]
    digest = xxhash.xxh64_digest
    raw = b"".join([digest(joined[a:b], SEED) for a, b in zip(starts, ends[n - 1 :], strict=True)])
    count = len(words) - n + 1
    sums = np.zeros(64, np.int64)
    bits = np.frombuffer(raw, np.uint8).reshape(count, 8)
    for k in range(0, count, 1 << 14):
        sums += np.unpackbits(bits[k : k + (1 << 14)], axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * sums > count).tobytes(), "big")


def fingerprints(docs: DataFrame, text: str = "text", keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """The columns of `keep` and fp (the 64 bits as a signed long)."""
    rows = docs.select(*keep, docs[text].cast("string").alias("__text"))
    n = len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            fps = np.fromiter((fingerprint(t) for t in texts(b, "__text")), np.uint64, b.num_rows).view(np.int64)
            yield pa.RecordBatch.from_arrays([*b.columns[:n], pa.array(fps)], [*b.schema.names[:n], "fp"])

    shape = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:n]]
    return rows.mapInArrow(run, ", ".join([*shape, "fp long"]))


def planes_of(fps: np.ndarray) -> list[int]:
    """Plane k: bit k of all, member i at bit i."""
    bits = np.unpackbits(fps.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    packed = np.packbits(bits, axis=0, bitorder="little")
    return [int.from_bytes(packed[:, k].tobytes(), "little") for k in range(64)]


def within(planes: list[int], fp: int, alive: int, order: list[int], radius: int = RADIUS) -> int:
    """The members in `alive` that differ from fp in at most `radius` bits, as a mask."""
    ones = twos = over = 0
    for k in order:
        diff = (planes[k] ^ -(fp >> k & 1)) & alive
        carry = ones & diff
        ones ^= diff
        both = twos & carry
        twos ^= carry
        over |= both if radius == 3 else both | (twos & ones) if radius == 2 else twos | both if radius == 1 else twos | both | ones
        if over & alive == alive:  # all have exceeded the radius
            return 0
    return alive & ~over


def bucket_links(fps: np.ndarray, order: list[int], radius: int = RADIUS) -> list[tuple[int, int]]:
    """A spanning forest of the links among distinct fingerprints, as positions."""
    n = len(fps)
    planes, values = planes_of(fps), fps.tolist()
    root = list(range(n))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    out, every = [], (1 << n) - 1
    for i in range(n - 1):
        later = every >> (i + 1) << (i + 1)
        near = within(planes, values[i], later, order, radius)
        while near:
            j = (near & -near).bit_length() - 1
            near &= near - 1
            a, b = find(i), find(j)
            if a != b:
                root[max(a, b)] = min(a, b)
                out.append((i, j))
    return out


def _bucket_rows(fps: DataFrame) -> DataFrame:
    """fp by (pair of blocks, their bits)."""
    entries = []
    for p, (a, b) in enumerate(PAIRS):
        part = lambda k: F.shiftrightunsigned("fp", BLOCK_BITS * k).bitwiseAND(F.lit(0xFFFF).cast("long"))
        key = F.shiftleft(part(b), 16).bitwiseOR(part(a))
        entries.append(F.struct(F.lit(p).cast("long").alias("p"), key.alias("key")))
    return fps.select("fp", F.explode(F.array(*entries)).alias("e")).select(F.shiftleft("e.p", 32).bitwiseOR(F.col("e.key")).alias("key"), "fp")


def _redealt(rows: DataFrame) -> DataFrame:
    """key, fp by sub: (pair of bytes, their bits) of the four bytes that the key hasn't."""
    pair = F.shiftrightunsigned("key", 32)
    other = F.lit(None).cast("long")
    for p, held in enumerate(PAIRS):
        c, d = (k for k in range(4) if k not in held)
        block = lambda k: F.shiftrightunsigned("fp", BLOCK_BITS * k).bitwiseAND(F.lit(0xFFFF).cast("long"))
        other = F.when(pair == p, F.shiftleft(block(d), 16).bitwiseOR(block(c))).otherwise(other)
    byte = lambda k: F.shiftrightunsigned(other, 8 * k).bitwiseAND(F.lit(0xFF).cast("long"))
    subs = [F.shiftleft(byte(b), 8).bitwiseOR(byte(a)).bitwiseOR(F.lit(p << 16).cast("long")) for p, (a, b) in enumerate(PAIRS)]
    return rows.select("key", F.explode(F.array(*subs)).alias("sub"), "fp")


def _planes_left(key: int, sub: int) -> list[int]:
    """The planes in which members of a bucket can differ."""
    blocks = [k for k in range(4) if k not in PAIRS[key >> 32]]
    if sub < 0:
        return [16 * k + i for k in blocks for i in range(16)]
    return [16 * blocks[k // 2] + 8 * (k % 2) + i for k in range(4) if k not in PAIRS[sub >> 16] for i in range(8)]


def links(fps: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """Edges u, v among distinct fingerprints (column fp)."""
    rows = _bucket_rows(fps)
    # Written first: Spark then knows its size, and broadcasts it only below spark.sql.autoBroadcastJoinThreshold.
    large = written(rows.groupBy("key").count().where(F.col("count") > bucket).select("key"), "large-buckets")
    small = rows.join(large, "key", "left_anti").select("key", F.lit(-1).cast("long").alias("sub"), "fp")
    dealt = small.union(_redealt(rows.join(large, "key", "left_semi"))).repartition("key", "sub").sortWithinPartitions("key", "sub", "fp")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Buckets stream through in order; one is held at a time."""
        held, own = [], None

        def found() -> Iterator[pa.RecordBatch]:
            fps = np.concatenate(held)
            if len(fps) > 1:
                signed = fps.view(np.int64)
                pairs = np.array(bucket_links(fps, _planes_left(*own)), np.int64).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays([pa.array(signed[pairs[:, 0]]), pa.array(signed[pairs[:, 1]])], ["u", "v"])

        for b in batches:
            if not b.num_rows:
                continue
            keys = np.stack([b.column(0).to_numpy(), b.column(1).to_numpy()])
            fps = b.column(2).to_numpy().view(np.uint64)
            cuts = (np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1).tolist()
            for s, e in zip([0, *cuts], [*cuts, b.num_rows], strict=True):
                next_ = tuple(keys[:, s].tolist())
                if held and next_ != own:
                    if sum(map(len, held)) > 1:
                        yield from found()
                    held = []
                own = next_
                held.append(fps[s:e].copy())
        if held:
            yield from found()

    return written(dealt.mapInArrow(run, "u long, v long"), "links")


def classes(fps: DataFrame) -> DataFrame:
    """fp, root (the same for all fingerprints that links connect), a row for each distinct fingerprint."""
    nodes = written(fps.select("fp").distinct(), "nodes")
    found = components(links(nodes)).withColumnRenamed("node", "fp")
    return nodes.join(found, "fp", "left").select("fp", F.coalesce("component", "fp").alias("root"))


def near_duplicates(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    rows = docs.select(docs[id_column].cast("long").alias("doc_id"), docs[text].alias("text"))
    fps = written(fingerprints(rows), "fingerprints")
    least = fps.groupBy("fp").agg(F.min("doc_id").alias("least"))
    members = written(classes(fps).join(least, "fp"), "members")
    heads = members.groupBy("root").agg(F.min("least").alias("component_id"))
    named = members.join(heads, "root").select("fp", "component_id")
    return fps.join(named, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
