"""Packing: first-fit decreasing into sequences, by a tournament tree of bin capacities, within randomised groups.

Each document becomes its ids and an end id. What exceeds a sequence is cut into whole sequences; the rest of each
document goes, largest first, into the first bin with room, which the tree finds in a logarithm of steps. A group's
last, emptiest bins are then dealt out: their pieces are cut to fill the gaps of the bins before them, so that a group
leaves at most one bin with padding.

Groups: a hash of id and text spreads documents at random over as many groups as `group_docs` asks for, so a hot source
or a run of similar lengths never meets in one. Rows stream through a task sorted by group; a group that repeated rows
have made large is packed in blocks of at most 4 * `group_docs` documents, so memory is bounded by that many texts.

`pack(docs)`: piece_ids (u32 little-endian), doc_id, start, length, doc_tokens, sequence_id, offset, by piece. Null and
empty texts are one piece with the end id. Null ids are kept; repeated rows are packed each. Further columns are left
out. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.tokens import encoder
from quillspark.llm.words import slices

SEQUENCE = 2048
GROUP_DOCS = 1024
#: Groups of a partition, about, where there are more than the session's shuffle partitions would give.
PARTITION_GROUPS = 4
#: Sequence ids: group * BLOCKS + a running number.
BLOCKS = 1 << 24


class Tournament:
    """Bins in order; the winner of each node is the larger capacity below it."""

    def __init__(self, bins: int, capacity: int):
        self.leaves = 1 << max(0, bins - 1).bit_length()
        self.tree = [capacity] * (2 * self.leaves)
        self.capacity = capacity

    def take(self, size: int) -> tuple[int, int]:
        """Puts `size` into the first bin with room: (bin, offset in it)."""
        tree, node = self.tree, 1
        while node < self.leaves:
            node *= 2
            if tree[node] < size:
                node += 1
        offset = self.capacity - tree[node]
        tree[node] -= size
        at = node - self.leaves
        while node > 1:
            node >>= 1
            tree[node] = max(tree[2 * node], tree[2 * node + 1])
        return at, offset


def first_fit_decreasing(sizes: list[int], capacity: int) -> list[tuple[int, int]]:
    """(bin, offset) of each item; sizes are 1 to `capacity`. Equal sizes keep their order."""
    out: list[tuple[int, int]] = [(0, 0)] * len(sizes)
    tree = Tournament(max(1, len(sizes)), capacity)
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        out[i] = tree.take(sizes[i])
    return out


def pack_sizes(sizes: list[int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Pieces (item, start, length, bin, offset) of items of any positive size."""
    pieces, rests, n_bins = [], [], 0
    for i, size in enumerate(sizes):
        full = size // capacity
        for k in range(full):
            pieces.append((i, k * capacity, capacity, n_bins, 0))
            n_bins += 1
        if size % capacity:
            rests.append((i, full * capacity, size % capacity))
    placed = first_fit_decreasing([r[2] for r in rests], capacity)
    inside: dict[int, list[tuple[int, int, int]]] = {}
    for r, (b, _) in sorted(zip(rests, placed, strict=True), key=lambda x: x[1]):
        inside.setdefault(b, []).append(r)
    fill = {b: sum(x[2] for x in xs) for b, xs in inside.items()}
    order = sorted(inside, key=lambda b: (-fill[b], b))
    left, right = 0, len(order) - 1
    while left < right:  # the emptiest bins fill the gaps of the fullest
        into, source = order[left], order[right]
        gap = capacity - fill[into]
        if not gap:
            left += 1
            continue
        i, start, length = inside[source].pop()
        move = min(gap, length)
        inside[into].append((i, start + length - move, move))
        if move < length:
            inside[source].append((i, start, length - move))
        fill[into] += move
        fill[source] -= move
        if not inside[source]:
            right -= 1
    for b in order:
        offset = 0
        for i, start, length in inside[b]:
            pieces.append((i, start, length, n_bins, offset))
            offset += length
        n_bins += bool(inside[b])
    return pieces


def pack(
    docs: DataFrame, tokenizer: str, end_id: int, capacity: int = SEQUENCE, group_docs: int = GROUP_DOCS,
    id_column: str = "doc_id", text: str = "text",
) -> DataFrame:
    rows = docs.select(docs[id_column].cast("long").alias("i"), F.coalesce(docs[text].cast("string"), F.lit("")).alias("t"))
    groups = max(1, -(-docs.count() // group_docs))
    grouped = rows.withColumn("g", F.pmod(F.xxhash64("i", "t"), F.lit(groups)).cast("long"))
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), groups // PARTITION_GROUPS)
    dealt = grouped.repartition(parts, "g").sortWithinPartitions("g", "i", F.length("t"), F.xxhash64("t"))
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
    names = ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "piece_ids"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, end = encoder(tokenizer), np.array([end_id], "<u4").tobytes()
        group, used, held = None, 0, []

        def packed() -> Iterator[pa.RecordBatch]:
            nonlocal used
            pieces = pack_sizes([len(x) // 4 for _, x in held], capacity)
            out, weight = [], 0
            for item, start, length, b, offset in pieces:
                i, ids = held[item]
                out.append((i, start, length, len(ids) // 4, group * BLOCKS + used + b, offset, ids[4 * start : 4 * (start + length)]))
                weight += 4 * length
                if weight > 8 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)
                    out, weight = [], 0
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)
            used += 1 + max((p[3] for p in pieces), default=-1)
            held.clear()

        for b in slices(batches):
            encoded = enc.encode(b.column(1).to_pylist())
            for i, g, ids in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), encoded, strict=True):
                if held and (g != group or len(held) >= 4 * group_docs):
                    yield from packed()
                if g != group:
                    group, used = g, 0
                held.append((i, ids + end))
        if held:
            yield from packed()

    return dealt.mapInArrow(
        run, "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, piece_ids binary"
    )
