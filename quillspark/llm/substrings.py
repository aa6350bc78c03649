"""Substring dedup by difference-cover anchors.

A window is `WINDOW` consecutive words of one document. Every word is removed that a window covers whose words also start
in a document with a smaller id; windows are judged on the input.

Anchors. COVER is a difference cover modulo PERIOD: for any two positions i and j some shift d < PERIOD puts both i + d and
j + d at residues in COVER. So of any window that two documents share, some anchor of WINDOW - PERIOD + 1 words inside it
stands at a cover position in both, and only cover positions are hashed (3 of 7).
1. Documents are dealt into chunks by a hash. A chunk sends each of its distinct anchors once, as 32 bits in a bucket
   of their hash, so copies within a chunk and words that every document has cost no more than one entry a chunk.
2. A bucket answers with one bit an anchor: is it in two documents? (A chance agreement of 32 bits only adds a candidate.)
3. A chunk extends the shared anchors: each window that holds one is hashed whole, by two independent functions of its words
   (128 bits: of 10**12 windows two different ones agree with a probability of 1e-15), and sent once a chunk, with the
   smallest id that has it. Windows are dealt to buckets by the first.
4. A bucket answers with the smallest id over all chunks, where that decides anything.
5. A chunk removes what is covered.
No pairs are made, no group gathers more than a chunk's documents or a bucket's entries, and both grow in number with the
corpus, not in size. Texts are shuffled once; steps 1, 3 and 5 read the same exchange.

Words are runs of anything but 0x20 and 0x09-0x0D, compared unchanged. Null text has no words. Rows with a null id take no
part: they keep all words and remove none. Rows with equal ids don't remove from each other. Texts shorter than a window
keep all words. Further columns are left out. Empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.words import gram_hashes, hashes, mix, second_gram_hashes, slices, texts

WINDOW = 13
PERIOD = 7
COVER = (0, 1, 3)
#: Documents and bytes of a chunk, about.
CHUNK_DOCS, CHUNK_BYTES = 2000, 8 << 20
#: Chunks of a partition, about, where there are more than the session's shuffle partitions would give.
PARTITION_CHUNKS = 4
#: Entries of a bucket, about.
BUCKET_ENTRIES = 1_000_000

_SALT = np.uint64(0xD6E8FEB86659FD93)
_IN_COVER = np.isin(np.arange(PERIOD), COVER)


def _anchors(h: np.ndarray, n_buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Cover positions and keys (bucket, 32 bits) of a document."""
    g = gram_hashes(h, WINDOW - PERIOD + 1)
    at = np.flatnonzero(_IN_COVER[np.arange(len(g)) % PERIOD])
    g = g[at]
    return at, (g % np.uint64(n_buckets)) << np.uint64(32) | g >> np.uint64(32)


def _chunk_hashes(docs: pa.Table) -> list[np.ndarray]:
    return [hashes(t.split()) for t in texts(docs.combine_chunks().to_batches()[0], "t")] if docs.num_rows else []


def _by_bucket(bucket: np.ndarray, n: int) -> list[tuple[int, int, int]]:
    """(bucket, from, to) of the runs of a sorted array."""
    if not n:
        return []
    cuts = np.flatnonzero(bucket[1:] != bucket[:-1]) + 1
    starts, ends = [0, *cuts.tolist()], [*cuts.tolist(), n]
    return [(int(bucket[s]), s, e) for s, e in zip(starts, ends, strict=True)]


def _chunk_anchors(all_hashes: list[np.ndarray], n_buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys of a chunk, sorted, and which are in several of its documents."""
    own = [np.unique(_anchors(h, n_buckets)[1]) for h in all_hashes]
    return_counts = np.unique(np.concatenate(own), return_counts=True) if own else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
    return return_counts[0], return_counts[1] > 1


def _windows(h: np.ndarray, n_buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The two hashes and the bucket of each window."""
    g = gram_hashes(h, WINDOW)
    return g, second_gram_hashes(h, WINDOW), mix(g ^ _SALT) % np.uint64(n_buckets)


def _found(g: np.ndarray, k: np.ndarray, own_g: np.ndarray, own_k: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which of own_g, own_k are in the table g, k (sorted by both), and where."""
    at = np.searchsorted(g, own_g)
    open_ = np.arange(len(own_g))
    hit = np.zeros(len(own_g), bool)
    while len(open_):  # entries that agree in g lie side by side
        open_ = open_[at[open_] < len(g)]
        open_ = open_[g[at[open_]] == own_g[open_]]
        same = k[at[open_]] == own_k[open_]
        hit[open_[same]] = True
        open_ = open_[~same]
        at[open_] += 1
    return hit, at


_SENT = "chunk long, bucket long, a binary, b binary, c binary, d binary"


def _sent(rows: list[tuple]) -> pa.Table:
    cols = list(zip(*rows, strict=True)) if rows else [()] * 6
    kinds = [pa.int64(), pa.int64(), *[pa.binary()] * 4]
    return pa.table([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["chunk", "bucket", "a", "b", "c", "d"])


def _bits(x: np.ndarray) -> bytes:
    return np.packbits(x).tobytes()


def _unbits(x: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(x, np.uint8), count=n).astype(bool)


def dedup_substrings(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_words, n_removed, spans (array of [start, end) of removed words), kept (kept words, one space between)."""
    rows = docs.select(docs[id_column].cast("long").alias("i"), docs[text].cast("string").alias("t"))
    size = rows.where("i is not null").agg(F.count("*").alias("n"), F.sum(F.octet_length("t")).alias("b")).first()
    n_chunks = max(1, -(-size["n"] // CHUNK_DOCS), (size["b"] or 0) // CHUNK_BYTES)
    n_parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), n_chunks // PARTITION_CHUNKS)
    n_buckets = max(8, (size["b"] or 0) // 6 * len(COVER) // PERIOD // BUCKET_ENTRIES + 1)
    chunked = rows.where("i is not null").withColumn("chunk", F.pmod(F.xxhash64("i", "t"), F.lit(n_chunks)).cast("long")).repartition(n_parts, "chunk")

    def send_anchors(docs: pa.Table) -> pa.Table:
        chunk = docs["chunk"][0].as_py()
        keys, several = _chunk_anchors(_chunk_hashes(docs), n_buckets)
        low = keys.astype(np.uint32)
        return _sent([
            (chunk, b, low[s:e].tobytes(), _bits(several[s:e]), b"", b"") for b, s, e in _by_bucket(keys >> np.uint64(32), len(keys))
        ])

    def answer_anchors(sent: pa.Table) -> pa.Table:
        bucket, parts = sent["bucket"][0].as_py(), [np.frombuffer(x, np.uint32) for x in sent["a"].to_pylist()]
        n = [len(p) for p in parts]
        several = np.concatenate([_unbits(x, k) for x, k in zip(sent["b"].to_pylist(), n, strict=True)])
        _, inverse, counts = np.unique(np.concatenate(parts), return_inverse=True, return_counts=True)
        shared = np.split(several | (counts > 1)[inverse], np.cumsum(n)[:-1])
        return _sent([(c, bucket, _bits(s), b"", b"", b"") for c, s in zip(sent["chunk"].to_pylist(), shared, strict=True) if s.any()])

    def send_windows(docs: pa.Table, answers: pa.Table) -> pa.Table:
        if not docs.num_rows or not answers.num_rows:
            return _sent([])
        chunk, every = docs["chunk"][0].as_py(), _chunk_hashes(docs)
        keys, _ = _chunk_anchors(every, n_buckets)
        shared = np.zeros(len(keys), bool)
        said = dict(zip(answers["bucket"].to_pylist(), answers["a"].to_pylist(), strict=True))
        for b, s, e in _by_bucket(keys >> np.uint64(32), len(keys)):
            if b in said:
                shared[s:e] = _unbits(said[b], e - s)
        keys = keys[shared]
        found = []
        for i, h in zip(docs["i"].to_pylist(), every, strict=True):
            if len(h) < WINDOW:
                continue
            at, own = _anchors(h, n_buckets)
            near = np.searchsorted(keys, own)
            at = at[keys[np.minimum(near, len(keys) - 1)] == own] if len(keys) else at[:0]
            if not len(at):
                continue
            last = len(h) - WINDOW
            delta = np.zeros(last + 2, np.int32)
            np.add.at(delta, np.maximum(at - PERIOD + 1, 0), 1)
            np.add.at(delta, np.minimum(at, last) + 1, -1)
            held = np.flatnonzero(np.cumsum(delta)[: last + 1] > 0)
            g, k, b = (x[held] for x in _windows(h, n_buckets))
            order = np.argsort(g, kind="stable")
            g, k, b = g[order], k[order], b[order]
            once = np.append(True, (g[1:] != g[:-1]) | (k[1:] != k[:-1]))
            found.append((g[once], k[once], b[once], np.full(once.sum(), i, np.int64)))
        if not found:
            return _sent([])
        g, k, b, i = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.lexsort((i, k, g, b))
        g, k, b, i = g[order], k[order], b[order], i[order]
        first = np.append(True, (g[1:] != g[:-1]) | (k[1:] != k[:-1]) | (b[1:] != b[:-1]))
        several = np.append(~first[1:], False)[first]
        g, k, b, i = g[first], k[first], b[first], i[first]
        return _sent([
            (chunk, x, g[s:e].tobytes(), i[s:e].tobytes(), _bits(several[s:e]), k[s:e].tobytes()) for x, s, e in _by_bucket(b, len(b))
        ])

    def answer_windows(sent: pa.Table) -> pa.Table:
        bucket, parts = sent["bucket"][0].as_py(), [np.frombuffer(x, np.uint64) for x in sent["a"].to_pylist()]
        n = [len(p) for p in parts]
        g, i = np.concatenate(parts), np.concatenate([np.frombuffer(x, np.int64) for x in sent["b"].to_pylist()])
        k = np.concatenate([np.frombuffer(x, np.uint64) for x in sent["d"].to_pylist()])
        several = np.concatenate([_unbits(x, m) for x, m in zip(sent["c"].to_pylist(), n, strict=True)])
        order = np.lexsort((i, k, g))
        head = np.append(True, (g[order][1:] != g[order][:-1]) | (k[order][1:] != k[order][:-1]))
        least = np.empty(len(g), np.int64)
        least[order] = i[order][head][np.cumsum(head) - 1]
        wanted = several | (least < i)
        out, at = [], 0
        for c, m in zip(sent["chunk"].to_pylist(), n, strict=True):
            own = at + np.flatnonzero(wanted[at : at + m])
            if len(own):
                out.append((c, bucket, g[own].tobytes(), least[own].tobytes(), b"", k[own].tobytes()))
            at += m
        return _sent(out)

    names = ["doc_id", "n_words", "n_removed", "spans", "kept"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.list_(pa.int64())), pa.string()]

    def result(out: list[tuple]) -> pa.Table:
        cols = list(zip(*out, strict=True)) if out else [()] * 5
        return pa.table([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=names)

    def remove(docs: pa.Table, answers: pa.Table) -> pa.Table:
        out: list[tuple] = []
        g = np.concatenate([np.frombuffer(x, np.uint64) for x in answers["a"].to_pylist()] or [np.zeros(0, np.uint64)])
        least = np.concatenate([np.frombuffer(x, np.int64) for x in answers["b"].to_pylist()] or [np.zeros(0, np.int64)])
        k = np.concatenate([np.frombuffer(x, np.uint64) for x in answers["d"].to_pylist()] or [np.zeros(0, np.uint64)])
        order = np.lexsort((k, g))
        g, k, least = g[order], k[order], least[order]
        seen, low = np.zeros(1 << 22, bool), np.uint64((1 << 22) - 1)
        seen[g & low] = True
        for batch in slices(iter(docs.to_batches())):
            for i, t in zip(batch.column("i").to_pylist(), texts(batch, "t"), strict=True):
                words = t.split()
                gone = None
                if len(words) >= WINDOW and len(g):
                    h = hashes(words)
                    w = gram_hashes(h, WINDOW)
                    maybe = np.flatnonzero(seen[w & low])
                    if len(maybe):
                        same, near = _found(g, k, w[maybe], second_gram_hashes(h, WINDOW)[maybe])
                        hit = maybe[same][least[near[same]] < i]
                        if len(hit):
                            delta = np.zeros(len(words) + 1, np.int32)
                            delta[hit] += 1
                            np.add.at(delta, hit + WINDOW, -1)
                            gone = np.cumsum(delta)[:-1] > 0
                if gone is None:
                    out.append((i, len(words), 0, [], b" ".join(words)))
                else:
                    edge = np.flatnonzero(np.diff(np.concatenate([[0], gone.view(np.int8), [0]])))
                    kept = [words[k] for k in np.flatnonzero(~gone).tolist()]
                    out.append((i, len(words), int(gone.sum()), edge.reshape(-1, 2).tolist(), b" ".join(kept)))
        return result([(*r[:4], r[4].decode()) for r in out])

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            words = [t.split() for t in texts(b, "t")]
            yield from result([(None, len(w), 0, [], b" ".join(w).decode()) for w in words]).to_batches()

    shape = "doc_id long, n_words long, n_removed long, spans array<array<long>>, kept string"
    by_chunk = chunked.groupBy("chunk")
    anchors = by_chunk.applyInArrow(send_anchors, _SENT).groupBy("bucket").applyInArrow(answer_anchors, _SENT)
    windows = by_chunk.cogroup(anchors.groupBy("chunk")).applyInArrow(send_windows, _SENT).groupBy("bucket").applyInArrow(answer_windows, _SENT)
    done = by_chunk.cogroup(windows.groupBy("chunk")).applyInArrow(remove, shape)
    return done.union(rows.where("i is null").mapInArrow(whole, shape))
