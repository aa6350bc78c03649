"""Benchmark decontamination by latent semantic retrieval.

1. Terms: A-Z lower-cased runs of letters, digits and anything beyond ASCII. The vocabulary are the terms of the benchmark
   items; other terms can't be common to both sides. Each document is turned into vocabulary numbers once (0: another
   term), which are written to the shared folder; everything after reads these.
2. Passages: blocks of `BLOCK` terms. How many blocks hold each term is counted over all documents (idf). Terms that stand in
   over `COMMON` of the blocks and of the items weigh nothing, unless an item has no others; all others weigh `FLOOR` or more,
   so a passage that a large part of the corpus holds is found too.
3. Distributed randomised SVD of the TF-IDF matrix A, whose rows are all blocks of the corpus and the benchmark's pieces, which
   are weighted to as much as the corpus: else its few passages would have no part in the leading directions. Each task adds
   A'(A W) of its blocks, Spark adds the tasks' rows up, the sum is orthonormalised, `ROUNDS` times (power iterations); then
   (A Q)'(A Q) is added up likewise, and its eigenvectors give the `RANK` leading directions. A passage's latent vector is the
   sum of its terms' weighted coordinates, and nothing else. The driver holds vocabulary x rank numbers.
4. Cosine candidates: an item is searched for as a whole, or in pieces of `PIECE` terms if it is longer; short pieces among
   short passages, longer ones among longer (`SCALES`). A search passage are two neighbouring blocks, so any stretch of a block
   and a term stands in one. All pairs of at least `COSINE` are candidates, uncapped, but where the windows around the passage,
   of 2 * `WINDOW` terms, hold too few of the item's terms for the checks to succeed (for longer items the document).
5. Checks on the terms themselves, around the candidate passage: the longest common subsequence with the item, in a stretch
   not much longer than the item, must reach `LCS` of the item's terms; or `LCS_ANSWER`, if the item's answer (its last
   quarter, where a question's answer stands) is found to `ANSWER` too. So inserted, dropped and exchanged terms are
   tolerated, scattered common words are not.
6. Verbatim items of any length are also found exactly: where an item's rarest term stands, all its terms are compared. Items of
   fewer than `LEAST` terms would match by chance if terms could be missing, so they are found in this way only; fewer than
   `VERBATIM` terms are no evidence and aren't searched for.

`contaminations(docs, benchmark)`: doc_id, item_id, cosine (of the passage; of a verbatim stretch 1), lcs (share of the item's terms), answer
(share of the answer's terms), a row for each document row and item, the best passage of it.
`clean(docs, benchmark)`: the rows of `docs` without a contamination, all columns.

The benchmark is read in blocks of at most `ITEMS` items and about `ITEM_TERMS` terms, which bounds what is broadcast; each block
reads the corpus anew. Null texts and items have no terms. Null doc_ids are kept, each row is judged on its own, so equal ids
and repeated rows give a row each. Very long texts go through in slices; a text holds the memory of its numbers. Further
columns are passed through by `clean`, but for names beginning with "__", which are refused. Empty tables on either side give
no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.words import slices, texts
from quillspark.llm.written import Written, written

ITEMS, ITEM_TERMS = 2_000, 200_000
BLOCK = 32
RANK, OVERSAMPLE, ROUNDS, SEED = 64, 8, 2, 7
COMMON, FLOOR = 0.1, 1.0
COSINE = 0.45
PIECE = 64
#: (terms of a block, longest piece that is searched for in passages of two of them), shortest first.
SCALES = ((12, 24), (BLOCK, PIECE))
LCS, LCS_ANSWER, ANSWER = 0.8, 0.6, 0.75
LEAST, VERBATIM = 8, 3
#: Terms of one slice of a document, a multiple of every block.
SLICE = 96 * 1365
#: Items of a block of cosines.
_STEP = 4096
#: Rows that are added up in a run.
_RUN = 32
#: Terms between the starts of two windows; each is two long, so it holds the surroundings of any candidate of a piece.
WINDOW = 2 * BLOCK + 2 * PIECE
#: Numbers of a matrix of terms and items, about.
_CELLS = 1 << 22

_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 32 for c in range(256))


def terms(text: bytes) -> list[bytes]:
    return text.translate(_FOLD).split()


class Items:
    """A block of benchmark items and their vocabulary; numbers begin at 1."""

    def __init__(self, rows: list[tuple[int, bytes]]):
        self.ids, self.numbers, self.vocabulary = [], [], {}
        self.short: list[tuple[int, np.ndarray]] = []
        for item_id, text in rows:
            found = terms(text)
            if len(found) < VERBATIM:
                continue
            own = np.array([self.vocabulary.setdefault(t, len(self.vocabulary) + 1) for t in found], np.uint32)
            if len(found) < LEAST:
                self.short.append((item_id, own))
            else:
                self.ids.append(item_id)
                self.numbers.append(own)
        self.size = len(self.vocabulary) + 1

    def pieces(self) -> list[tuple[int, np.ndarray]]:
        """(place of the item, terms) of what is searched for."""
        out = []
        for k, x in enumerate(self.numbers):
            starts = range(0, max(1, len(x) - PIECE + 1), PIECE)
            out += [(k, x[s : s + PIECE]) for s in starts]
            if len(x) > PIECE and len(x) % PIECE:
                out.append((k, x[-PIECE:]))
        return out

    def weights(self, df: np.ndarray, n: int) -> np.ndarray:
        """idf of each term over n blocks, by the rule above."""
        w = np.maximum(np.log((1 + n) / (1 + df)), FLOOR)
        held = sum((np.bincount(np.unique(x), minlength=self.size) for x in self.numbers), np.zeros(self.size))
        common = (df > COMMON * n) & (held > max(COMMON * len(self.ids), 2))
        for x in self.numbers:
            if common[x].all():
                common[x] = False
        w[common] = 0
        w[0] = 0
        return w


def _encoded(docs: DataFrame, items: Items, id_column: str, text: str) -> DataFrame:
    """doc_id, row (a number of the row), ids (u32 or u16)."""
    kind = "<u2" if items.size < 1 << 16 else "<u4"
    known = docs.sparkSession.sparkContext.broadcast(items.vocabulary)  # bounded by ITEM_TERMS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = known.value.get
        for b in slices(batches):
            out = []
            for t in texts(b, "t"):
                found = terms(t)
                out.append(np.fromiter(map(get, found, repeat(0)), kind, len(found)).tobytes())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary())], ["doc_id", "ids"])

    rows = docs.select(docs[id_column].cast("long").alias("doc_id"), docs[text].cast("string").alias("t"))
    return rows.mapInArrow(run, "doc_id long, ids binary")


def _numbers(raw: bytes, size: int) -> np.ndarray:
    return np.frombuffer(raw, "<u2" if size < 1 << 16 else "<u4")


def _pieces(batch: pa.RecordBatch, size: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(block number, vocabulary number) of the vocabulary terms of a batch, for parts of bounded size."""
    ids, blocks, held, base = [], [], 0, 0
    for raw in batch.column("ids").to_pylist():
        every = _numbers(raw, size)
        for at in range(0, len(every), SLICE):
            part = every[at : at + SLICE]
            where = np.flatnonzero(part)
            ids.append(part[where])
            blocks.append(where // BLOCK + base)
            base += -(-len(part) // BLOCK)
            held += len(where)
            if held >= SLICE:
                yield np.concatenate(blocks), np.concatenate(ids)
                ids, blocks, held = [], [], 0
    if held:
        yield np.concatenate(blocks), np.concatenate(ids)


def _firsts(keys: np.ndarray) -> np.ndarray:
    """Where the keys of a sorted array begin."""
    return np.flatnonzero(np.append(True, keys[1:] != keys[:-1])[: len(keys)])


def _sums(keys: np.ndarray, matrix: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys of a sorted array and the sums of their rows of a matrix. Keys are cut into runs of at most `_RUN`, which
    are added up side by side, a row of each at a time."""
    first = _firsts(keys)
    names, counts = keys[first], np.diff(np.append(first, len(keys)))
    cut = -(-counts // _RUN)
    whole = int(cut.sum()) == len(cut)
    if not whole:
        nth = np.arange(cut.sum()) - np.repeat(np.cumsum(cut) - cut, cut)
        names, counts = np.repeat(names, cut), np.minimum(np.repeat(counts, cut) - _RUN * nth, _RUN)
        first = np.repeat(first, cut) + _RUN * nth
    out = np.empty((len(first), matrix.shape[1]), matrix.dtype)
    order = np.argsort(-counts, kind="stable")  # longest first: those that have a row left stand in front
    for at in range(0, len(order), 2048):
        own = order[at : at + 2048]
        start, left = first[own], -counts[own]
        added = matrix.take(rows[start], axis=0)
        for k in range(1, -int(left[0])):
            n = int(np.searchsorted(left, -k))
            added[:n] += matrix.take(rows[start[:n] + k], axis=0)
        out[own] = added
    return (names, out) if whole else _sums(names, out, np.arange(len(out)))


def _added(df: DataFrame, run, n_rows: int, width: int) -> np.ndarray:
    """The sum of the matrices (n_rows x width) of which `run` yields rows (row, c0, c1, …). Spark adds them up by row, so no
    task gathers what the others have made."""
    columns = [f"c{k}" for k in range(width)]
    rows = df.mapInArrow(run, ", ".join(["row long", *(f"{c} double" for c in columns)]))
    added = rows.groupBy("row").agg(*[F.sum(c).alias(c) for c in columns]).toArrow()  # a row for each term at most
    out = np.zeros((n_rows, width))
    out[added["row"].to_numpy()] = np.stack([added[c].to_numpy() for c in columns], axis=1) if added.num_rows else 0
    return out


def _rows(m: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The rows of a matrix that aren't zero."""
    full = np.flatnonzero(m.any(axis=1))
    names = ["row", *(f"c{k}" for k in range(m.shape[1]))]
    for k in range(0, len(full), 4096):
        own = full[k : k + 4096]
        yield pa.RecordBatch.from_arrays([pa.array(own), *(pa.array(c) for c in np.ascontiguousarray(m[own].T))], names)


def _document_frequency(encoded: DataFrame, size: int) -> tuple[np.ndarray, int]:
    """In how many blocks each term stands, and how many blocks there are with any."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(size)
        for b in slices(batches, 256):
            for blocks, ids in _pieces(b, size):
                key = np.sort((blocks * size + ids).astype(np.uint32 if (int(blocks[-1]) + 1) * size < 1 << 32 else np.uint64))
                n += np.bincount((key[_firsts(key)] % size).astype(np.int64), minlength=size)
                n[0] += len(_firsts(blocks))
        yield from _rows(n.reshape(-1, 1))

    n = _added(encoded, run, size, 1)[:, 0]
    return n, int(n[0])


def _project(blocks: np.ndarray, ids: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Blocks that hold any term, and the sums of their terms' rows of `weights`."""
    return _sums(blocks, weights, ids)


def _applied(x: np.ndarray, blocks: np.ndarray, ids: np.ndarray, weights: np.ndarray, y: np.ndarray) -> None:
    """Adds A'(A W) of some blocks to y."""
    order = np.argsort(ids, kind="stable")
    nth = np.cumsum(np.append(False, blocks[1:] != blocks[:-1]))
    own, added = _sums(ids[order], x[1], nth[order])
    y[own] += added


def latent_space(encoded: DataFrame, items: Items, counted: tuple[np.ndarray, int], rank: int = RANK, rounds: int = ROUNDS) -> np.ndarray:
    """idf-weighted directions (size x rank): a passage's latent vector is the sum of its terms' rows. `counted` is the document
    frequency."""
    size = items.size
    idf = items.weights(*counted)
    width = min(rank + OVERSAMPLE, size)
    bench = [x for _, x in items.pieces()]
    rows, ids = np.repeat(np.arange(len(bench)), [len(x) for x in bench]), np.concatenate(bench)
    weighs = idf > 0

    def of_benchmark(m: np.ndarray) -> np.ndarray:
        y = np.zeros_like(m)
        _applied(_project(rows, ids, m), rows, ids, m, y)
        return y

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Blocks and terms that weigh anything."""
        for b in slices(batches, 256):
            for blocks, ids in _pieces(b, size):
                own = np.flatnonzero(weighs[ids])
                if len(own):
                    yield blocks[own], ids[own]

    def applied(m: np.ndarray) -> np.ndarray:
        """A'(A m) of the corpus, in unweighted terms."""
        weights = m.astype(np.float32)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            y = np.zeros((size, width))
            for blocks, ids in parts(batches):
                _applied(_project(blocks, ids, weights), blocks, ids, weights, y)
            yield from _rows(y)

        return _added(encoded, run, size, width)

    m, share = np.random.default_rng(SEED).standard_normal((size, width)), 1.0
    for k in range(rounds):
        corpus, own = applied(m * idf[:, None]) * idf[:, None], of_benchmark(m * idf[:, None]) * idf[:, None]
        if k == 0:  # m is random: sums of m * A'A m are the traces, all that A holds
            share = abs((m * corpus).sum()) / max(abs((m * own).sum()), 1e-9) or 1.0
        m, _ = np.linalg.qr(corpus + share * own)
    last = (m * idf[:, None]).astype(np.float32)

    def gram(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g = np.zeros((width, width))
        for blocks, ids in parts(batches):
            x = _project(blocks, ids, last)[1]
            g += x.T @ x
        yield from _rows(g)

    x = _project(rows, ids, last)[1].astype(np.float64)
    values, vectors = np.linalg.eigh(_added(encoded, gram, width, width) + share * (x.T @ x))
    leading = m @ vectors[:, np.argsort(-values)[:rank]]
    return (leading * idf[:, None]).astype(np.float32)


def lcs_table(item: np.ndarray) -> dict[int, int]:
    """Bit i of a term's mask: it is the item's term i."""
    out: dict[int, int] = {}
    for i, t in enumerate(item.tolist()):
        out[t] = out.get(t, 0) | 1 << i
    return out


def lcs_length(table: dict[int, int], n: int, other: list[int]) -> int:
    """Length of the longest common subsequence, bit-parallel."""
    every = (1 << n) - 1
    v = every
    for t in other:
        m = table.get(t)
        if m:
            u = v & m
            v = (v + u | v - u) & every
    return n - v.bit_count()


def best_stretch(n: int, table: dict[int, int], doc: np.ndarray, low: int, high: int) -> tuple[int, int, int]:
    """(length, from, to) of the best common subsequence of an item of n terms within stretches of 1.5 items and 8 terms of
    doc[low:high]."""
    reach = n + n // 2 + 8
    best = (0, low, low)
    step = max(1, n // 4)
    for at in range(low, max(low + 1, high - n // 2), step):
        to = min(at + reach, high)
        got = lcs_length(table, n, doc[at:to].tolist())
        if got > best[0]:
            best = (got, at, to)
        if to == high:
            break
    return best


class Verbatim:
    """Items by their rarest term."""

    def __init__(self, items: list[tuple[int, np.ndarray]], frequency: np.ndarray):
        self.is_anchor, self.by_anchor = np.zeros(len(frequency), bool), {}
        for k, x in items:
            at = int(np.argmin(frequency[x]))
            self.is_anchor[x[at]] = True
            self.by_anchor.setdefault(int(x[at]), []).append((k, at, x))

    def found(self, doc: np.ndarray) -> set[int]:
        """The items of which all terms stand in a row."""
        out = set()
        where = np.flatnonzero(self.is_anchor[doc])
        for p, term in zip(where.tolist(), doc[where].tolist(), strict=True):
            for k, at, x in self.by_anchor[term]:
                if k not in out and p >= at and np.array_equal(doc[p - at : p - at + len(x)], x):
                    out.add(k)
        return out


class Possible:
    """Which items a stretch can hold: those of which enough terms stand in it, wherever. In groups of items, each a matrix of
    the times that an item has a term."""

    def __init__(self, numbers: list[np.ndarray], need: np.ndarray, size: int):
        self.groups, self.need, self.items, self.size = [], need, len(numbers), size
        at = 0
        while at < len(numbers):
            own, to = set(numbers[at].tolist()), at + 1
            while to < len(numbers) and (len(own) + len(numbers[to])) * (to + 1 - at) <= _CELLS:
                own |= set(numbers[to].tolist())
                to += 1
            place = np.zeros(size, np.int32)
            place[sorted(own)] = np.arange(1, len(own) + 1)
            times = np.zeros((len(own) + 1, to - at), np.uint16 if max(map(len, numbers[at:to])) < 1 << 16 else np.uint32)
            for k in range(at, to):
                np.add.at(times[:, k - at], place[numbers[k]], 1)
            self.groups.append((at, to, place, times))
            at = to

    def held(self, stretches: np.ndarray, terms: np.ndarray, n: int) -> np.ndarray:
        """n x items, of the terms of n stretches."""
        out = np.zeros((n, self.items), bool)
        if not len(terms):
            return out
        key = stretches.astype(np.int64) * self.size + terms
        key = np.sort(key.astype(np.uint32) if n * self.size < 1 << 32 else key)
        key = key[_firsts(key)].astype(np.int64)
        stretches, terms = key // self.size, key % self.size
        for at, to, place, times in self.groups:
            rows = place[terms]
            own = np.flatnonzero(rows)
            if len(own):
                where, sums = _sums(stretches[own], times, rows[own])
                out[where, at:to] = sums >= self.need[at:to]
        return out

    def windows(self, docs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Windows x items, and the first window of each document."""
        counts = [max(1, -(-len(d) // WINDOW)) for d in docs]
        where = [np.flatnonzero(d) for d in docs]
        terms = np.concatenate([d[w] for d, w in zip(docs, where, strict=True)])
        nth = np.concatenate([w // WINDOW for w in where])
        first = np.cumsum([0, *counts])
        of = nth + np.repeat(first[:-1], [len(w) for w in where])
        also = np.flatnonzero(nth)  # the second half of the window before
        return self.held(np.append(of, of[also] - 1), np.append(terms, terms[also]), int(first[-1])), first


class Searched:
    """The pieces of one scale: those of up to `longest` terms that no shorter scale has."""

    def __init__(self, pieces: list[tuple[int, np.ndarray]], block: int, space: np.ndarray):
        self.block, self.owner = block, np.array([k for k, _ in pieces])
        latent = np.stack([space[x].sum(axis=0) for _, x in pieces])
        self.latent = (latent / np.maximum(np.linalg.norm(latent, axis=1, keepdims=True), 1e-12)).astype(np.float32)

    def candidates(
        self, docs: list[np.ndarray], space: np.ndarray, cosine: float, lengths: np.ndarray, windows: np.ndarray, first: np.ndarray
    ) -> Iterator[tuple[int, int, int, int, float]]:
        """(place of the document, item, from, to, cosine) of the search passages of documents, with as many terms to either side
        as the item has. windows: the items that each window allows; first: the first window of each document."""
        block, owner = self.block, self.owner
        sizes = np.array([len(d) for d in docs])
        counts = np.maximum(1, -(-sizes // block))
        base = np.cumsum(counts) - counts
        where = [np.flatnonzero(d) for d in docs]
        blocks = np.concatenate([w // block + b for w, b in zip(where, base, strict=True)])
        terms = np.concatenate([d[w] for d, w in zip(docs, where, strict=True)])
        doc = np.repeat(np.arange(len(docs)), counts)
        nth = np.arange(len(doc)) - base[doc]
        paired = nth + 1 < counts[doc]
        near = first[doc] + nth * block // WINDOW
        allows = windows[:, owner].any(axis=1)
        wanted = np.flatnonzero((paired | (nth == 0)) & (allows[near] | allows[np.maximum(near - 1, first[doc])]))
        for at in range(0, len(wanted), 4096):
            own = wanted[at : at + 4096]
            other = np.where(paired[own], own + 1, own)
            needed = np.zeros(len(doc), bool)
            needed[own] = needed[other] = True
            kept = np.flatnonzero(needed[blocks])
            held, sums = _project(blocks[kept], terms[kept], space)
            place = np.full(len(doc), len(held))
            place[held] = np.arange(len(held))
            sums = np.append(sums, np.zeros((1, space.shape[1]), np.float32), axis=0)
            z = sums[place[own]] + np.where(paired[own, None], sums[place[other]], np.float32(0))
            norm = np.linalg.norm(z, axis=1)
            full = np.flatnonzero(norm > 1e-9)
            own, z = own[full], z[full] / norm[full, None]
            for i in range(0, len(owner), _STEP):
                cos = z @ self.latent[i : i + _STEP].T
                a, b = np.divmod(np.flatnonzero(cos >= cosine), cos.shape[1])
                k, p = owner[i + b], own[a]
                low = np.maximum(nth[p] * block - lengths[k], 0)
                may = np.flatnonzero(windows[first[doc[p]] + low // WINDOW, k])
                a, b, k, p, low = a[may], b[may], k[may], p[may], low[may]
                high = np.minimum(np.minimum((nth[p] + 2) * block, sizes[doc[p]]) + lengths[k], sizes[doc[p]])
                yield from zip(doc[p].tolist(), k.tolist(), low.tolist(), high.tolist(), cos[a, b].tolist(), strict=True)


def scales(items: Items, space: np.ndarray) -> list[Searched]:
    out, shortest = [], 0
    for block, longest in SCALES:
        own = [p for p in items.pieces() if shortest < len(p[1]) <= longest]
        out += [Searched(own, block, space)] if own else []
        shortest = longest
    return out


def _bounded(batch: pa.RecordBatch, size: int) -> Iterator[tuple[list[int | None], list[np.ndarray]]]:
    """Ids and numbers of the documents of a batch, about `SLICE` terms at once."""
    ids, docs, held = [], [], 0
    for i, raw in zip(batch.column("doc_id").to_pylist(), batch.column("ids").to_pylist(), strict=True):
        ids.append(i)
        docs.append(_numbers(raw, size))
        held += len(docs[-1])
        if held >= SLICE:
            yield ids, docs
            ids, docs, held = [], [], 0
    if docs:
        yield ids, docs


def _search(encoded: DataFrame, items: Items, space: np.ndarray, frequency: np.ndarray, cosine: float, cuts: tuple[float, float, float]) -> DataFrame:
    size, lcs_cut, lcs_answer, answer_cut = items.size, *cuts
    exact = Verbatim([*zip(items.ids, items.numbers, strict=True), *items.short], frequency)
    held = encoded.sparkSession.sparkContext.broadcast((items.ids, items.numbers, exact, scales(items, space), space))  # bounded by ITEM_TERMS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, numbers, exact, searched, space = held.value
        lengths = [len(x) for x in numbers]
        counts = [np.unique(x, return_counts=True) for x in numbers]
        tables = [None] * len(numbers)
        need = np.array([int(np.ceil(lcs_answer * n - 1e-9)) for n in lengths], np.int64)
        possible = Possible(numbers, need, size)
        longer = np.flatnonzero(np.array(lengths) > PIECE)  # their surroundings can exceed a window
        sizes = np.array(lengths, np.int64)

        members = [frozenset(own.tolist()) for own, _ in counts]
        #: Distinct terms that must stand in a region: each that lacks costs the subsequence a term at least.
        distinct = [len(own) - int(n - lcs_answer * n + 1e-9) for (own, _), n in zip(counts, lengths, strict=True)]

        class Regions:
            """Distinct terms of stretches of a document, by whole blocks."""

            def __init__(self, doc: np.ndarray):
                self.doc, self.blocks, self.joined = doc, {}, {}

            def holds(self, k: int, low: int, high: int) -> bool:
                """The stretch, up to the ends of its blocks, has enough of an item's terms."""
                key = (low // BLOCK, -(-high // BLOCK))
                if key not in self.joined:
                    parts = []
                    for b in range(*key):
                        if b not in self.blocks:
                            self.blocks[b] = set(self.doc[b * BLOCK : (b + 1) * BLOCK].tolist())
                        parts.append(self.blocks[b])
                    self.joined[key] = set().union(*parts)
                return len(members[k] & self.joined[key]) >= distinct[k]

        def check(k: int, doc: np.ndarray, low: int, high: int) -> tuple[float, float] | None:
            """Shares of the item and of its answer, if they are enough."""
            n = lengths[k]
            tables[k] = tables[k] or lcs_table(numbers[k])
            got, at, to = best_stretch(n, tables[k], doc, low, high)
            share = got / n
            if share < lcs_answer:
                return None
            tail = numbers[k][-max(1, n // 4) :]
            answer = lcs_length(lcs_table(tail), len(tail), doc[at : to + 8].tolist()) / len(tail)
            return (share, answer) if share >= lcs_cut or answer >= answer_cut else None

        def found(doc: np.ndarray, candidates: list[tuple[int, int, int, float]]) -> list[tuple[int, float, float, float]]:
            whole = exact.found(doc)
            best: dict[int, tuple[float, float, float]] = {}
            none = (0.0, 0.0, 0.0)
            regions = Regions(doc)
            for k, low, high, cos in candidates:
                if ids[k] not in whole and best.get(k, none)[0] < 1.0 and regions.holds(k, low, high):
                    got = check(k, doc, low, high)
                    if got:
                        best[k] = max(best.get(k, none), (*got, cos))
            return [(ids[k], cos, share, answer) for k, (share, answer, cos) in best.items()] + [(i, 1.0, 1.0, 1.0) for i in sorted(whole)]

        def candidates(docs: list[np.ndarray]) -> list[list[tuple[int, int, int, float]]]:
            """(item, from, to, cosine), for each document."""
            out = [[] for _ in docs]
            if not searched:
                return out
            windows, first = possible.windows(docs)
            if len(longer):
                every = possible.held(np.repeat(np.arange(len(docs)), [len(d) for d in docs]), np.concatenate(docs), len(docs))
                windows[:, longer] = np.repeat(every[:, longer], np.diff(first), axis=0)
            any_ = np.logical_or.reduceat(windows.any(axis=1), first[:-1])
            own = np.flatnonzero(any_).tolist()
            for one in searched if own else ():
                for d, *x in one.candidates([docs[d] for d in own], space, cosine, sizes, windows, first[own]):
                    out[own[d]].append(tuple(x))
            return out

        kinds = [pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64()]
        names = ["doc_id", "item_id", "cosine", "lcs", "answer"]
        for b in slices(batches, 256):
            rows = []
            for part, docs in _bounded(b, size):
                rows += [(i, *x) for i, doc, own in zip(part, docs, candidates(docs), strict=True) for x in found(doc, own)]
            cols = list(zip(*rows, strict=True)) if rows else [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names)

    return encoded.mapInArrow(run, _FOUND)


_FOUND = "doc_id long, item_id long, cosine double, lcs double, answer double"


def contaminations(
    docs: DataFrame, benchmark: DataFrame, id_column: str = "doc_id", text: str = "text", item_column: str = "item_id", item_text: str = "text",
    cosine: float = COSINE, cuts: tuple[float, float, float] = (LCS, LCS_ANSWER, ANSWER),
) -> DataFrame:
    spark = docs.sparkSession
    rows = benchmark.select(benchmark[item_column].cast("long").alias("k"), F.coalesce(benchmark[item_text].cast("string"), F.lit("")).alias("t"))
    out = spark.createDataFrame([], _FOUND)
    block: list[tuple[int, bytes]] = []

    def add(out: DataFrame, block: list[tuple[int, bytes]]) -> DataFrame:
        items = Items(block)
        if not items.ids and not items.short:
            return out
        encoded = Written(_encoded(docs, items, id_column, text), "encoded").df
        counted = _document_frequency(encoded, items.size)
        space = latent_space(encoded, items, counted) if items.ids else np.zeros((items.size, 1), np.float32)
        return out.union(_search(encoded, items, space, counted[0], cosine, cuts))

    held = 0
    for r in rows.toLocalIterator():  # the stated query set, block by block
        block.append((r["k"], r["t"].encode()))
        held += len(block[-1][1]) // 4
        if len(block) == ITEMS or held >= ITEM_TERMS:
            out, block, held = add(out, block), [], 0
    return add(out, block) if block else out


def clean(docs: DataFrame, benchmark: DataFrame, id_column: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """Rows of `docs` without a contamination. Rows are told apart by id and a hash of the text."""
    if any(c.startswith("__") for c in docs.columns):
        raise ValueError("columns named __* can't be passed through")
    key = F.xxhash64(F.coalesce(docs[id_column].cast("long"), F.lit(-1)), docs[text].cast("string"))
    keyed = docs.select("*", key.alias("__key"))
    bad = contaminations(keyed.select(F.col("__key"), F.col(text)), benchmark, "__key", text, **options).select(F.col("doc_id").alias("__key"))
    # Written first: Spark then knows its size, and broadcasts it only below spark.sql.autoBroadcastJoinThreshold.
    return keyed.join(written(bad.distinct(), "contaminated"), "__key", "left_anti").select(*docs.columns)
