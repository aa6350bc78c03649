"""Token-id files: fixed-size blocks of ids, transposed into byte or bit planes, each plane compressed with zstandard,
and a chunk index behind them.

A file (all integers little-endian):

    b"TOKPLN01"
    chunk payloads, one after another: for each plane u32 length, then a zstandard frame
    index: for each document i64 id (-2**63: null), u64 ids before it in this file, u64 ids of it; zstandard-compressed
    chunk index: for each chunk u64 offset in the file, u32 ids in it, u32 bytes
    footer: u64 offset of the document index, u32 its bytes, u64 documents, u64 offset of the chunk index, u32 chunks,
            u32 ids a block, u8 bits a plane (1 or 8), u8 planes, u64 ids, b"TOKPLN01"

A chunk is one block of `block_ids` ids (the last of a file may be shorter), so a reader seeks to any id by the chunk
index. As many planes are stored as the largest id of the tokenizer's vocabulary, or the end id, needs (two byte planes below
65,536, three below 16,777,216); where `planes` is given, an id that needs more raises ValueError, so nothing is lost. Files are written under a name of their own and then renamed, so a task that is lost or
runs twice leaves no half file under a final name; what counts is the manifest that the write returns.

`write_token_files(docs, path)`: range-partitions by id, sorts, encodes and writes; returns a manifest (a row for each
file). Documents with equal ids stand side by side, in the order of their texts; null ids come first. Null and empty
texts have the end id only. A file is written block by block: memory is bounded by one text and the index of a file.
`read_token_files(spark, manifest)`: a row for each document in the files: doc_id, start (ids of all documents before it
in all files), n_tokens, ids (u32 little-endian). Files are read in blocks too. An empty table gives no rows.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm.tokens import encoder
from quillspark.llm.words import slices

MAGIC = b"TOKPLN01"
FOOTER = struct.Struct("<QIQQIIBBQ8s")
BLOCK_IDS = 1 << 16
NO_ID = -(2**63)
LEVEL = 1


def planes_for(largest: int, bits: int) -> int:
    """Planes that ids up to the largest need."""
    return max(1, -(-largest.bit_length() // bits))


def to_planes(ids: np.ndarray, bits: int, planes: int) -> list[bytes]:
    """Byte planes (bits 8: plane k has byte k of each id) or bit planes (bits 1: plane k has bit k, 8 ids a byte)."""
    if bits == 8:
        table = ids.astype("<u4").view(np.uint8).reshape(-1, 4)
        return [table[:, k].tobytes() for k in range(planes)]
    return [np.packbits(((ids >> np.uint32(k)) & np.uint32(1)).astype(np.uint8), bitorder="little").tobytes() for k in range(planes)]


def from_planes(planes: list[bytes], bits: int, n: int) -> np.ndarray:
    out = np.zeros(n, np.uint32)
    for k, plane in enumerate(planes):
        raw = np.frombuffer(plane, np.uint8)
        raw = raw if bits == 8 else np.unpackbits(raw, bitorder="little", count=n)
        out |= raw.astype(np.uint32) << np.uint32(bits * k)
    return out


class Writer:
    """Writes one file to a binary stream, block by block."""

    def __init__(self, out, bits: int = 8, planes: int = 4, block_ids: int = BLOCK_IDS):
        self.out, self.bits, self.planes, self.block_ids = out, bits, planes, block_ids
        self.at, self.buffer, self.held, self.n_ids = 0, [], 0, 0
        self.docs, self.chunks = [], []
        self.zstd = zstandard.ZstdCompressor(level=LEVEL)
        self._put(MAGIC)

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.docs.append((NO_ID if doc_id is None else doc_id, self.n_ids, len(ids)))
        self.n_ids += len(ids)
        self.buffer.append(ids)
        self.held += len(ids)
        if self.held >= self.block_ids:
            every = np.concatenate(self.buffer)
            full = len(every) // self.block_ids * self.block_ids
            for k in range(0, full, self.block_ids):
                self._chunk(every[k : k + self.block_ids])
            self.buffer, self.held = [every[full:]], len(every) - full

    def _chunk(self, ids: np.ndarray) -> None:
        if len(ids) and int(ids.max()) >> (self.bits * self.planes):
            raise ValueError("an id needs more planes")
        frames = [self.zstd.compress(p) for p in to_planes(ids, self.bits, self.planes)]
        data = b"".join(struct.pack("<I", len(f)) + f for f in frames)
        self.chunks.append((self.at, len(ids), len(data)))
        self._put(data)

    def close(self) -> None:
        if self.held:
            self._chunk(np.concatenate(self.buffer))
        docs = np.array(self.docs, "<i8").reshape(-1, 3)
        index, docs_at = self.zstd.compress(docs.tobytes()), self.at
        self._put(index)
        chunks_at = self.at
        self._put(b"".join(struct.pack("<QII", *c) for c in self.chunks))
        self._put(FOOTER.pack(docs_at, len(index), len(docs), chunks_at, len(self.chunks), self.block_ids, self.bits, self.planes, self.n_ids, MAGIC))


class Reader:
    """Random access by the chunk index; `fetch(at, size)` gives bytes of the file."""

    def __init__(self, fetch, size: int):
        self.fetch = fetch
        foot = FOOTER.unpack(fetch(size - FOOTER.size, FOOTER.size))
        docs_at, docs_len, n_docs, chunks_at, n_chunks, self.block_ids, self.bits, self.planes, self.n_ids, magic = foot
        if magic != MAGIC or fetch(0, len(MAGIC)) != MAGIC:
            raise ValueError("not a token file")
        self.zstd = zstandard.ZstdDecompressor()
        raw = self.zstd.decompress(fetch(docs_at, docs_len), max_output_size=max(1, n_docs * 24))
        self.docs = np.frombuffer(raw, "<i8").reshape(-1, 3)
        self.chunks = [struct.unpack_from("<QII", raw, 16 * k) for raw in [fetch(chunks_at, 16 * n_chunks)] for k in range(n_chunks)]

    def chunk(self, k: int) -> np.ndarray:
        at, n, size = self.chunks[k]
        data, planes, p = self.fetch(at, size), [], 0
        for _ in range(self.planes):
            (length,) = struct.unpack_from("<I", data, p)
            planes.append(self.zstd.decompress(data[p + 4 : p + 4 + length], max_output_size=n))
            p += 4 + length
        return from_planes(planes, self.bits, n)

    def ids(self, start: int, n: int) -> np.ndarray:
        """Any run of ids, reading only the chunks that hold it."""
        if not n:
            return np.zeros(0, np.uint32)
        first, last = start // self.block_ids, (start + n - 1) // self.block_ids
        every = np.concatenate([self.chunk(k) for k in range(first, last + 1)])
        return every[start - first * self.block_ids :][:n]

    def documents(self) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """(id, ids before it in this file, its ids), in order, with a chunk at a time."""
        k, rest = 0, np.zeros(0, np.uint32)
        for doc_id, start, n in self.docs.tolist():
            parts, have = [rest], len(rest)
            while have < n:
                parts.append(self.chunk(k))
                have += len(parts[-1])
                k += 1
            every = np.concatenate(parts) if len(parts) > 1 else rest
            rest = every[n:]
            yield (None if doc_id == NO_ID else doc_id), start, every[:n]


def _open(path: str):
    from pyarrow import fs

    where, inner = fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")
    return where, inner


def write_token_files(
    docs: DataFrame, path: str, tokenizer: str, end_id: int, id_column: str = "doc_id", text: str = "text",
    bits: int = 8, planes: int | None = None, block_ids: int = BLOCK_IDS,
) -> list[dict]:
    """Writes the files and returns the manifest in order: file, size, n_docs, n_tokens, start."""
    where, inner = _open(path)
    where.create_dir(inner, recursive=True)
    planes = planes or planes_for(max(encoder(tokenizer).largest_id(), end_id), bits)
    rows = docs.select(docs[id_column].cast("long").alias("i"), F.coalesce(docs[text].cast("string"), F.lit("")).alias("t"))
    ordered = rows.repartitionByRange(F.col("i").asc_nulls_first()).sortWithinPartitions(F.col("i").asc_nulls_first(), "t")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        where, inner = _open(path)
        name = f"part-{TaskContext.get().partitionId():06d}"
        own = f"{inner}/.{name}.{uuid.uuid4().hex}"
        enc, end = encoder(tokenizer), np.array([end_id], np.uint32)
        writer, out = None, None
        for b in slices(batches):
            if writer is None and b.num_rows:
                out = where.open_output_stream(own)
                writer = Writer(out, bits, planes, block_ids)
            for i, ids in zip(b.column(0).to_pylist(), enc.encode(b.column(1).to_pylist()), strict=True):
                writer.add(i, np.concatenate([np.frombuffer(ids, np.uint32), end]))
        if writer is not None:
            writer.close()
            out.close()
            size = where.get_file_info(own).size
            final = f"{inner}/{name}-{uuid.uuid4().hex[:8]}.tok"
            where.move(own, final)
            done = {"part": [TaskContext.get().partitionId()], "file": [final.rsplit("/", 1)[1]], "size": [size], "n_docs": [len(writer.docs)], "n_tokens": [writer.n_ids]}
            yield pa.RecordBatch.from_pydict(done, schema=pa.schema([("part", pa.int64()), ("file", pa.string()), ("size", pa.int64()), ("n_docs", pa.int64()), ("n_tokens", pa.int64())]))

    found = ordered.mapInArrow(write, "part long, file string, size long, n_docs long, n_tokens long").collect()  # a row for each file
    found.sort(key=lambda r: r["part"])
    starts = accumulate([r["n_tokens"] for r in found], initial=0)
    return [{"file": r["file"], "size": r["size"], "n_docs": r["n_docs"], "n_tokens": r["n_tokens"], "start": s} for r, s in zip(found, starts, strict=False)]


def read_token_files(spark: SparkSession, path: str, manifest: list[dict]) -> DataFrame:
    """doc_id, start, n_tokens, ids (binary) from the files of a manifest."""
    schema = "file string, size long, n_docs long, n_tokens long, start long"
    rows = [(m["file"], m["size"], m["n_docs"], m["n_tokens"], m["start"]) for m in manifest]
    files = spark.createDataFrame(rows, schema).repartition(max(1, len(rows)), "file")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, inner = _open(path)
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary()]
        names = ["doc_id", "start", "n_tokens", "ids"]
        for b in batches:
            for m in b.to_pylist():
                with where.open_input_file(f"{inner}/{m['file']}") as f:
                    held, weight = [], 0

                    def fetch(at: int, size: int, f=f) -> bytes:
                        f.seek(at)
                        return f.read(size)

                    for doc_id, start, ids in Reader(fetch, m["size"]).documents():
                        held.append((doc_id, m["start"] + start, len(ids), ids.astype("<u4").tobytes()))
                        weight += 4 * len(ids)
                        if weight > 8 << 20 or len(held) >= 2048:
                            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held, strict=True), kinds, strict=True)], names)
                            held, weight = [], 0
                    if held:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held, strict=True), kinds, strict=True)], names)

    return files.mapInArrow(read, "doc_id long, start long, n_tokens long, ids binary")
