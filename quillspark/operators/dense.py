"""Dense retrieval (R3, R8, R9, M8, W2, S12-S14): exact cosine top-k over unit vectors, for batches of queries.

`search` multiplies blocks: a batch of documents with all query vectors of a block, in an Arrow function, and keeps each
batch's k best a query, so k rows a query and task are shuffled, not the product. `search_expression` is the same by
built-in functions, for comparison.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions import numbers
from quillspark.operators.bm25 import best_rows, top_k

#: Query vectors that go to each task at once: a bound of what is sent.
QUERY_BLOCK = 4096
#: Vectors that meet them at once.
BATCH_ROWS = 1024


class Embedder(Protocol):
    """Texts to unit vectors; runs on executors."""

    dimension: int

    def embed(self, texts: list[str]) -> np.ndarray: ...


class HashingEmbedder:
    """A deterministic stand-in: signed hashes of words."""

    def __init__(self, dimension: int = 64):
        self.dimension = dimension

    def embed(self, texts: list[str]) -> np.ndarray:
        from zlib import crc32

        out = np.zeros((len(texts), self.dimension), np.float32)
        for row, t in zip(out, texts, strict=True):
            for w in t.lower().split():
                h = crc32(w.encode())
                row[h % self.dimension] += 1 if h >> 31 else -1
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)


def embed(docs: DataFrame, embedder: Embedder, keep: tuple[str, ...] = ("uid",), text: str = "text") -> DataFrame:
    """The columns of `keep` and embedding; a batch at a time."""
    kept = docs.select(*keep, F.coalesce(docs[text], F.lit("")).alias("__t"))
    n = len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = embedder.embed(b.column(n).to_pylist()).astype(np.float32)
            if v.shape != (b.num_rows, embedder.dimension):
                raise ValueError("the embedder's vectors have another dimension")
            lists = pa.ListArray.from_arrays(np.arange(0, v.size + 1, embedder.dimension, dtype=np.int32), v.ravel())
            yield pa.RecordBatch.from_arrays([*b.columns[:n], lists], [*b.schema.names[:n], "embedding"])

    shape = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields[:n])
    return kept.mapInArrow(run, f"{shape}, embedding array<float>")


def bad_vectors(points: DataFrame, dimension: int) -> DataFrame:
    """Points whose vector is null, has another dimension, or isn't a unit vector."""
    v = F.col("embedding")
    return points.where(v.isNull() | (F.size(v) != dimension) | (F.abs(numbers.dot(v, v) - 1) > 1e-3))


def upsert(points: DataFrame, new: DataFrame, key: str = "uid") -> DataFrame:
    """New points replace stored ones of the same id. The ids of `new` are unique (`latest` makes them so)."""
    return points.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def latest(new: DataFrame, order: str, key: str = "uid") -> DataFrame:
    """Of points with the same id the last in `order`."""
    last = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))
    return new.withColumn("__n", last).where("__n = 1").drop("__n")


def search_expression(points: DataFrame, queries: DataFrame, k: int = 10, filter_: Column | None = None, digits: int | None = None) -> DataFrame:
    """query_id, uid, score, rank; queries: query_id, vector. The query set meets all points."""
    eligible = points if filter_ is None else points.where(filter_)
    scored = eligible.crossJoin(queries).select("query_id", "uid", numbers.dot(F.col("embedding"), F.col("vector")).alias("score"))
    if digits is not None:
        scored = scored.withColumn("score", F.round("score", digits))
    return top_k(scored, k)


def search(points: DataFrame, queries: DataFrame, k: int = 10, filter_: Column | None = None, digits: int | None = None) -> DataFrame:
    """The same, by blocks: the stated queries, QUERY_BLOCK at a time, against all points."""
    if k <= 0:
        raise ValueError("top_k is positive")
    eligible = (points if filter_ is None else points.where(filter_)).select("uid", "embedding")
    found = None
    block: list = []

    def one(rows: list) -> DataFrame:
        ids = [r["query_id"] for r in rows]
        matrix = np.array([r["vector"] for r in rows], np.float64)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if not b.num_rows:
                    continue
                v = np.asarray(b.column(1).flatten().to_numpy(zero_copy_only=False), np.float64).reshape(b.num_rows, -1)
                for at in range(0, b.num_rows, BATCH_ROWS):
                    s, uid = v[at : at + BATCH_ROWS] @ matrix.T, b.column(0).slice(at, BATCH_ROWS)
                    s = s if digits is None else np.round(s, digits)
                    once = uid.dictionary_encode()
                    if len(once.dictionary) < len(uid):  # W2: of a repeated point the best counts
                        own = once.indices.to_numpy()
                        order = np.argsort(own, kind="stable")
                        s, uid = np.maximum.reduceat(s[order], np.searchsorted(own[order], np.arange(len(once.dictionary))), axis=0), once.dictionary
                    row, q = best_rows(s, uid, k)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([ids[i] for i in q.tolist()]), uid.take(pa.array(row)), pa.array(s[row, q])], ["query_id", "uid", "score"]
                    )

        kind = {f.name: f.dataType.simpleString() for f in (*queries.schema.fields, *eligible.schema.fields)}
        return eligible.mapInArrow(run, f"query_id {kind['query_id']}, uid {kind['uid']}, score double")

    for r in queries.select("query_id", "vector").toLocalIterator():
        block.append(r)
        if len(block) == QUERY_BLOCK:
            found, block = one(block) if found is None else found.union(one(block)), []
    if block or found is None:
        if not block:
            return top_k(queries.select("query_id", F.lit(None).alias("uid"), F.lit(0.0).alias("score")).limit(0), k)
        found = one(block) if found is None else found.union(one(block))
    return top_k(found.groupBy("query_id", "uid").agg(F.max("score").alias("score")), k)


