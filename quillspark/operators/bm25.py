"""BM25 (R1, R2, A1-A5, JN2-JN4, M4, M5, W1, W9) for batches of queries.

The index are three tables: postings (uid, token, tf, length), which can be stored sorted by token; term_stats (token, df,
idf); corpus_stats (n, avgdl; one row). A search touches the postings of the queries' tokens only. Filters choose among
documents but don't change the statistics.

`search` scores documents where they are: each is once reduced to the numbers and counts of the queries' tokens; frequencies
and lengths are added up from these; then a batch of documents meets a block of queries in one matrix product, and only the
k best of the batch are shuffled, not a row for each document that shares a word with a query.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspark.functions import numbers, text

K1, B = 1.5, 0.75
#: Queries that go to each task at once, and documents of a matrix: bounds of memory.
QUERY_BLOCK, DOC_BLOCK = 512, 512


@dataclass
class Index:
    postings: DataFrame
    term_stats: DataFrame
    corpus_stats: DataFrame
    k1: float = K1
    b: float = B

    def write(self, path: str) -> None:
        self.postings.repartitionByRange("token").sortWithinPartitions("token", "uid").write.mode("overwrite").parquet(f"{path}/postings")
        self.term_stats.write.mode("overwrite").parquet(f"{path}/term_stats")
        self.corpus_stats.write.mode("overwrite").parquet(f"{path}/corpus_stats")

    @staticmethod
    def read(spark: SparkSession, path: str, k1: float = K1, b: float = B) -> Index:
        return Index(*(spark.read.parquet(f"{path}/{t}") for t in ("postings", "term_stats", "corpus_stats")), k1, b)


def _check(k1: float, b: float) -> None:
    if not k1 > 0 or not 0 <= b <= 1:
        raise ValueError("k1 is positive, b is 0 to 1")


#: No token: stands for the document itself, so that one pass over the texts gives postings and lengths of all documents.
_DOCUMENT = ""


def tokenized(docs: DataFrame, stable: bool = False) -> DataFrame:
    """uid, tokens, length. stable: texts are NFKC-stable, fold them in the JVM."""
    folded = text.latin_fold(F.col("text")) if stable else text.fold(F.col("text"))
    return docs.select("uid", text.tokens(F.coalesce(folded, F.lit(""))).alias("tokens")).withColumn("length", F.size("tokens"))


def _counted(worded: DataFrame, only: DataFrame | None = None) -> DataFrame:
    """uid, token, tf, length, and a row with token _DOCUMENT for each document; only: a table of tokens to keep, joined before
    anything is counted or shuffled. explode_outer: for explode, Spark would evaluate the tokens once more to filter by them.
    """
    each = worded.select("uid", "length", F.explode_outer(F.concat("tokens", F.array(F.lit(_DOCUMENT)))).alias("token"))
    if only is not None:
        each = each.join(only.union(only.sparkSession.createDataFrame([(_DOCUMENT,)], "token string")), "token")
    return each.groupBy("uid", "token").agg(F.count("*").alias("tf"), F.first("length").alias("length"))


def _index(counted: DataFrame, k1: float, b: float) -> Index:
    corpus = counted.where(F.col("token") == _DOCUMENT).agg(F.count("*").alias("n"), F.avg("length").alias("avgdl"))  # A2
    postings = counted.where(F.col("token") != _DOCUMENT)
    return Index(postings, _term_stats(postings, corpus), corpus, k1, b)


def _term_stats(postings: DataFrame, corpus: DataFrame) -> DataFrame:
    df = postings.groupBy("token").agg(F.count("*").alias("df"))
    return df.crossJoin(corpus.select("n")).select("token", "df", numbers.idf(F.col("n"), F.col("df")).alias("idf"))  # one row


def build(docs: DataFrame, k1: float = K1, b: float = B, stable: bool = False) -> Index:
    """The whole index of a table with uid and text."""
    _check(k1, b)
    return _index(_counted(tokenized(docs, stable)), k1, b)


def query_terms(queries: DataFrame, stable: bool = False) -> DataFrame:
    """A4: query_id, token, qtf."""
    folded = text.latin_fold(F.col("query")) if stable else text.fold(F.col("query"))
    return queries.select("query_id", F.explode(text.tokens(folded)).alias("token")).groupBy("query_id", "token").agg(F.count("*").alias("qtf"))


def index_for(docs: DataFrame, terms: DataFrame, k1: float = K1, b: float = B, stable: bool = False) -> Index:
    """What of the index a batch of queries needs, straight from the documents: only the queries' tokens are counted."""
    _check(k1, b)
    counted = _counted(tokenized(docs, stable), terms.select("token").distinct())
    return _index(counted.persist(StorageLevel.MEMORY_AND_DISK), k1, b)  # read for postings, frequencies and lengths


def scores(index: Index, terms: DataFrame, eligible: DataFrame | None = None) -> DataFrame:
    """query_id, uid, score of every document with a common token (F4); eligible: uids that passed the filters (JN4)."""
    postings = index.postings if eligible is None else index.postings.join(eligible.select("uid"), "uid", "left_semi")
    hits = postings.join(index.term_stats, "token").join(terms, "token").crossJoin(index.corpus_stats.select("avgdl"))  # one row
    term = numbers.bm25_term(F.col("qtf"), F.col("idf"), F.col("tf"), F.col("length"), F.col("avgdl"), index.k1, index.b)
    return hits.groupBy("query_id", "uid").agg(F.sum(term).alias("score"))


def top_k(scored: DataFrame, k: int, score: Column | None = None) -> DataFrame:
    """query_id, uid, score, rank; by score, then uid."""
    if k <= 0:
        raise ValueError("top_k is positive")
    order = [(F.col("score") if score is None else score).desc(), F.col("uid").asc()]
    ranked = scored.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order)))
    return ranked.where(F.col("rank") <= k)


def _reduced(docs: DataFrame, vocabulary: dict[str, int], eligible: Column, stable: bool) -> DataFrame:
    """uid, length, ok, and of the vocabulary's tokens in a document: terms (their numbers) and counts, as int32."""
    known = docs.sparkSession.sparkContext.broadcast(vocabulary)  # the queries' tokens
    folded = text.latin_fold(F.col("text")) if stable else text.fold(F.col("text"))
    worded = docs.select("uid", F.coalesce(eligible, F.lit(False)).alias("ok"), text.tokens(F.coalesce(folded, F.lit(""))).alias("tokens"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = known.value.get
        for b in batches:
            lists = b.column(2)
            ends, flat = np.asarray(lists.offsets), lists.values.dictionary_encode()
            number = np.array([get(t, -1) for t in flat.dictionary.to_pylist()], np.int32)
            every = number[flat.indices.to_numpy()] if len(flat) else np.zeros(0, np.int32)
            terms, counts = [], []
            for s, e in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
                own = every[s:e]
                t, n = np.unique(own[own >= 0], return_counts=True)
                terms.append(t.astype(np.int32).tobytes())
                counts.append(n.astype(np.int32).tobytes())
            length = pa.array(np.diff(ends).astype(np.int64))
            yield pa.RecordBatch.from_arrays([b.column(0), length, b.column(1), pa.array(terms, pa.binary()), pa.array(counts, pa.binary())], ["uid", "length", "ok", "terms", "counts"])

    kind = dict(worded.dtypes)["uid"]
    return worded.mapInArrow(run, f"uid {kind}, length long, ok boolean, terms binary, counts binary")


def _frequencies(reduced: DataFrame, size: int) -> np.ndarray:
    """A3: how many documents hold each token of the vocabulary; a row a token and task is added up."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(size, np.int64)
        for b in batches:
            n += np.bincount(np.frombuffer(b"".join(b.column(0).to_pylist()), np.int32), minlength=size)
        own = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(n[own])], ["term", "n"])

    out = np.zeros(size)
    for r in reduced.select("terms").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect():
        out[r["term"]] = r["n"]
    return out


def _best(reduced: DataFrame, queries: list[tuple[object, dict[int, int]]], kind: str, idf: np.ndarray, avgdl: float, k: int, digits: int | None, k1: float, b: float) -> DataFrame:
    """query_id, uid, score: of each batch of documents the k best of each query of a block."""
    terms = sorted({t for _, own in queries for t in own})
    place = np.full(len(idf), -1, np.int64)
    place[terms] = np.arange(len(terms))
    weight = np.zeros((len(terms), len(queries)))
    for q, (_, own) in enumerate(queries):
        for t, n in own.items():
            weight[place[t], q] = n * idf[t]
    ids = [q for q, _ in queries]
    sent = reduced.sparkSession.sparkContext.broadcast((place, weight, ids))  # QUERY_BLOCK queries

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, weight, ids = sent.value
        for whole in batches:
            for at in range(0, whole.num_rows, DOC_BLOCK):
                part = whole.slice(at, DOC_BLOCK)
                n = np.array([len(x) // 4 for x in part.column(2).to_pylist()])
                term = place[np.frombuffer(b"".join(part.column(2).to_pylist()), np.int32)]
                tf = np.frombuffer(b"".join(part.column(3).to_pylist()), np.int32).astype(float)
                row = np.repeat(np.arange(len(n)), n)
                length = part.column(1).to_numpy()[row]
                here = term >= 0
                row, term, tf, length = row[here], term[here], tf[here], length[here]
                cols, inverse = np.unique(term, return_inverse=True)
                x = np.zeros((len(n), len(cols)))
                x[row, inverse] = tf * (k1 + 1) / (tf + k1 * (1.0 - b + b * length / avgdl))
                s = x @ weight[cols]
                s = s if digits is None else np.round(s, digits)
                found, q = best_rows(s, part.column(0), k, s > 0)
                yield pa.RecordBatch.from_arrays([pa.array([ids[i] for i in q.tolist()], part_type), part.column(0).take(pa.array(found)), pa.array(s[found, q])], ["query_id", "uid", "score"])

    part_type = _ARROW.get(kind, pa.string())
    return reduced.where("ok").select("uid", "length", "terms", "counts").mapInArrow(run, f"query_id {kind}, uid {dict(reduced.dtypes)['uid']}, score double")


_ARROW = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}


def best_rows(s: np.ndarray, uid: pa.Array, k: int, allowed: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the k largest of each column of s, equal ones by uid. Only what can be among them is sorted."""
    rows, columns = s.shape
    masked = s if allowed is None else np.where(allowed, s, -np.inf)
    if rows > k:
        least = np.partition(masked, rows - k, axis=0)[rows - k]
        row, column = np.nonzero((masked >= least) & (masked > -np.inf))
    else:
        row, column = np.nonzero(masked > -np.inf)
    own = uid.take(pa.array(np.unique(row)))
    order = np.empty(rows, np.int64)
    order[np.unique(row)[pa.compute.sort_indices(own).to_numpy()]] = np.arange(len(own))
    sort = np.lexsort((order[row], -masked[row, column], column))
    row, column = row[sort], column[sort]
    nth = np.arange(len(column)) - np.searchsorted(column, column)
    return row[nth < k], column[nth < k]


def search(
    docs: DataFrame, queries: DataFrame, k: int = 10, filter_: Column | None = None, digits: int | None = None, stable: bool = False,
    unique: bool = False, k1: float = K1, b: float = B,
) -> DataFrame:
    """query_id, uid, score, rank. digits: scores are rounded before they are ranked, for comparison across engines. unique: uids
    are known to be; otherwise of repeated ones the first counts (W9)."""
    if k <= 0:
        raise ValueError("top_k is positive")
    _check(k1, b)
    spark = docs.sparkSession
    asked: dict[object, dict[str, int]] = {}
    for r in query_terms(queries, stable).toLocalIterator():  # the stated queries
        asked.setdefault(r["query_id"], {})[r["token"]] = r["qtf"]
    vocabulary = {t: i for i, t in enumerate(sorted({t for own in asked.values() for t in own}))}
    kind, uid = dict(queries.dtypes)["query_id"], dict(docs.dtypes)["uid"]
    eligible = F.lit(True) if filter_ is None else filter_
    reduced = _reduced(docs if unique else deduplicated(docs), vocabulary, eligible, stable).persist(StorageLevel.MEMORY_AND_DISK)
    stats = reduced.agg(F.count("*").alias("n"), F.avg("length").alias("avgdl")).first()
    df = _frequencies(reduced, len(vocabulary))
    idf = np.log(1.0 + (stats["n"] - df + 0.5) / (df + 0.5))
    numbered = [(q, {vocabulary[t]: n for t, n in own.items()}) for q, own in sorted(asked.items(), key=str)]
    found = spark.createDataFrame([], f"query_id {kind}, uid {uid}, score double")
    for at in range(0, len(numbered) if stats["n"] else 0, QUERY_BLOCK):
        found = found.union(_best(reduced, numbered[at : at + QUERY_BLOCK], kind, idf, stats["avgdl"] or 1.0, k, digits, k1, b))
    return top_k(found, k)


def deduplicated(docs: DataFrame) -> DataFrame:
    """Each uid once: the first by case, number and text. Only rows whose uid is repeated are ranked."""
    repeated = docs.groupBy("uid").count().where("count > 1").select("uid")
    order = [c for c in ("case_id", "paragraph_number", "text") if c in docs.columns]
    first = F.row_number().over(Window.partitionBy("uid").orderBy(*order))
    some = docs.join(repeated, "uid", "left_semi").withColumn("__n", first).where("__n = 1").drop("__n")
    return docs.join(repeated, "uid", "left_anti").select(*docs.columns).union(some.select(*docs.columns))
