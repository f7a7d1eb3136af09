"""Vector and text retrieval."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from granary.functions.tokens import total
from granary.session import pinned


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def normalise(vector: Column) -> Column:
    """At length 1; a vector of zeros stays one. The norm is an array's only element, so that it is computed once a row."""
    norms = F.array(F.sqrt(dot(vector, vector)))
    return F.transform(norms, lambda norm: F.transform(vector, lambda x: F.when(norm == 0, 0.0).otherwise(x / norm)))[0]


def mean_pool(vectors: DataFrame, group: str, vector: str, size: int) -> DataFrame:
    """The element-wise mean of each group's vectors."""
    means = [F.avg(F.element_at(vector, i + 1).cast("double")) for i in range(size)]
    return vectors.groupBy(group).agg(F.array(*means).alias(vector))


def dense_topk(queries: DataFrame, corpus: DataFrame, k: int, query_id: str, doc_id: str, vector: str, most: int = 4_000_000) -> DataFrame:
    """(query_id, doc_id, score, rank): the k largest inner products, ties (to 12 places) to the smaller id.

    Queries are a stated set, taken in blocks of at most ``most`` numbers (32 MB), each a matrix that
    is broadcast and meets the corpus batch by batch. A partition keeps its own k best for each query.
    """
    asked = queries.select(F.col(query_id).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v")).where("v is not null")
    numbers = asked.agg(F.sum(F.size("v"))).first()[0] or 0
    blocks = max(1, -(-numbers // max(most, 1)))
    spread = corpus.select(F.col(doc_id).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v")).where("v is not null")
    best = None
    for block in range(blocks):
        rows = asked.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == block).orderBy("id").collect()  # about `most` numbers
        shared = queries.sparkSession.sparkContext.broadcast((np.array([r["id"] for r in rows], np.int64), np.array([r["v"] for r in rows], float)))
        found = spread.mapInArrow(_nearest(shared, k), "query_id long, id long, score double")
        best = found if best is None else best.unionByName(found)
    return _ranked(best, k, doc_id)


class _Best:
    """The k best of each query so far, ties to the smaller id."""

    schema = pa.schema([("query_id", pa.int64()), ("id", pa.int64()), ("score", pa.float64())])

    def __init__(self, asked: np.ndarray, k: int):
        self.asked, self.k = asked, k
        self.query, self.ids, self.scores = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)

    def take(self, own: np.ndarray, met: np.ndarray) -> None:
        """``met``: a row of scores for each id, a column for each query; -inf where nothing was found."""
        k = self.k
        bar = np.partition(met, len(own) - k, axis=0)[len(own) - k] if len(own) > k else np.full(len(self.asked), -np.inf)
        row, column = np.nonzero((met >= bar) & (met > -np.inf))  # k of each query, and ties
        query, ids, scores = np.concatenate([self.query, column]), np.concatenate([self.ids, own[row]]), np.concatenate([self.scores, met[row, column]])
        order = np.lexsort((ids, -scores, query))
        query, ids, scores = query[order], ids[order], scores[order]
        kept = np.arange(len(query)) - np.searchsorted(query, query, side="left") < k
        self.query, self.ids, self.scores = query[kept], ids[kept], scores[kept]

    def batch(self) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(self.asked[self.query]), pa.array(self.ids), pa.array(self.scores)], schema=self.schema)


def _ranked(best: DataFrame, k: int, doc_id: str) -> DataFrame:
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("id").alias(doc_id), "score", "rank")


def _nearest(shared, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, points = shared.value
        if not len(asked):
            return
        best = _Best(asked, k)
        for whole in batches:
            for at in range(0, whole.num_rows, 2000):
                batch = whole.slice(at, 2000)
                best.take(batch.column(0).to_numpy(zero_copy_only=False), np.round(np.array(batch.column(1).to_pylist(), float) @ points.T, 12))
        yield best.batch()

    return run


def bm25_topk(queries: DataFrame, docs: DataFrame, k: int, query_id: str, doc_id: str, text: str, k1: float = 0.9, b: float = 0.4, most: int = 4_000_000) -> DataFrame:
    """(query_id, doc_id, score, rank) by BM25 over lower-cased words, each query word counted once.

    Queries are a stated set, taken in blocks whose distinct words times queries stay at most
    ``most`` or of one query; a block's words meet the texts as they are read, first to count in
    how many each occurs and then to score. A partition keeps its own k best for each query, so
    that neither a frequent word nor a query's many matches are shuffled.
    """
    words = F.array_distinct(F.array_remove(F.split(F.lower(F.col(text)), r"\s+"), ""))
    asked = pinned(queries.select(F.col(query_id).cast("long").alias("id"), words.alias("words")).where("size(words) > 0"))
    n, terms = asked.agg(F.count("*"), F.sum(F.size("words"))).first()
    blocks = max(1, math.ceil(math.sqrt((n or 0) * (terms or 0) / max(most, 1))))
    sized = docs.select(F.col(doc_id).cast("long").alias("id"), F.lower(F.col(text)).cast("binary").alias("text")).where("text is not null")
    spark, best = queries.sparkSession, None
    for block in range(blocks):
        rows = asked.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == block).orderBy("id").collect()  # a block of the stated set
        names = {w.encode(): i for i, w in enumerate(sorted({w for r in rows for w in r["words"]}))}
        uses = np.zeros((len(names), len(rows)))
        for q, r in enumerate(rows):
            uses[[names[w.encode()] for w in r["words"]], q] = 1.0
        held = spark.sparkContext.broadcast(names)
        counts = {r["term"]: r["n"] for r in sized.mapInArrow(_occurrences(held), "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()}  # a row per word asked for
        texts = counts.get(-1, 0)
        df = np.array([counts.get(i, 0) for i in range(len(names))], float)
        idf = np.log(1 + (texts - df + 0.5) / (df + 0.5))
        shared = spark.sparkContext.broadcast((names, np.array([r["id"] for r in rows], np.int64), uses * idf[:, None], counts.get(-2, 0) / max(texts, 1)))
        found = sized.mapInArrow(_relevant(shared, k, k1, b), "query_id long, id long, score double")
        best = found if best is None else best.unionByName(found)
    return _ranked(best, k, doc_id)


def _occurrences(held):
    """Per word asked for the number of texts that have it; -1: of texts with any word, -2: of all words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, df, texts, total = held.value, Counter(), 0, 0
        for batch in batches:
            for text in batch.column(1):
                words = text.as_py().split()
                texts, total = texts + (len(words) > 0), total + len(words)
                df.update(names.keys() & words)
        found = [(names[w], n) for w, n in df.items()] + [(-1, texts), (-2, total)]
        yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.int32()), pa.array([f[1] for f in found], pa.int64())], names=["term", "n"])

    return run


def _relevant(shared, k: int, k1: float, b: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, asked, weights, mean = shared.value
        if not len(asked):
            return
        best = _Best(asked, k)
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                batch = whole.slice(at, 1000)
                met = np.full((batch.num_rows, len(asked)), -np.inf)
                for row, text in enumerate(batch.column(1)):
                    words = text.as_py().split()
                    tf = Counter(filter(names.__contains__, words))
                    if tf:
                        n = np.fromiter(tf.values(), float, len(tf))
                        gain = n * (k1 + 1) / (n + k1 * (1 - b + b * len(words) / mean))
                        met[row] = gain @ weights[[names[w] for w in tf]]
                met = np.round(met, 9)
                met[met <= 0] = -np.inf  # no word in common
                best.take(batch.column(0).to_numpy(zero_copy_only=False), met)
        yield best.batch()

    return run
