"""Toxicity scoring with subword-bag embeddings and a linear softmax.

A word is the bag of its character n-grams (3 to 5, with word edges, and the
whole word), hashed to ``BUCKETS`` embeddings; a passage of about
``PASSAGE`` words is the mean of its words' means; a softmax over it gives the
passage's class, and a document takes its most toxic passage. Embeddings and
softmax are trained jointly, in numpy, by mini-batch Adagrad; unseen spellings
share their n-grams' vectors. The softmax being linear, a trained word has one
log-odds, which scoring keeps in a bounded memo.

Training takes at most ``sample`` labelled rows of each class, the first by a
hash of the id, with whole texts and of them no more than ``most_bytes`` in all;
the class rates come from all labelled training rows and correct the intercept.

Defined results: null and blank texts score the rate of the class, as do all
texts if no row is labelled with both classes; rows without label don't train;
repeated rows are scored each for itself; further columns are ignored or, in
:func:`keep_clean`, kept.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.llm.workers import held
from granary.session import pinned

BUCKETS = 1 << 16
DIMENSIONS = 8
PASSAGE = 3
SAMPLE = 3000
MOST_BYTES = 128 << 20
THRESHOLD = 0.7
EPOCHS = 20
EDGES = ".,;:!?*#%&$\"'()[]{}<>|/\\-_=+~`^@…«»“”‘’¿¡"
MEMO = 400_000


def grams(word: str) -> list[int]:
    """The buckets of a word's n-grams."""
    edged = f"<{word}>"
    found = [zlib.crc32(edged.encode("utf-8", "surrogatepass"))]
    found += [zlib.crc32(edged[i : i + n].encode("utf-8", "surrogatepass")) for n in (3, 4, 5) for i in range(len(edged) - n + 1)]
    return [h & (BUCKETS - 1) for h in found]


def words_of(text: str) -> list[str]:
    """Lower-cased words without the marks at their edges."""
    return [w for w in (x.strip(EDGES) for x in text.lower().split()) if w]


def bounds(n: int) -> np.ndarray:
    """Offsets of near-equal passages of n words."""
    return np.linspace(0, n, max(1, -(-n // PASSAGE)) + 1).astype(np.int64)[:-1]


class Model:
    """embeddings (BUCKETS x d), softmax weights (d x 2) and intercepts (2); prior is the class's rate."""

    def __init__(self, embeddings, weights, intercepts, prior: float):
        self.embeddings, self.weights, self.intercepts, self.prior = embeddings, weights, intercepts, prior
        self.key = uuid.uuid4().hex  # names it in the workers' caches

    def scorer(self) -> Scorer:
        return Scorer(self)


class Scorer(dict):
    """Log-odds of words, of which a bounded number are kept."""

    def __init__(self, model: Model):
        super().__init__()
        self.prior = model.prior
        self.odds = None if model.embeddings is None else (model.embeddings @ (model.weights[:, 1] - model.weights[:, 0])).astype(np.float64)
        self.base = 0.0 if model.embeddings is None else float(model.intercepts[1] - model.intercepts[0])

    def __missing__(self, word: str) -> float:
        value = float(self.odds[grams(word)].mean())
        if len(word) <= 40:
            if len(self) >= MEMO:
                self.clear()
            self[word] = value
        return value

    def score(self, text: str) -> float:
        words = words_of(text) if self.odds is not None else []
        if not words:
            return self.prior
        odds = np.fromiter(map(self.__getitem__, words), np.float64, len(words))
        starts = bounds(len(words))
        means = np.add.reduceat(odds, starts) / np.diff(np.append(starts, len(words)))
        return float(1 / (1 + np.exp(-np.clip(means.max() + self.base, -30, 30))))


def train(texts: list[str], labels: np.ndarray, prior: float, epochs: int = EPOCHS, seed: int = 7, rate: float = 0.6) -> Model:
    """Fit on labelled texts; ``prior`` is the rate of label 1 among all labelled rows."""
    draw = np.random.default_rng(seed)
    names: dict[str, int] = {}
    docs = [np.array([names.setdefault(w, len(names)) for w in words_of(t)], np.int64) for t in texts]
    kept = [k for k, d in enumerate(docs) if len(d)]
    docs, labels = [docs[k] for k in kept], np.asarray(labels, np.int64)[kept]
    if not len(docs) or labels.min() == labels.max():
        return Model(None, None, None, prior)
    bags = [np.array(grams(w), np.int32) for w in names]
    lengths = np.array([len(b) for b in bags])
    flat, first = np.concatenate(bags), np.concatenate([[0], np.cumsum(lengths)])
    embeddings = draw.uniform(-0.5, 0.5, (BUCKETS, DIMENSIONS)).astype(np.float32) / DIMENSIONS
    weights = draw.standard_normal((DIMENSIONS, 2)).astype(np.float32) * 0.5
    intercepts = np.zeros(2, np.float32)
    seen, seen_w, seen_i = np.full(BUCKETS, 1e-8, np.float32), np.full((DIMENSIONS, 2), 1e-8, np.float32), np.full(2, 1e-8, np.float32)
    for epoch in range(epochs):
        order = draw.permutation(len(docs))
        for at in range(0, len(order), 256):
            batch = order[at : at + 256]
            words = np.concatenate([docs[k] for k in batch])
            sizes = np.array([len(docs[k]) for k in batch])
            offsets = np.concatenate([[0], np.cumsum(sizes)])
            odds = embeddings @ (weights[:, 1] - weights[:, 0])
            own, where = np.unique(words, return_inverse=True)
            spans = _rows(first[own], lengths[own])
            word_odds = np.add.reduceat(odds[flat[spans]], np.concatenate([[0], np.cumsum(lengths[own])[:-1]])) / lengths[own]
            passages = [bounds(n) for n in sizes]
            starts = np.concatenate([p + o for p, o in zip(passages, offsets, strict=False)])
            ends = np.append(starts[1:], len(words))
            means = np.add.reduceat(word_odds[where], starts) / (ends - starts)
            # Each document's most toxic passage carries its gradient.
            best, k = np.zeros(len(batch), np.int64), 0
            for d, p in enumerate(passages):
                best[d] = k + int(np.argmax(means[k : k + len(p)]))
                k += len(p)
            a, n = starts[best], (ends - starts)[best]
            chosen = words[_rows(a, n)]
            doc_of = np.repeat(np.arange(len(batch)), n)
            gram = flat[_rows(first[chosen], lengths[chosen])]
            share = np.repeat(1 / (lengths[chosen] * n[doc_of]), lengths[chosen]).astype(np.float32)
            of = np.repeat(doc_of, lengths[chosen])
            edges = np.concatenate([[0], np.flatnonzero(np.diff(of)) + 1])
            hidden = np.add.reduceat(embeddings[gram] * share[:, None], edges)
            logits = hidden @ weights + intercepts
            p = np.exp(logits - logits.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            slope = p - np.eye(2, dtype=np.float32)[labels[batch]]
            back = slope @ weights.T
            hit, place = np.unique(gram, return_inverse=True)
            step = np.stack([np.bincount(place, back[of, d] * share, len(hit)) for d in range(DIMENSIONS)], axis=1).astype(np.float32)
            seen[hit] += (step * step).mean(axis=1)
            embeddings[hit] -= rate * step / np.sqrt(seen[hit])[:, None]
            for value, total, move in ((weights, seen_w, hidden.T @ slope), (intercepts, seen_i, slope.sum(axis=0))):
                total += move * move
                value -= 0.1 * move / np.sqrt(total)
    rate_here = labels.mean()
    intercepts = intercepts.astype(np.float64)
    intercepts[1] += np.log(prior / (1 - prior)) - np.log(rate_here / (1 - rate_here))
    return Model(embeddings, weights, intercepts, prior)


def _rows(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    return np.arange(lengths.sum()) + np.repeat(starts - np.concatenate([[0], np.cumsum(lengths)[:-1]]), lengths)


def remainder(id_col: str | Column, by: int) -> Column:
    """crc32 of the id as text, modulo ``by``; a missing id leaves 0."""
    col = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.coalesce(F.pmod(F.crc32(col.cast("string").cast("binary")), F.lit(by)), F.lit(0))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = SAMPLE, most_bytes: int = MOST_BYTES) -> Model:
    """Train on labelled rows whose id's remainder by 3 isn't 1."""
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).where("id is not null and y in (0, 1)")
    known = known.where(remainder("id", 3) != 1).groupBy("id").agg(F.max("y").alias("y"))
    counts = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    prior = (counts.get(1, 0) + 0.5) / (sum(counts.values()) + 1)
    drawn = [known.where(F.col("y") == y).orderBy(F.xxhash64("id"), "id").limit(sample) for y in (0, 1)]
    chosen = drawn[0].unionByName(drawn[1])  # at most 2 * sample rows
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("text is not null").join(F.broadcast(chosen), "id")
    texts = pinned(texts.select("id", "text", "y", F.octet_length("text").alias("held"), F.xxhash64("id", "text").alias("place")))
    held, within = 0, []
    for r in texts.select("place", "held").orderBy("place").collect():
        held += r["held"]
        if held <= most_bytes:
            within.append(r["place"])
    last = within[-1] if within else -(1 << 63)
    rows = sorted((r["id"], r["text"], r["y"]) for r in texts.where(F.col("place") <= last).select("id", "text", "y").collect())
    return train([r[1] for r in rows], np.array([r[2] for r in rows], np.int64), prior)


def _score_texts(model, texts: pa.Array) -> list[float]:
    scorer = held(model.value.key, model.value.scorer)
    return [scorer.score(t.as_py() or "") for t in texts]


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("score", pa.float64()), ("predicted", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = _score_texts(shared, batch.column(2))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.float64()), pa.array([int(s >= threshold) for s in found], pa.int32())], schema=schema)

    chosen = docs.select(F.col(id_col).cast("long").alias("doc_id"), (remainder(id_col, 3) == 1).alias("held_out"), F.col(text_col).alias("text"))
    return chosen.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def keep_clean(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The input's rows, with its columns, that score below the threshold."""
    shared, at = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array([s < threshold for s in _score_texts(shared, batch.column(at))], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
