"""Language-model scoring with a hashed maximum-entropy model.

Every token (words, lower-cased in ASCII, and one end per text) belongs to a
class, and ``P(token | history) = P(class | history) * P(token | class)``. The
class factor is a softmax over hashed features of the history: the word before,
the word before that (a skip), the classes of both together, those of the two
words before them (a skip of two), and none (the intercept). The
token factor is the smoothed share ``(c + 0.5) / (class total)`` by the token's
training count, the maximum-entropy solution for word features alone.

* Counts of all tokens are gathered over the whole corpus. Words that make up
  at least ``1 / HEAVY`` of it, of which there can be no more than ``HEAVY``,
  are broadcast; counts of the others are joined to the texts that use them,
  and no such word is frequent enough to make a hot key.
* Each of the most frequent words is a class of its own; the others are
  clustered by their character n-grams, rarer words by the last three bytes. As
  features, rarer words are told apart by a hash of the whole word as well.
* The class factor is trained by distributed gradient updates over all training
  texts: how often each feature was met with each class, less how often the model
  so far expects it, is the gradient of the log-likelihood; both are summed in
  sparse numpy batches on the executors. A step divides it by the expected count,
  which is about its curvature. At the start the expected counts follow from the
  met ones, so each update but the first reads the texts once.

Defined results: null and blank texts are an end alone; repeated rows are scored
each for itself; a missing id counts as remainder 0; an empty table gives an
empty result; further columns are ignored.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.llm.toxicity import remainder
from granary.llm.workers import held
from granary.session import pinned

HEAVY = 1 << 20
SINGLES = 20
CLUSTERS = 28
CLASSES = SINGLES + CLUSTERS
BUCKETS = 1 << 15
SUFFIXES = 1 << 10
RARE = 1 << 8  # numbers of rarer words with one suffix
UPDATES = 2
STEP = 0.4
STEEP = 3.0  # what a step's ratio is held below
PRIOR = 60.0  # counts that hold a feature to the rates of all tokens
CHUNK = 1 << 16
BLOCK = 1 << 10  # features of a class that are summed together
TEXTS = 500  # taken apart at a time
END = b""  # the end of a text; no word is empty


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of some texts (bytes), and how many each text has."""
    whole = pa.Array.from_buffers(pa.string(), len(texts), texts.buffers(), offset=texts.offset)
    trimmed = pc.ascii_lower(pc.ascii_trim_whitespace(whole))
    lists = pc.ascii_split_whitespace(trimmed)
    blank = pc.equal(pc.binary_length(trimmed), 0).to_numpy(zero_copy_only=False)
    flat, sizes = lists.flatten(), pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    if blank.any():  # such a text gives one empty word
        flat = flat.filter(pc.not_equal(pc.binary_length(flat), 0))
        sizes[blank] = 0
    return flat, sizes


def tokens_of(texts: pa.Array) -> tuple[np.ndarray, list[bytes], np.ndarray]:
    """Which of the distinct words each word of some texts is, these words, and how many words each text has."""
    flat, sizes = split_words(texts)
    coded = flat.dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False), coded.dictionary.cast(pa.binary()).to_pylist(), sizes


def suffix(word: bytes) -> int:
    return zlib.crc32(word[-3:]) & (SUFFIXES - 1)


def count_words(docs: DataFrame, flush: int = 2_000_000) -> DataFrame:
    """(word, c, every): counts among training texts and among all, ends included; ``flush`` tokens are counted at a time."""
    schema = pa.schema([("word", pa.binary()), ("c", pa.int64()), ("every", pa.int64())])

    def emit(held: list[tuple[pa.Array, int]], training: bool) -> Iterator[pa.RecordBatch]:
        ends = sum(n for _, n in held)
        if not ends:
            return
        found = pc.value_counts(pa.chunked_array([words for words, _ in held], pa.string()))
        words, n = found.field("values").cast(pa.binary()), found.field("counts").cast(pa.int64())
        words, n = pa.concat_arrays([words, pa.array([END], pa.binary())]), pa.concat_arrays([n, pa.array([ends], pa.int64())])
        whole = pa.RecordBatch.from_arrays([words, n if training else pa.array(np.zeros(len(n), np.int64)), n], schema=schema)
        for at in range(0, whole.num_rows, 50_000):
            yield whole.slice(at, 50_000)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, other, n = [], [], 0
        for whole in batches:
            for at in range(0, whole.num_rows, TEXTS):
                batch = whole.slice(at, TEXTS)
                held = np.array(batch.column("held_out").to_pylist(), bool)
                flat, sizes = split_words(batch.column("text"))
                of = np.repeat(held, sizes)
                known.append((flat.filter(pa.array(~of)), int((~held).sum())))
                other.append((flat.filter(pa.array(of)), int(held.sum())))
                n += len(flat)
                if n > flush:
                    yield from emit(known, True)
                    yield from emit(other, False)
                    known, other, n = [], [], 0
        yield from emit(known, True)
        yield from emit(other, False)

    partial = docs.select("held_out", "text").mapInArrow(run, "word binary, c long, every long")
    return partial.groupBy("word").agg(F.sum("c").alias("c"), F.sum("every").alias("every"))


def profiles(words: list[bytes]) -> np.ndarray:
    """Hashed counts of each word's character 1- to 3-grams, of unit length."""
    out = np.zeros((len(words), 96), np.float32)
    for row, word in enumerate(words):
        edged = b"<" + word + b">"
        for n in (1, 2, 3):
            for i in range(len(edged) - n + 1):
                h = zlib.crc32(edged[i : i + n])
                out[row, h % 96] += 1.0 if h & 1024 else -1.0
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-6)


def cluster(words: list[bytes], counts: np.ndarray, seed: int = 5, chunk: int = 20_000) -> np.ndarray:
    """The class of each word and, behind them, of each suffix bucket; words come by falling count.

    Centres are those of the first chunk, moved by every later one (k-means in mini-batches).
    """
    draw = np.random.default_rng(seed)
    centres, mass = np.zeros((CLUSTERS, 96), np.float32), np.zeros((CLUSTERS, 1), np.float32)
    for at in range(SINGLES, len(words), chunk):
        points, weight = profiles(words[at : at + chunk]), np.sqrt(counts[at : at + chunk]).astype(np.float32)[:, None]
        if at == SINGLES:
            centres = points[draw.choice(len(points), CLUSTERS, replace=len(points) < CLUSTERS)].copy()
        for turn in range(12 if at == SINGLES else 1):
            near = np.argmax(points @ centres.T, axis=1)
            sums = np.zeros_like(centres) if at == SINGLES else centres * mass
            np.add.at(sums, near, points * weight)
            norms = np.linalg.norm(sums, axis=1, keepdims=True)
            centres = np.where(norms > 0, sums / np.maximum(norms, 1e-6), centres)
            if turn == 11 or at > SINGLES:
                mass = norms
    classes = np.empty(len(words) + SUFFIXES, np.int16)
    classes[: min(SINGLES, len(words))] = np.arange(min(SINGLES, len(words)))
    for at in range(SINGLES, len(words), chunk):
        classes[at : min(at + chunk, len(words))] = SINGLES + np.argmax(profiles(words[at : at + chunk]) @ centres.T, axis=1)
    # A suffix bucket has the class that most of its words among the known ones have.
    votes = np.zeros((SUFFIXES, CLUSTERS))
    for word, c in zip(words[SINGLES:], classes[SINGLES : len(words)], strict=True):
        votes[suffix(word), c - SINGLES] += 1
    classes[len(words) :] = SINGLES + np.argmax(votes + 1e-3 * np.arange(CLUSTERS), axis=1)
    return classes


class Model:
    """words and their training counts (by falling count), classes, class totals, feature weights."""

    def __init__(self, words: list[bytes], counts: np.ndarray, classes: np.ndarray, totals: np.ndarray, tokens: int, types: int):
        self.words, self.counts, self.classes, self.totals = words, counts, classes, totals
        self.tokens, self.types = tokens, types
        self.key = uuid.uuid4().hex  # names it in the workers' caches
        self.intercepts = np.log(np.maximum(totals, 1e-9) / max(totals.sum(), 1e-9)).astype(np.float32)
        self.weights = np.zeros((CLASSES, BUCKETS), np.float32)

    def class_of(self) -> np.ndarray:
        """The class of every word number."""
        known = len(self.words)
        return np.concatenate([self.classes[:known], np.repeat(self.classes[known:], RARE)])


class _Numbers(dict):
    """Word numbers: known words, then for each suffix ``RARE`` numbers of rarer words."""

    def __init__(self, words: list[bytes]):
        super().__init__((w, i) for i, w in enumerate(words))
        self.known = len(words)

    def __missing__(self, word: bytes) -> int:
        return self.known + suffix(word) * RARE + (zlib.crc32(word) & (RARE - 1))


def _numbers(shared) -> _Numbers:
    return held(shared.value.key, lambda: _Numbers(shared.value.words))


def events(which: np.ndarray, words: list[bytes], sizes: np.ndarray, numbers: _Numbers, class_of: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Numbers of all tokens of some texts (see :func:`tokens_of`), their hashed features, and where each text begins."""
    sizes = sizes + 1
    starts = np.concatenate([[0], np.cumsum(sizes)])
    end = numbers[END]
    flat = np.full(starts[-1], end, np.int32)
    inner = np.ones(len(flat), bool)
    inner[starts[1:] - 1] = False
    flat[inner] = np.fromiter(map(numbers.__getitem__, words), np.int32, len(words))[which]
    place = np.arange(len(flat), dtype=np.int32) - np.repeat(starts[:-1].astype(np.int32), sizes)  # within its text
    back = []
    for k in (1, 2, 3, 4):
        own = np.full_like(flat, end)
        own[k:] = flat[:-k]
        own[place < k] = end
        back.append(own)
    near, far = (class_of[back[k]].astype(np.int32) * CLASSES + class_of[back[k + 1]] for k in (0, 2))
    mix = lambda x, by: ((x.astype(np.int64) + 1) * np.int64(by) >> 17) & (BUCKETS - 1)
    keys = zip((back[0], back[1], near, far), (0x9E3779B97F4A7C, 0x5851F42D4C957F, 0x14057B7EF76781, 0x2545F4914F6CDD), strict=True)
    return flat, np.stack([mix(x, by).astype(np.int16) for x, by in keys]), starts


def class_odds(model: Model, features: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unscaled P(class | features), a row for each class and a column for each event, and the columns' sums.

    Four weights within 6 of 0 and the intercepts keep these within a float's range. One class
    after the other, so that what is gathered from stays in the processor's cache.
    """
    odds, sums = np.empty((CLASSES, features.shape[1]), np.float32), np.zeros(features.shape[1], np.float32)
    first, *rest = features.astype(np.intp)
    for own, row, intercept in zip(odds, model.weights, model.intercepts, strict=True):
        np.take(row, first, out=own, mode="clip")
        for feature in rest:
            own += row[feature]
        own += intercept
        np.exp(own, out=own)
        sums += own
    return odds, sums


def gathered(docs: DataFrame, shared, weights, parts: int) -> np.ndarray:
    """Over all training texts, how often each class met each feature; given weights, how often the model expects it to."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, numbers = shared.value, _numbers(shared)
        class_of = model.class_of()
        sums = np.zeros((CLASSES, BUCKETS))
        if weights is not None:
            model.weights = weights.value
        for batch in batches:
            for at in range(0, batch.num_rows, TEXTS):
                flat, features, _ = events(*tokens_of(batch.column(0).slice(at, TEXTS)), numbers, class_of)
                for a in range(0, len(flat), CHUNK):
                    f = features[:, a : a + CHUNK]
                    if weights is None:
                        places = class_of[flat[a : a + CHUNK]].astype(np.int64) * BUCKETS + f
                        np.add.at(sums.reshape(-1), places.reshape(-1), 1.0)
                        continue
                    law, totals = class_odds(model, f)
                    np.divide(1, totals, out=totals)
                    own = f.astype(np.intp)
                    for into, odds in zip(sums, law, strict=True):
                        share = (odds * totals).astype(np.float64)
                        for feature in own:
                            into += np.bincount(feature, share, BUCKETS)
        rows = sums.astype(np.float32).reshape(-1, BLOCK)
        seen = np.flatnonzero(rows.any(axis=1))
        yield pa.RecordBatch.from_pydict({"block": pa.array(seen, pa.int32()), "sums": pa.array([r.tobytes() for r in rows[seen]], pa.binary())})

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, own in zip(*batch.columns, strict=True):
                row, block = np.frombuffer(own.as_py(), np.float32).astype(np.float64), block.as_py()
                if block in sums:
                    sums[block] += row
                else:
                    sums[block] = row
        if sums:
            yield pa.RecordBatch.from_pydict({"block": pa.array(list(sums), pa.int32()), "sums": pa.array([r.astype(np.float32).tobytes() for r in sums.values()], pa.binary())})

    partial = docs.select("text").mapInArrow(measure, "block int, sums binary")
    out = np.zeros((CLASSES * BUCKETS // BLOCK, BLOCK))
    for r in partial.repartition(parts, "block").mapInArrow(total, "block int, sums binary").collect():  # at most CLASSES * BUCKETS / BLOCK rows
        out[r["block"]] = np.frombuffer(r["sums"], np.float32)
    return out.reshape(CLASSES, BUCKETS)


def prepared(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), (remainder(id_col, 5) == 1).alias("held_out"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))


def train(docs: DataFrame, heavy: int = HEAVY) -> tuple[Model, DataFrame]:
    """The model, and the counts of all words that it doesn't hold: (word, c)."""
    counts = pinned(count_words(docs))
    sums = counts.agg(F.sum("c"), F.sum("every"), F.sum((F.col("c") > 0).cast("long"))).first()
    tokens, every, types = (int(x or 0) for x in sums)
    large = (F.col("every") * heavy >= every) | (F.col("word") == F.lit(END))
    known = counts.where(large).orderBy(F.desc("c"), "word").collect()  # at most `heavy` + 1 words: each is that share of all
    words = [bytes(r["word"]) for r in known]
    own = np.array([r["c"] for r in known], np.int64)
    rare = counts.where(~large)
    bucket = F.crc32(F.substring("word", -3, 3)).bitwiseAND(SUFFIXES - 1)
    left = rare.where("c > 0").groupBy(bucket.alias("bucket")).agg(F.sum("c").alias("n"), F.count("*").alias("types")).collect()  # at most SUFFIXES rows
    classes = cluster(words, own)
    totals = np.bincount(classes[: len(words)], own + 0.5, CLASSES).astype(float)
    masses = np.full(SUFFIXES, 0.5)
    for r in left:
        masses[r["bucket"]] += r["n"] + 0.5 * r["types"]
    totals += np.bincount(classes[len(words) :], masses, CLASSES)
    model = Model(words, own, classes, totals, tokens, types)
    context = docs.sparkSession.sparkContext
    shared = context.broadcast(model)
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    learning = docs.where("not held_out")
    rates = np.exp(model.intercepts)[:, None]
    met = gathered(learning, shared, None, parts)
    due = met.sum(axis=0) * rates
    for k in range(UPDATES):
        if k:
            due = gathered(learning, shared, context.broadcast(model.weights), parts)
        step = np.minimum((met - due) / (due + PRIOR * rates), STEEP)
        model.weights = np.clip(model.weights + STEP * step, -6, 6).astype(np.float32)
    return model, rare.select("word", "c")


SCORED = "row_id long, doc_id long, held_out boolean, n_tokens long, n_known long, base double, gain double, rare array<binary>, times array<int>"


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", heavy: int = HEAVY) -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    texts = prepared(docs, id_col, text_col)
    model, rare = train(texts, heavy)
    context = docs.sparkSession.sparkContext
    shared, weights = context.broadcast(model), context.broadcast(model.weights)
    whole = model.tokens + 0.5 * (model.types + 1)
    schema = pa.schema([("row_id", pa.int64()), ("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base", pa.float64()), ("gain", pa.float64()), ("rare", pa.list_(pa.binary())), ("times", pa.list_(pa.int32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, numbers = shared.value, _numbers(shared)
        model.weights = weights.value
        known = len(model.words)
        # By word number: log10 of what a token has of its class, and of all tokens; the count is joined for rare ones.
        class_of = model.class_of()
        inside = np.append(np.log10(model.counts + 0.5), np.zeros(SUFFIXES * RARE))
        share = np.log10(np.maximum(model.totals, 1e-300))[class_of]
        heard = np.append(model.counts > 0, np.zeros(SUFFIXES * RARE, bool))
        for batch in batches:
            for at in range(0, batch.num_rows, TEXTS):
                part = batch.slice(at, TEXTS)
                which, words, sizes = tokens_of(part.column(3))
                flat, features, starts = events(which, words, sizes, numbers, class_of)
                gain = np.empty(len(flat))
                classes = class_of[flat].astype(np.int64)
                for a in range(0, len(flat), CHUNK):
                    odds, sums = class_odds(model, features[:, a : a + CHUNK])
                    gain[a : a + CHUNK] = np.log10(np.maximum(odds[classes[a : a + CHUNK], np.arange(len(sums))] / sums, 1e-30))
                gain -= share[flat]
                # Each text's rarer words and how often it has them.
                seldom = np.array([numbers.get(w) is None for w in words], bool)[which] if words else np.zeros(0, bool)
                met, times = np.unique(np.repeat(np.arange(len(sizes)), sizes)[seldom] * np.int64(len(words) + 1) + which[seldom], return_counts=True)
                edges = pa.array(np.searchsorted(met, np.arange(len(sizes) + 1) * np.int64(len(words) + 1)), pa.int32())
                named = pa.array(words, pa.binary()).take(pa.array(met % (len(words) + 1), pa.int64()))
                at_starts = starts[:-1]
                base = np.add.reduceat(inside[flat], at_starts)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0), part.column(1), part.column(2),
                        pa.array(np.diff(starts), pa.int64()), pa.array(np.add.reduceat(heard[flat].astype(np.int64), at_starts), pa.int64()),
                        pa.array(base, pa.float64()), pa.array(np.add.reduceat(gain, at_starts), pa.float64()),
                        pa.ListArray.from_arrays(edges, named), pa.ListArray.from_arrays(edges, pa.array(times, pa.int32())),
                    ],
                    schema=schema,
                )

    found = pinned(texts.withColumn("row_id", F.monotonically_increasing_id()).select("row_id", "doc_id", "held_out", "text").mapInArrow(run, SCORED))
    used = found.select("row_id", F.explode(F.arrays_zip(F.col("rare").alias("word"), F.col("times").alias("times"))).alias("u")).select("row_id", "u.word", "u.times")
    joined = used.join(rare, "word", "left").withColumn("c", F.coalesce("c", F.lit(0)))
    more = joined.groupBy("row_id").agg(F.sum(F.col("times") * F.log10(F.col("c") + 0.5)).alias("more"), F.sum(F.when(F.col("c") > 0, F.col("times")).otherwise(0)).alias("more_known"))
    out = found.drop("rare", "times").join(more, "row_id", "left")
    inside = F.col("base") + F.coalesce("more", F.lit(0.0))
    return out.select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_known") + F.coalesce("more_known", F.lit(0))).cast("long").alias("n_known"),
        F.lit(model.tokens).cast("long").alias("train_tokens"),
        (inside - F.col("n_tokens") * F.lit(float(np.log10(whole)))).alias("base_score"),
        (inside + F.col("gain")).alias("score"),
    )
