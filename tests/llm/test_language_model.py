import math
import random
import zlib
from collections import Counter

import pyarrow as pa
import pytest

from granary.llm import language_model


def tokens(text):
    return [*(text or "").encode().lower().split(), None]


def test_tokens_are_the_words():
    rng = random.Random(4)
    texts = ["".join(rng.choice("aBÉ \t\n\r\x0b\x0c\x1c\x85\u3000z") for _ in range(rng.randrange(12))).encode() for _ in range(400)] + [b"", b" ", b"\xff \xfe"]
    for at in (0, 7):
        which, words, sizes = language_model.tokens_of(pa.array(texts)[at:])
        flat, ends = [words[k] for k in which], [0, *sizes.cumsum().tolist()]
        assert [flat[a:b] for a, b in zip(ends, ends[1:], strict=False)] == [t.lower().split() for t in texts[at:]]


def brute(rows):
    held = [r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 1 for r in rows]
    counts = Counter(t for r, h in zip(rows, held, strict=True) if not h for t in tokens(r[1]))
    n, v = sum(counts.values()), len(counts)
    out = []
    for r, h in zip(rows, held, strict=True):
        own = tokens(r[1])
        out.append((r[0], h, len(own), sum(counts[t] > 0 for t in own), n, sum(math.log10((counts[t] + 0.5) / (n + 0.5 * (v + 1))) for t in own)))
    return out


@pytest.mark.parametrize("heavy", [1 << 19, 50])
def test_base_scores(odd, odd_rows, heavy):
    """Both with all words broadcast and with nearly all of them joined."""
    got = sorted((repr(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in language_model.score(odd, heavy=heavy).collect())
    want = sorted((repr(d), *rest) for d, *rest in brute(odd_rows))
    assert len(got) == len(want)
    for g, w in zip(got, want, strict=True):
        assert g[:5] == w[:5] and g[5] == pytest.approx(w[5], rel=1e-9) and math.isfinite(g[6]) and g[6] < 0


def test_the_model_beats_the_base_on_held_out_texts(spark, odd):
    rng = random.Random(3)
    kinds = [[f"{a}{''.join(rng.choice(a) for _ in range(rng.randrange(1, 5)))}" for _ in range(300)] for a in ("abcd", "efgh", "ijkl")]
    rows = [(i, " ".join(rng.choices(kinds[i % 3], k=rng.randrange(5, 80))), None, None, None, 1, "s", 2) for i in range(900)]
    got = language_model.score(spark.createDataFrame(rows, odd.schema)).collect()
    held = [r for r in got if r.held_out]
    assert len(held) > 100
    gain = sum(r.score - r.base_score for r in held) / sum(r.n_tokens for r in held)
    assert gain > 0.25  # at most log10(3) by knowing the kind


def test_class_odds():
    import numpy as np

    words = [b"", b"the", b"of", *(f"w{i}".encode() for i in range(60))]
    counts = np.arange(len(words), 0, -1)
    classes = language_model.cluster(words, counts)
    assert len(classes) == len(words) + language_model.SUFFIXES and classes.min() >= 0 and classes.max() < language_model.CLASSES
    model = language_model.Model(words, counts, classes, np.bincount(classes, minlength=language_model.CLASSES) + 0.5, 10, 5)
    model.weights = np.random.default_rng(1).standard_normal(model.weights.shape).astype(np.float32)
    flat, features, starts = language_model.events(*language_model.tokens_of(pa.array([b" The\tzz", b"", b"of of of of of "])), language_model._Numbers(words), model.class_of())
    assert starts.tolist() == [0, 3, 4, 10] and features.shape == (4, 10) and features.min() >= 0 and features.max() < language_model.BUCKETS
    model.weights = np.clip(model.weights, -6, 6)
    odds, sums = language_model.class_odds(model, features)
    assert np.allclose(odds.sum(axis=0), sums, rtol=1e-4) and np.isfinite(sums).all() and (sums > 0).all()
    brute = np.exp(sum(model.weights[:, f].astype(float) for f in features) + model.intercepts[:, None])
    assert np.allclose(odds / sums, brute / brute.sum(axis=0), atol=1e-5)


def test_sums_against_brute_force(spark, odd, odd_rows):
    """What features and classes are met and expected, over all training texts, event by event."""
    import numpy as np

    docs = language_model.prepared(odd, "doc_id", "text")
    model, _ = language_model.train(docs, heavy=200)
    model.weights = np.random.default_rng(5).standard_normal(model.weights.shape).astype(np.float32)
    context = spark.sparkContext
    shared, weights, learning = context.broadcast(model), context.broadcast(model.weights), docs.where("not held_out")
    met, due = language_model.gathered(learning, shared, None, 3), language_model.gathered(learning, shared, weights, 3)
    numbers, class_of = language_model._Numbers(model.words), model.class_of()
    want_met, want_due = np.zeros_like(met), np.zeros_like(due)
    for r in odd_rows:
        if r[0] is None or zlib.crc32(str(r[0]).encode()) % 5 != 1:
            flat, features, _ = language_model.events(*language_model.tokens_of(pa.array([(r[1] or "").encode()])), numbers, class_of)
            for token, own in zip(flat, features.T, strict=True):
                logits = model.weights[:, own].astype(float).sum(axis=1) + model.intercepts
                law = np.exp(logits) / np.exp(logits).sum()
                for f in own:
                    want_met[class_of[token], f] += 1
                    want_due[:, f] += law
    assert np.array_equal(met, want_met) and np.allclose(due, want_due, rtol=1e-3, atol=1e-3)


def test_empty(empty):
    assert language_model.score(empty).count() == 0
