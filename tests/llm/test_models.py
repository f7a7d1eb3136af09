import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from granary.llm import boosting, pii, toxicity

BASE = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    ("card", r"[0-9]([\x20-]?[0-9])+"),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
]


def luhn(digits):
    total = 0
    for i, d in enumerate(reversed(digits)):
        d = int(d) * (i % 2 + 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def base_spans(text):
    out = []
    for kind, pattern in BASE:
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m.group())
            good = {"email": True, "ip": all(int(p) <= 255 for p in m.group().split(".")) if kind == "ip" else True, "card": 13 <= len(digits) <= 19 and luhn(digits), "phone": 9 <= len(digits) <= 15}[kind]
            if good:
                out.append((kind, m.start(), m.end()))
    return out


def card(rng):
    digits = "4" + "".join(rng.choice("0123456789") for _ in range(14))
    return next(digits + c for c in "0123456789" if luhn(digits + c))


def personal(rng):
    return rng.choice([
        lambda: f"a{rng.randrange(99)}.{rng.randrange(9)}@mail{rng.randrange(9)}.example.com",
        lambda: "x@y.z_b@c.d", lambda: "a@b", lambda: "a..b@c-d.e.f.", lambda: "1.2.3.4.5", lambda: "300.1.1.1", lambda: "0001.2.3.255",
        lambda: ".".join(str(rng.randrange(290)) for _ in range(4)),
        lambda: card(rng), lambda: "-".join(re.findall("....", card(rng))), lambda: "1234567812345678",
        lambda: f"+1 ({rng.randrange(200, 999)}) 555-{rng.randrange(1000, 9999)}", lambda: "+12", lambda: "+1 2 3 4 5 6 7 8 9 .", lambda: "é\U0001f600 +33 1 23 45 67 89",
        lambda: f"+1 ({rng.randrange(200, 999)}) 555-{rng.randrange(1000, 9999)} {card(rng)}",
    ])()


@pytest.fixture(scope="module")
def private_rows(odd_rows):
    rng = random.Random(9)
    texts = [" ".join(rng.choice([lambda: "word", lambda: personal(rng), lambda: "née\n"])() for _ in range(rng.randrange(1, 12))) for _ in range(700)]
    texts += ["1" * 40_000, "1 " * 20_000, "a" * 20_000 + "@", "a.b" * 5000 + "@c" + ".d" * 5000, "+1" + " 2" * 9000, "1." * 20_000, "(" * 5000]
    return [*odd_rows, *((1000 + i, t, None, None, None, 1, "s", 2) for i, t in enumerate(texts))]


def test_personal_data(spark, odd, private_rows, empty):
    frame = spark.createDataFrame(private_rows, odd.schema)
    got = pii.report(frame).collect()
    want = Counter()
    for r in private_rows:
        found = base_spans(r[1] or "")
        n = Counter(k for k, _, _ in found)
        want[r[0], n["email"], n["ip"], n["card"], n["phone"], hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in found).encode()).hexdigest()] += 1
    assert Counter((r.doc_id, r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) for r in got) == want
    added, texts = 0, {r[0]: r[1] for r in private_rows if r[0] is not None and r[0] >= 1000}
    for r in got:
        if r.doc_id in texts:
            spans = [(k, int(a), int(b)) for k, a, b in (s.split(":") for s in r.spans.split(",") if s)]
            base = base_spans(texts[r.doc_id])
            assert set(base) <= set(spans) and spans == sorted(spans, key=lambda s: (pii.KINDS.index(s[0]), s[1]))
            for kind, a, b in set(spans) - set(base):
                added += 1
                assert not any(a < y and x < b for _, x, y in base), texts[r.doc_id][a:b]
    assert added > 10  # numbers next to each other, which the strict patterns run together and drop
    assert pii.report(empty).count() == 0


def test_one_document_of_very_many_addresses(spark):
    """The work is linear in a document's spans."""
    text = " ".join(f"a{i}@b{i}.com" for i in range(100_000))
    got = pii.report(spark.createDataFrame([(1, text), (2, None)], "doc_id long, text string")).collect()
    found = {r.doc_id: r for r in got}
    base = ",".join(f"{k}:{a}:{b}" for k, a, b in base_spans(text))
    assert found[1].n_email == 100_000 and found[1].spans == base and found[1].base_sha256 == hashlib.sha256(base.encode()).hexdigest()
    assert found[2].n_email == 0 and found[2].spans == ""


def test_rewritten_addresses_are_added(spark):
    """No strict pattern takes these; the model knows them from base spans in rewritten form."""
    rng = random.Random(2)
    ip = lambda join: join.join(str(rng.randrange(1, 255)) for _ in range(4))
    rows = [(i, f"host {ip('.')} said a{i}.b@mail{i % 7}.example.com or 300.{i}.700.999 again") for i in range(300)]
    rows += [(1000 + i, f"host {ip('[.]')} said a{i}.b [at] mail{i % 7}.example.com again") for i in range(40)]
    got = {r.doc_id: r for r in pii.report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, text in rows:
        if i >= 1000:
            spans = [s.split(":") for s in got[i].spans.split(",")]
            assert got[i].n_email == got[i].n_ip == 0 and [s[0] for s in spans] == ["email", "ip"]
            assert "[at]" in text[int(spans[0][1]) : int(spans[0][2])] and "[.]" in text[int(spans[1][1]) : int(spans[1][2])]
        else:
            assert got[i].spans.count(":") == 4  # the number with parts above 255 isn't added


def test_thresholds_are_calibrated():
    rng = np.random.default_rng(2)
    margins = rng.normal(0, 2, 4000)
    truth = (rng.random(4000) < 1 / (1 + np.exp(-(1.5 * margins - 1)))).astype(float)
    bar = pii.calibrated(margins, truth, 0.9)
    assert abs(1 / (1 + np.exp(-(1.5 * bar - 1))) - 0.9) < 0.03
    assert pii.calibrated(margins, np.ones(4000)) == -np.inf and pii.calibrated(margins[:5], np.ones(5)) == np.inf == pii.calibrated(margins, np.zeros(4000)) == pii.calibrated(margins[:0], truth[:0])
    assert pii.calibrated(-margins, truth) == np.inf


def test_boosted_trees_and_their_expression(spark):
    rng = np.random.default_rng(1)
    x = rng.integers(0, 6, (800, 4)).astype(float)
    y = ((x[:, 0] > 2) ^ (x[:, 2] > 3)).astype(float)
    model = boosting.fit(x, y)
    margins = model.margins(x)
    assert ((margins > 0) == (y > 0.5)).mean() > 0.98
    frame = spark.createDataFrame([(k, *map(float, r)) for k, r in enumerate(x[:100])], "k int, a double, b double, c double, d double")
    got = {r.k: r.m for r in frame.select("k", model.expression([F.col(c) for c in "abcd"]).alias("m")).collect()}
    assert all(got[k] == pytest.approx(margins[k]) for k in got)
    assert boosting.fit(np.zeros((0, 4)), np.zeros(0)).margins(np.zeros((2, 4))).tolist() == [-8.0, -8.0]


@pytest.fixture(scope="module")
def toxic_rows():
    rng = random.Random(6)
    clean = ["".join(rng.choice(["th", "en", "ra", "lo", "mi", "st"]) for _ in range(rng.randrange(1, 4))) for _ in range(300)]
    bad = ["grumblefish", "snarkwort", "vexatious"]
    rows, labels = [], []
    for i in range(900):
        words = [rng.choice(clean) for _ in range(rng.randrange(5, 90))]
        y = i % 4 == 0
        if y:
            for _ in range(3):
                word = rng.choice(bad)
                if rng.random() < 0.3:
                    at = rng.randrange(2, len(word) - 2)
                    word = word[:at] + rng.choice("xyz01") + word[at + 1 :]
                words[rng.randrange(len(words))] = word
        rows.append((i, " ".join(words) + rng.choice(["", "!!"]), None, "a", None, 1, "s", 2))
        labels.append((i, int(y)))
    return rows, labels


def test_toxicity_held_out(spark, odd, toxic_rows):
    rows, labels = toxic_rows
    extra = [(None, None, None, None, None, 1, "s", 2), (5000, "", None, None, None, 1, "s", 2), (5001, "z" * 30_000, None, None, None, 1, "s", 2), rows[0]]
    frame = spark.createDataFrame([*rows, *extra], odd.schema)
    truth = spark.createDataFrame([*labels, (None, 1), (7, None), (99_999, 1)], "doc_id long, toxic int")
    model = toxicity.fit(frame, truth)
    got = toxicity.score(frame, model).collect()
    assert len(got) == len(rows) + len(extra) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got)
    for r in got:
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
    held = [r for r in got if r.held_out and r.doc_id < 900]
    assert np.mean([r.predicted == (r.doc_id % 4 == 0) for r in held]) > 0.93
    again = {r.doc_id: r.score for r in toxicity.score(frame, toxicity.fit(frame, truth)).collect()}
    assert all(again[r.doc_id] == r.score for r in got)
    clean = toxicity.keep_clean(frame, model)
    assert clean.schema == frame.schema
    assert Counter(r.doc_id for r in clean.collect()) == Counter(r.doc_id for r in got if not r.predicted)


def test_toxicity_scores_against_brute_force(spark, odd, odd_rows, toxic_rows):
    rows, labels = toxic_rows
    model = toxicity.fit(spark.createDataFrame(rows, odd.schema), spark.createDataFrame(labels, "doc_id long, toxic int"))

    def vector(word):
        edged = f"<{word}>"
        own = [edged] + [edged[i : i + n] for n in (3, 4, 5) for i in range(len(edged) - n + 1)]
        return np.mean([model.embeddings[zlib.crc32(g.encode()) % toxicity.BUCKETS].astype(float) for g in own], axis=0)

    def brute(text):
        words = [w for w in (x.strip(toxicity.EDGES) for x in text.lower().split()) if w]
        if not words:
            return model.prior
        parts = -(-len(words) // toxicity.PASSAGE)
        edges = [int(len(words) * k / parts) for k in range(parts + 1)]
        logits = [np.mean([vector(w) for w in words[a:b]], axis=0) @ model.weights + model.intercepts for a, b in zip(edges, edges[1:], strict=False)]
        return max(np.exp(x[1]) / np.exp(x).sum() for x in logits)

    chosen = [r for r in [*odd_rows, *rows[:80]] if len(r[1] or "") < 5000]
    got = Counter((r.doc_id, round(r.score, 5)) for r in toxicity.score(spark.createDataFrame(chosen, odd.schema), model).collect())
    assert got == Counter((r[0], round(float(brute(r[1] or "")), 5)) for r in chosen)


def test_toxicity_trains_within_its_bytes(spark, odd, toxic_rows):
    rows, labels = toxic_rows
    frame, truth = spark.createDataFrame(rows, odd.schema), spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.fit(frame, truth, most_bytes=20_000)
    assert model.embeddings is not None and np.isfinite(model.embeddings).all()
    assert toxicity.fit(frame, truth, most_bytes=10).embeddings is None


def test_toxicity_without_labels(spark, odd, empty):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    model = toxicity.fit(odd, none)
    assert {r.score for r in toxicity.score(odd, model).collect()} == {0.5}
    assert toxicity.score(empty, model).count() == toxicity.keep_clean(empty, model).count() == 0
