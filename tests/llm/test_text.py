import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from granary.llm import bpe, mixing, packing, sharding
from granary.llm.lexicon import Lexicon, compile_image

JSON, RANKS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")


def test_lexicon_returns_its_ids_and_shares_suffixes():
    rng = random.Random(1)
    words = {("".join(rng.choice("abc") for _ in range(rng.randrange(1, 6))) + "tion").encode(): tuple(rng.choices(range(1000), k=3)) for _ in range(300)}
    image = compile_image(words.items())
    lexicon = Lexicon(image)
    assert all(lexicon.get(w) == ids for w, ids in words.items())
    assert lexicon.get(b"") is lexicon.get(b"zz") is lexicon.get(b"abctio") is None
    assert len(lexicon.final) < 150
    assert Lexicon(compile_image([])).get(b"a") is None


@pytest.fixture(scope="module")
def reference():
    return Tokenizer.from_file(JSON)


def test_codec_equals_the_tokenizer(reference):
    rng = random.Random(3)
    vocabulary = bpe.Vocabulary(JSON)
    words = [b" the", b"the", b" tion", "é".encode(), b"!"]
    codec = bpe.Codec(vocabulary, compile_image((w, tuple(bpe.merge_word(w, vocabulary))) for w in words))
    letters = ["a", "b", " ", "  ", "\n", "\x1c", "　", "é", "'s", "'ll", "1", "٣", "中", "!", "<|endoftext|>", "\x85", " the", "\t", "\U0001f600", "̈", "\x00"]
    texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(30))) for _ in range(1500)]
    texts.append("".join(rng.choice("abcdethi") for _ in range(20_000)))
    for text in texts:
        ids = reference.encode(text, add_special_tokens=False).ids
        packed = codec.encode(text)
        assert np.frombuffer(packed, "<u4").tolist() == ids, repr(text)
        assert codec.decode(packed) == reference.decode(ids, skip_special_tokens=False).encode()


def test_encode_decode(odd, odd_rows, empty, reference):
    want = Counter()
    for r in odd_rows:
        ids = reference.encode(r[1] or "", add_special_tokens=False).ids
        want[r[0], len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((r[1] or "").encode()).hexdigest()] += 1
    got = bpe.encode_decode(odd, JSON).collect()
    assert Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got) == want
    assert all(r.round_trip and len(r.ids) == 4 * r.n_tokens for r in got)
    assert bpe.encode_decode(empty, JSON).count() == 0


def test_best_fit_is_best_fit():
    rng = random.Random(8)
    for _ in range(30):
        capacity = rng.randrange(1, 70)
        lengths = sorted((rng.randrange(1, capacity + 1) for _ in range(rng.randrange(80))), reverse=True)
        rooms, want = [], []
        for length in lengths:
            fit = [room for room in rooms if room >= length]
            if fit:
                rooms[rooms.index(min(fit))] -= length
                want.append(min(fit))
            else:
                rooms.append(capacity - length)
                want.append(capacity)
        packed = packing.best_fit(lengths, capacity)
        assert sorted(k for row in packed for k in row) == list(range(len(lengths)))
        assert sorted(capacity - sum(lengths[k] for k in row) for row in packed) == sorted(rooms)


def test_packing_is_lossless(odd, odd_rows, empty):
    encode = packing.encoder(RANKS).encode_ordinary
    want = Counter((r[0], tuple(encode(r[1]))) for r in odd_rows if r[1])
    pieces, seen = defaultdict(list), 0
    capacity = 256
    rows = packing.pack(odd, RANKS, capacity=capacity).collect()
    for r in rows:
        ids, positions = np.frombuffer(r.ids, "<u4"), np.frombuffer(r.positions, "<u4")
        assert len(ids) == len(positions) == capacity and r.cu_seqlens[0] == 0 and r.cu_seqlens[-1] == r.n_tokens <= capacity
        assert (ids[r.n_tokens :] == 50256).all() and (positions[r.n_tokens :] == 0).all()
        for doc, at, a, b in zip(r.doc_ids, r.offsets, r.cu_seqlens[:-1], r.cu_seqlens[1:], strict=True):
            assert positions[a:b].tolist() == list(range(b - a))
            pieces[doc].append((at, tuple(ids[a:b].tolist())))
        seen += r.n_tokens
    assert seen == sum(len(ids) * n for (_, ids), n in want.items())
    for (doc, ids), n in want.items():
        if n == 1 and sum(d == doc for d, _ in want) == 1:
            assert tuple(x for _, part in sorted(pieces[doc]) for x in part) == ids
    assert packing.pack(empty, RANKS).count() == 0


def brute_targets(sizes):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    left, out, open_ = 1.5 * sum(sizes.values()), {}, set(names)
    while open_:
        level = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if level * weight[s] > 2 * sizes[s]}
        if not over:
            return out | {s: level * weight[s] for s in open_}
        out |= {s: 2.0 * sizes[s] for s in over}
        left -= sum(2 * sizes[s] for s in over)
        open_ -= over
    return out


def test_mixing(odd, odd_rows, empty):
    sizes = Counter()
    for r in odd_rows:
        sizes[r[3]] += len((r[1] or "").encode().split())
    want = brute_targets(sizes)
    got = mixing.mix(odd).collect()
    assert len(got) == len(odd_rows)
    taken = Counter()
    for r in got:
        assert 0 <= r.taken <= 2 * r.size and r.source_size == sizes[r.source]
        assert r.target == pytest.approx(want[r.source])
        taken[r.source] += r.taken
    assert all(abs(taken[s] - want[s]) < 1 for s in want)
    again = mixing.mix(odd.repartition(3)).collect()
    assert Counter(map(tuple, got)) == Counter(map(tuple, again))
    rows = mixing.mixed_rows(odd)
    assert rows.columns == odd.columns
    words = Counter()
    for r in rows.collect():
        words[r.source] += len((r.text or "").encode().split())
    assert words.total() == pytest.approx(sum(want.values()), rel=0.3)  # one long document is most of this table
    assert mixing.mix(empty).count() == mixing.mixed_rows(empty).count() == 0


def test_mixed_rows_of_null_and_repeated_ids(spark, tmp_path):
    """Sources meet their targets whatever the ids are, and only rows of the table come out."""
    rng = random.Random(6)
    for ids in (lambda k: None, lambda k: k, lambda k: k % 3):
        rows = [(ids(k), " ".join([f"w{k}"] * rng.randrange(1, 4)) if k % 10 else "same text", "abc"[k % 3], k if k % 10 else 0) for k in range(240)]
        sizes = Counter()
        for r in rows:
            sizes[r[2]] += len(r[1].split())
        want = brute_targets(sizes)
        out = []
        for turn in range(2):
            frame = spark.createDataFrame(rows, "doc_id long, text string, source string, copies int").repartition(4 + turn)
            if turn:
                path = str(tmp_path / f"docs{rng.random()}")
                frame.write.parquet(path)
                frame = spark.read.parquet(path)
            mixed = mixing.mixed_rows(frame)
            assert mixed.columns == frame.columns
            out.append(Counter(map(tuple, mixed.collect())))
        assert out[0] == out[1] and set(out[0]) <= set(rows)
        held = Counter(rows)
        assert all(n <= 2 * held[r] for r, n in out[0].items())
        taken = Counter()
        for r, n in out[0].items():
            taken[r[2]] += n * len(r[1].split())
        assert all(abs(taken[s] - want[s]) <= 3 for s in want)


def test_minimax_cuts_against_brute_force():
    rng = random.Random(4)
    for _ in range(40):
        sizes = np.array([rng.randrange(1, 30) for _ in range(rng.randrange(1, 9))], np.int64)
        shards = rng.randrange(1, 5)

        def best(at, left):
            if at == len(sizes):
                return 0
            if not left:
                return 10**9
            return min(max(int(sizes[at:end].sum()), best(end, left - 1)) for end in range(at + 1, len(sizes) + 1))

        assert sharding.minimax_cuts(sizes, shards)[0] == best(0, shards)


def test_cuts_are_minimax_over_groups(spark):
    """Though few intervals are held at first, the cuts are those of all groups."""
    rng = random.Random(11)
    for trial, (n, shards) in enumerate([(3000, 7), (900, 40), (50, 12), (4000, 40)]):
        sizes = [rng.randrange(17, 4000) if rng.random() < 0.99 else rng.randrange(4000, 30_000) for _ in range(n)]
        if trial == 3:
            sizes = [int(rng.paretovariate(1.1) * 20) for _ in range(n)]
        places = sorted(rng.sample(range(1 << 60), n)) if trial else sorted(rng.sample(range(1 << 30), n))  # crowded at one end
        capacity, ends = sharding.minimax_cuts(np.array(sizes, np.int64), shards)
        frame = spark.createDataFrame(list(zip(places, sizes)), "place long, size long")
        begins = sharding.cuts(frame, shards, cells=16, split=4)
        want = [places[e] for e in ends if e < n]
        assert [sum(p < b for p in places) for b in begins] == [sum(p < w for p in places) for w in want]


def test_sharding(odd, odd_rows, empty):
    got = sharding.shard(odd, shards=7).collect()
    assert len(got) == len(odd_rows)
    by_shard, by_crc = defaultdict(list), defaultdict(set)
    for r in got:
        by_shard[r.shard].append(r)
        by_crc[r.text_crc32].add(r.shard)
    assert set(by_shard) <= set(range(7)) and all(len(s) == 1 for s in by_crc.values())
    for rows in by_shard.values():
        assert sorted(r.slot for r in rows) == list(range(len(rows)))
    loads = sorted(sum(r.size for r in rows) for rows in by_shard.values())
    long = [len((r[1] or "").encode()) + 16 for r in odd_rows if r[1] and len(r[1]) > 5000]
    rest = sum(loads) - sum(long)
    assert max(load for load in loads if load not in long) <= rest / 5 + 2500
    assert sharding.shard(empty, 7).count() == 0
    few = {(r.doc_id, r.shard, r.slot) for r in sharding.shard(odd, shards=7, cells=2, split=2).collect()}
    assert few == {(r.doc_id, r.shard, r.slot) for r in got}
    order = defaultdict(int)
    for r in odd_rows:
        text = (r[1] or "").encode()
        order[int(hashlib.md5(text).hexdigest()[:15], 16)] += len(text) + 16
    single = set()
    while max(v for k, v in order.items() if k not in single) * (7 - len(single)) > sum(v for k, v in order.items() if k not in single):
        single.add(max((k for k in order if k not in single), key=lambda k: order[k]))
    best = sharding.minimax_cuts(np.array([order[k] for k in sorted(order) if k not in single], np.int64), 7 - len(single))[0]
    assert loads[-1] == max(best, *(order[k] for k in single))
