"""Byte-level BPE encoding and decoding with a transducer lexicon of frequent words.

The corpus's space-separated pieces are counted over all rows. Those that make
up at least ``1 / lexicon_words`` of them, of which there can be no more than
``lexicon_words``, have their words encoded once and compiled into a
:mod:`granary.llm.lexicon` image, which is broadcast and memory-mapped by each
worker. Words outside it are merged exactly. A bounded memo keeps the
ids of recent pieces.

Defined results: a null text is an empty text, with no tokens; repeated rows
are encoded each for itself; an empty table gives an empty result; further
columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.llm.lexicon import Lexicon, compile_image
from granary.llm.workers import held
from granary.session import pinned

PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
LEXICON_WORDS = 1 << 19
LONGEST_LEXICON_PIECE = 64
MEMO = 400_000
BLOCK = 1 << 16  # ids decoded at a time
SHIFT, LOW, NEVER = 20, (1 << 20) - 1, 1 << 60
_GAP = re.compile(r"(?<=\S) ")  # a word can't reach back over a space that follows a visible character
_WHITE = re.compile(r"\s ")


def byte_letters() -> dict[str, int]:
    """The letters that byte-level vocabularies write for the 256 bytes."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """Ids, merge ranks and special strings of a tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        back = byte_letters()
        raw = lambda token: bytes(back[c] for c in token)
        self.ids = {raw(t): i for t, i in spec["model"]["vocab"].items()}
        pairs = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        self.letters = [self.ids[bytes([b])] for b in range(256)]
        # What two neighbouring ids merge to, ranked: (a, b) -> rank and merged id in one integer.
        self.merges = {self.ids[raw(a)] << SHIFT | self.ids[raw(b)]: rank << SHIFT | self.ids[raw(a) + raw(b)] for rank, (a, b) in enumerate(pairs)}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        size = 1 + max([*self.ids.values(), *self.special.values()])
        self.bytes_of = [b""] * size
        for token, i in self.ids.items():
            self.bytes_of[i] = token
        for token, i in self.special.items():
            self.bytes_of[i] = token.encode()
        # All tokens' bytes in one array, and where each token's begin and how many they are.
        self.sizes = np.array([len(b) for b in self.bytes_of], np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.sizes)[:-1]])
        self.every = np.frombuffer(b"".join(self.bytes_of), np.uint8)


def merge_word(word: bytes, vocabulary: Vocabulary) -> list[int]:
    """The ids of one word by exact merging: the lowest rank first, leftmost of equals."""
    letters, merged = vocabulary.letters, vocabulary.merges.get
    parts = [letters[b] for b in word]
    if len(parts) > 60:
        return _merge_long(parts, merged)
    pairs = [merged(a << SHIFT | b, NEVER) for a, b in zip(parts, parts[1:])]
    while pairs:
        best = min(pairs)
        if best == NEVER:
            break
        i = pairs.index(best)
        parts[i : i + 2] = [best & LOW]
        del pairs[i]
        if i < len(pairs):
            pairs[i] = merged(parts[i] << SHIFT | parts[i + 1], NEVER)
        if i:
            pairs[i - 1] = merged(parts[i - 1] << SHIFT | parts[i], NEVER)
    return parts


def _merge_long(parts: list, merged) -> list[int]:
    """The same by a heap of pairs over a doubly linked list, for words of any length."""
    after, before = [*range(1, len(parts)), -1], [-1, *range(len(parts) - 1)]
    heap = [(found, i, a, b) for i, (a, b) in enumerate(zip(parts, parts[1:])) if (found := merged(a << SHIFT | b)) is not None]
    heapq.heapify(heap)
    while heap:
        found, i, a, b = heapq.heappop(heap)
        j = after[i] if parts[i] is not None else -1
        if j < 0 or parts[i] != a or parts[j] != b:
            continue
        parts[i], parts[j] = found & LOW, None
        after[i] = after[j]
        if after[j] >= 0:
            before[after[j]] = i
        for left in (before[i], i):
            right = after[left] if left >= 0 else -1
            if right >= 0 and (found := merged(parts[left] << SHIFT | parts[right])) is not None:
                heapq.heappush(heap, (found, left, parts[left], parts[right]))
    return [p for p in parts if p is not None]


_PACK = [struct.Struct(f"<{n}I").pack for n in range(32)]


class _Memo(dict):
    """Ids, packed as little-endian 32-bit integers, of recent pieces; bounded."""

    def __init__(self, encode, head: str):
        super().__init__()
        self.encode, self.head = encode, head

    def __missing__(self, piece: str) -> bytes:
        packed = self.encode(self.head + piece)
        if len(piece) <= LONGEST_LEXICON_PIECE:
            if len(self) >= MEMO:
                self.clear()
            self[piece] = packed
        return packed


class Codec:
    """Encodes and decodes texts; one per worker process."""

    def __init__(self, vocabulary: Vocabulary, image: bytes):
        self.vocabulary, self.lexicon = vocabulary, Lexicon(image)
        self.find = regex.compile(PATTERN).findall
        self.spaced, self.bare = _Memo(self._pieces, " "), _Memo(self._pieces, "")
        self.special = re.compile("|".join(map(re.escape, vocabulary.special))) if vocabulary.special else None

    def _pieces(self, piece: str) -> bytes:
        out: list[int] = []
        body = piece[1:] if piece[:1] == " " else piece
        for word in (piece,) if body.isascii() and body.isalpha() else self.find(piece):  # letters behind one space are one word
            raw = word.encode()
            out += self.lexicon.get(raw) or merge_word(raw, self.vocabulary)
        return _PACK[len(out)](*out) if len(out) < 32 else np.array(out, "<u4").tobytes()

    def _plain(self, text: str) -> bytes:
        if not text:
            return b""
        pieces = _GAP.split(text) if _WHITE.search(text) else text.split(" ")
        return self.bare[pieces[0]] + b"".join(map(self.spaced.__getitem__, pieces[1:]))

    def encode(self, text: str) -> bytes:
        """The ids, packed as little-endian unsigned 32-bit integers."""
        if self.special is None or not self.special.search(text):
            return self._plain(text)
        out, at = [], 0
        for m in self.special.finditer(text):
            out += [self._plain(text[at : m.start()]), np.array([self.vocabulary.special[m.group()]], "<u4").tobytes()]
            at = m.end()
        return b"".join([*out, self._plain(text[at:])])

    def _bytes(self, ids: np.ndarray) -> bytes:
        sizes = self.vocabulary.sizes[ids]
        ends = np.cumsum(sizes)
        places = np.arange(ends[-1]) + np.repeat(self.vocabulary.starts[ids] - ends + sizes, sizes)
        return self.vocabulary.every[places].tobytes()

    def decode(self, packed: bytes) -> bytes:
        """The text of packed ids in UTF-8; invalid sequences become U+FFFD."""
        ids = np.frombuffer(packed, "<u4")
        raw = b"".join(self._bytes(ids[at : at + BLOCK]) for at in range(0, len(ids), BLOCK))
        try:
            raw.decode()
        except UnicodeDecodeError:
            return raw.decode("utf-8", "replace").encode()
        return raw


def codec(path: str, image: bytes) -> Codec:
    """This process's codec for a vocabulary and lexicon."""
    return held(("codec", path, hashlib.md5(image).hexdigest()), lambda: Codec(Vocabulary(path), image))


def lexicon_image(docs: DataFrame, vocabulary_path: str, text_col: str = "text", lexicon_words: int = LEXICON_WORDS) -> bytes:
    """Compile the words of the corpus's most frequent pieces, counted over all rows."""
    pieces = docs.select(F.explode(F.split(F.col(text_col), " ")).alias("piece")).where(F.length("piece").between(1, LONGEST_LEXICON_PIECE))
    counts = pinned(pieces.groupBy("piece").agg(F.count("*").alias("n")).where("n > 1"))
    every = counts.agg(F.sum("n")).first()[0] or 0
    frequent = counts.where(F.col("n") * lexicon_words >= every).collect()  # no more than `lexicon_words` can have that share
    vocabulary, find = Vocabulary(vocabulary_path), regex.compile(PATTERN).findall
    words = {w.encode() for row in frequent for w in find(" " + row["piece"])}
    return compile_image((w, tuple(merge_word(w, vocabulary))) for w in words)


CODED = "doc_id long, n_tokens long, ids binary, ids_sha256 string, decoded_sha256 string, round_trip boolean"


def encode_decode(docs: DataFrame, vocabulary_path: str, id_col: str = "doc_id", text_col: str = "text", lexicon_words: int = LEXICON_WORDS, with_ids: bool = True) -> DataFrame:
    """One row per document: its packed ids (if asked for), their digest, and that of the text they decode to."""
    chosen = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    image = docs.sparkSession.sparkContext.broadcast(lexicon_image(chosen, vocabulary_path, "text", lexicon_words))
    fields = [f for f in CODED.split(", ") if with_ids or not f.startswith("ids ")]
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), *[("ids", pa.binary())] * with_ids, ("ids_sha256", pa.string()), ("decoded_sha256", pa.string()), ("round_trip", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(vocabulary_path, image.value)
        for whole in batches:
            for at in range(0, whole.num_rows, 500):  # so few texts and their ids are held at a time
                batch = whole.slice(at, 500)
                rows = []
                for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    packed = own.encode(text)
                    back = own.decode(packed)
                    rows.append((doc, len(packed) // 4, *[packed] * with_ids, hashlib.sha256(packed).hexdigest(), hashlib.sha256(back).hexdigest(), back == text.encode()))
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return chosen.mapInArrow(run, ", ".join(fields))
