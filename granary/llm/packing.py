"""Packing token ids into fixed rows by best-fit-decreasing.

Documents are tokenized, split losslessly into segments of at most
``capacity`` ids, and dealt by a hash of the row's number to packs of about
``pack_mb`` of text. Each pack is packed on its own: its segments, longest
first, go to the row with the least room that still holds them, found in a
segment tree over room left; a row opens when none fits. Nothing is dropped.

One packed row has the id matrix row (``ids``: little-endian unsigned 32-bit,
padded with ``pad_id`` to the capacity), the cumulative segment lengths
(``cu_seqlens``, from 0), the position ids' resets (``positions``: packed like
the ids, 0 at each segment's start and over the padding), and the documents and
offsets its segments come from.

Defined results: null and empty texts have no tokens and no segment; repeated
rows are packed each for itself, in packs of their own; further columns are
ignored; an empty table gives an empty result. A table split otherwise into
partitions is dealt otherwise, with the same tokens in all.
"""

from __future__ import annotations

import base64
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CAPACITY = 2048
PACK_MB = 4
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class RoomTree:
    """A segment tree over capacities: leaf r holds how many open rows have room r."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.count = [0] * (2 * self.size)
        self.rows: list[list[int]] = [[] for _ in range(capacity + 1)]

    def add(self, room: int, row: int) -> None:
        self.rows[room].append(row)
        self._change(room, 1)

    def _change(self, room: int, by: int) -> None:
        at = room + self.size
        while at:
            self.count[at] += by
            at //= 2

    def take(self, need: int) -> tuple[int, int] | None:
        """Remove the row with the least room of at least ``need``: (room, row)."""
        at = need + self.size
        if not self.count[at]:
            while at > 1 and (at & 1 or not self.count[at + 1]):  # up to the first subtree on the right that has rows
                at //= 2
            if at <= 1:
                return None
            at += 1
            while at < self.size:
                at = 2 * at if self.count[2 * at] else 2 * at + 1
        room = at - self.size
        row = self.rows[room].pop()
        self._change(room, -1)
        return room, row


def best_fit(lengths: list[int], capacity: int) -> list[list[int]]:
    """Rows of segment numbers; lengths are in decreasing order, none above the capacity."""
    tree, rows = RoomTree(capacity), []
    for k, length in enumerate(lengths):
        found = tree.take(length)
        if found is None:
            rows.append([k])
            room, row = capacity, len(rows) - 1
        else:
            room, row = found
            rows[row].append(k)
        if room > length:
            tree.add(room - length, row)
    return rows


_ENCODERS: dict = {}


def encoder(path: str):
    if path not in _ENCODERS:
        with open(path, "rb") as file:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
        _ENCODERS[path] = tiktoken.Encoding("packing", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _ENCODERS[path]


def tokens(docs: DataFrame, ranks_path: str, packs: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(pack, doc_id, ids): packed unsigned 32-bit ids of each document that has any."""
    chosen = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"),
        F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(packs)).cast("int").alias("pack"),
    ).where("text != ''")
    schema = pa.schema([("pack", pa.int32()), ("doc_id", pa.int64()), ("ids", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(ranks_path).encode_ordinary
        for whole in batches:
            for at in range(0, whole.num_rows, 200):
                batch = whole.slice(at, 200)
                ids = [np.array(encode(text), "<u4").tobytes() for text in batch.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column(2).cast(pa.int32()), batch.column(0), pa.array(ids, pa.binary())], schema=schema)

    return chosen.mapInArrow(run, "pack int, doc_id long, ids binary")


PACKED = "pack int, row int, n_tokens int, n_segments int, ids binary, cu_seqlens array<int>, positions binary, doc_ids array<long>, offsets array<int>"


def pack(docs: DataFrame, ranks_path: str, capacity: int = CAPACITY, pad_id: int = 50256, pack_mb: int = PACK_MB, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per packed row; ``row`` numbers them within a pack."""
    total = docs.agg(F.sum(F.octet_length(F.col(text_col)))).first()[0] or 0
    packs = max(1, math.ceil(total / (pack_mb << 20)))
    coded = tokens(docs, ranks_path, packs, id_col, text_col)
    schema = pa.schema([
        ("pack", pa.int32()), ("row", pa.int32()), ("n_tokens", pa.int32()), ("n_segments", pa.int32()), ("ids", pa.binary()),
        ("cu_seqlens", pa.list_(pa.int32())), ("positions", pa.binary()), ("doc_ids", pa.list_(pa.int64())), ("offsets", pa.list_(pa.int32())),
    ])

    def finish(pack_id: int, docs_of: list[tuple]) -> Iterator[pa.RecordBatch]:
        docs_of.sort(key=lambda d: (d[0] is not None, d[0] or 0, d[1]))
        segments = [(min(capacity, len(raw) // 4 - at), d, at) for d, (_, raw) in enumerate(docs_of) for at in range(0, len(raw) // 4, capacity)]
        segments.sort(key=lambda s: (-s[0], s[1], s[2]))
        out = []
        for row, members in enumerate(best_fit([s[0] for s in segments], capacity)):
            ids, positions, ends = np.full(capacity, pad_id, "<u4"), np.zeros(capacity, "<u4"), [0]
            for k in members:
                length, d, at = segments[k]
                ids[ends[-1] : ends[-1] + length] = np.frombuffer(docs_of[d][1], "<u4", length, 4 * at)
                positions[ends[-1] : ends[-1] + length] = np.arange(length)
                ends.append(ends[-1] + length)
            out.append((pack_id, row, ends[-1], len(members), ids.tobytes(), ends, positions.tobytes(), [docs_of[segments[k][1]][0] for k in members], [segments[k][2] for k in members]))
            if len(out) == 500:
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Packs come one after another; one is held at a time."""
        now, held = None, []
        for batch in batches:
            for pack_id, doc, ids in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if pack_id != now:
                    if held:
                        yield from finish(now, held)
                    now, held = pack_id, []
                held.append((doc, ids))
        if held:
            yield from finish(now, held)

    parts = max(1, min(packs, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    return coded.repartitionById(parts, F.col("pack") % parts).sortWithinPartitions("pack").mapInArrow(run, PACKED)
