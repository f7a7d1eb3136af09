"""Exact deduplication over a cuckoo-filter index of live digests.

Every row is reduced to the SHA-256 digest and byte length of its whole text.
Each input partition runs a :class:`CuckooIndex` over its own rows, so a text
repeated a billion times leaves at most one row per partition; those are dealt
by digest and a second index merges them. A row that wins over the live one
deletes it from the index and is inserted in its place.

Hits are then verified against the content (:func:`clashes`): the texts under
each digest that was hit meet in one bucket, once per partition and distinct
text, and a digest under which texts differ is grouped by the texts themselves.

Defined results: a null text is an empty text; a null id is smaller than any
id; of rows equal in text and id the one with the largest hash of all columns
stays, and of rows equal in all columns one; an empty table gives an empty
result; further columns are ignored or, in :func:`keep_rows`, kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.llm.links import rejoin
from granary.llm.rows import FEW, likeness, numbered, without
from granary.llm.workers import release
from granary.session import pinned

SLOTS = 4
MAX_KICKS = 200


class CuckooIndex:
    """Cuckoo filter over live keys, with the stored keys beside it.

    ``table`` holds entry numbers (0: free) in buckets of four slots, and
    ``marks`` the 16-bit fingerprint of each; a mark that answers a probe is
    verified against the stored key, so a false positive never counts as a hit.
    A failed insertion doubles the table and deals the stored keys anew.
    """

    def __init__(self, buckets: int = 256):
        self.entries: list = [None]  # [key, payload]; None once deleted
        self.free: list[int] = []
        self.live = 0
        self._clear(buckets)

    def _clear(self, buckets: int) -> None:
        self.mask = buckets - 1
        self.table = [0] * (buckets * SLOTS)
        self.marks = [0] * (buckets * SLOTS)

    def _places(self, key: bytes) -> tuple[int, int, int]:
        hashed = hash(key)
        mark = hashed & 0xFFFF | 1
        home = hashed >> 16 & self.mask
        return mark, home, self._other(home, mark)

    def _other(self, bucket: int, mark: int) -> int:
        return (bucket ^ (mark * 0x5BD1E995)) & self.mask

    def _slot(self, key: bytes) -> int:
        mark, a, b = self._places(key)
        marks = self.marks
        for at in (a * SLOTS, b * SLOTS):
            for i in range(at, at + SLOTS):
                if marks[i] == mark and self.entries[self.table[i]][0] == key:
                    return i
        return -1

    def get(self, key: bytes):
        """The payload of a live key, or None."""
        slot = self._slot(key)
        return None if slot < 0 else self.entries[self.table[slot]][1]

    def delete(self, key: bytes) -> bool:
        slot = self._slot(key)
        if slot < 0:
            return False
        number = self.table[slot]
        self.table[slot] = self.marks[slot] = 0
        self.entries[number] = None
        self.free.append(number)
        self.live -= 1
        return True

    def update(self, key: bytes, payload) -> None:
        """Replace the payload of a live key."""
        self.entries[self.table[self._slot(key)]] = (key, payload)

    def insert(self, key: bytes, payload) -> None:
        """Add a key that isn't live."""
        if self.free:
            number = self.free.pop()
            self.entries[number] = (key, payload)
        else:
            number = len(self.entries)
            self.entries.append((key, payload))
        self.live += 1
        if self.live * 10 > len(self.table) * 9 or not self._place(number):
            self._resize()

    def _place(self, number: int) -> bool:
        mark, a, b = self._places(self.entries[number][0])
        for bucket in (a, b):
            for i in range(bucket * SLOTS, bucket * SLOTS + SLOTS):
                if not self.marks[i]:
                    self.table[i], self.marks[i] = number, mark
                    return True
        bucket = a
        for kick in range(MAX_KICKS):
            i = bucket * SLOTS + kick % SLOTS
            number, self.table[i] = self.table[i], number
            mark, self.marks[i] = self.marks[i], mark
            bucket = self._other(bucket, mark)
            for i in range(bucket * SLOTS, bucket * SLOTS + SLOTS):
                if not self.marks[i]:
                    self.table[i], self.marks[i] = number, mark
                    return True
        return False

    def _resize(self) -> None:
        buckets = (self.mask + 1) * 2
        while True:
            self._clear(buckets)
            if all(self._place(n) for n, entry in enumerate(self.entries) if entry is not None):
                return
            buckets *= 2

    def items(self) -> Iterator[tuple]:
        return (entry for entry in self.entries if entry is not None)


GROUP = "digest binary, n_bytes long, keep_id long, keep_like long, keep_file binary, keep_index long, group_size long"
_ARROW = pa.schema([("digest", pa.binary()), ("n_bytes", pa.int64()), ("keep_id", pa.int64()), ("keep_like", pa.int64()), ("keep_file", pa.binary()), ("keep_index", pa.int64()), ("group_size", pa.int64())])


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each digest the row with the largest (id, likeness, file, index) stays live; sizes add up."""
    release()
    index = CuckooIndex()
    for batch in batches:
        for digest, n_bytes, doc, like, file, number, size in zip(*(batch.column(i).to_pylist() for i in range(7)), strict=True):
            key = digest + n_bytes.to_bytes(8, "little")
            rank = (doc is not None, doc or 0, like, file, number)
            live = index.get(key)
            if live is None:
                index.insert(key, (rank, size))
            elif rank > live[0]:
                index.delete(key)
                index.insert(key, (rank, size + live[1]))
            else:
                index.update(key, (live[0], size + live[1]))
    found: list = []
    for key, (rank, size) in index.items():
        found.append((key[:-8], int.from_bytes(key[-8:], "little"), rank[1] if rank[0] else None, *rank[2:], size))
        if len(found) == 10_000:
            yield _batch(found)
            found = []
    if found:
        yield _batch(found)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), _ARROW, strict=True)], schema=_ARROW)


def digests(docs: DataFrame, id_col: str, text_col: str, like: Column, file: Column, index: Column, bits: int) -> DataFrame:
    """(doc_id, digest, n_bytes, like, file, index, content): ``content`` is the whole text."""
    text = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    return docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.substring(F.unhex(F.sha2(text, 256)), 1, bits // 8).alias("digest"),
        F.octet_length(text).cast("long").alias("n_bytes"),
        like.alias("like"),
        file.cast("binary").alias("file"),
        index.cast("long").alias("index"),
        text.alias("content"),
    )


def clashes(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """(digest, n_bytes) of the groups whose texts are not all equal; ``rows`` have the content."""
    hit = pinned(groups.where("group_size > 1").select("digest", "n_bytes"))
    hit = F.broadcast(hit) if hit.count() <= FEW else hit
    # Equal texts collapse in each partition before any of them moves.
    buckets = rows.join(hit, ["digest", "n_bytes"], "left_semi").groupBy("digest", "n_bytes", "content").agg(F.lit(1).alias("one"))
    return buckets.groupBy("digest", "n_bytes").agg(F.count("*").alias("texts")).where("texts > 1").select("digest", "n_bytes")


def _grouped(docs: DataFrame, id_col: str, text_col: str, like: Column, file: Column, index: Column, bits: int) -> DataFrame:
    """One row per input row: doc_id, digest, n_bytes, file, index, keep_id, group_size, kept."""
    whole = digests(docs, id_col, text_col, like, file, index, bits)
    rows = pinned(whole.drop("content"))
    local = rows.select("digest", "n_bytes", F.col("doc_id").alias("keep_id"), F.col("like").alias("keep_like"), F.col("file").alias("keep_file"), F.col("index").alias("keep_index"), F.lit(1).cast("long").alias("group_size"))
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    groups = pinned(local.mapInArrow(_merge, GROUP).repartition(parts, "digest").mapInArrow(_merge, GROUP))
    key = F.struct("digest", "n_bytes")
    joined = rejoin(rows.withColumn("key", key), groups.select(key.alias("key"), "keep_id", "keep_file", "keep_index", "group_size"), "key", "group_size")
    kept = (F.col("file") == F.col("keep_file")) & (F.col("index") == F.col("keep_index"))
    out = joined.select("doc_id", "digest", "n_bytes", "file", "index", "keep_id", "group_size", kept.alias("kept"))
    clashing = pinned(clashes(whole, groups))
    if not clashing.count():
        return out
    apart = pinned(whole.join(clashing, ["digest", "n_bytes"], "left_semi"))
    rank = F.struct(F.col("doc_id").isNotNull(), "doc_id", "like", "file", "index")
    texts = apart.groupBy("digest", "content").agg(F.max(rank).alias("top"), F.count("*").alias("group_size"))
    apart = apart.join(texts, ["digest", "content"]).select("doc_id", "digest", "n_bytes", "file", "index", F.col("top.doc_id").alias("keep_id"), "group_size", (rank == F.col("top")).alias("kept"))
    return out.join(clashing, ["digest", "n_bytes"], "left_anti").unionByName(apart)


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits: int = 256) -> DataFrame:
    """One row per input row: doc_id, digest (its first ``bits``), n_bytes, keep_id, group_size, kept."""
    return _grouped(docs, id_col, text_col, likeness(docs), F.lit(b""), F.monotonically_increasing_id(), bits).drop("file", "index")


def keep_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits: int = 256) -> DataFrame:
    """The input's rows that stay, with the input's columns."""
    rows, file, index = numbered(docs)
    found = _grouped(rows, id_col, text_col, likeness(docs), F.col(file), F.col(index), bits)
    return without(rows, found.where("not kept"), file, index)
