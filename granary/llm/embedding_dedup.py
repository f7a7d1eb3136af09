"""Embedding near-deduplication by Euclidean p-stable hashing and exact cosine checks.

Valid vectors are scaled to unit length, and equal vectors with equal labels
collapse into one class. Each of several tables hashes a class by quantised
Gaussian projections, ``floor((a . v + b) / width)``. The number of projections
follows the largest label's size so that about ``BUCKET`` unrelated classes share
a bucket, and the number of tables follows from that so that a pair right at the
threshold meets with probability ``recall``.

What is dealt to the buckets is narrow: a class's number and 128 signs of random
projections. A class goes on where another of its bucket has nearly the same
signs (a pair at the threshold differs in about 15 of them and in more than
``SIGNS`` with a probability of some millionths; unrelated ones in 64), or where
the bucket holds more than ``block`` classes. Only those meet their vectors,
which are then compared exactly in double precision.

A pair that meets in several tables counts in the first one only, told from the
class's keys; so links are counted without a list of pairs, and only counts and
spanning forests leave a task.

Defined results: vectors that are null, empty, zero, or hold null or non-finite
components, and rows without label, link with nothing and stay; vectors of
different lengths don't link; repeated rows and ids are vectors of their own;
a null id takes no part in a minimum; further columns are ignored; an empty
table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.llm.links import Forest, blocked, by_group, components, near_pairs, rejoin
from granary.session import pinned

COSINE = 0.93
WIDTH = 2.5
RECALL = 0.985
BUCKET = 64
SIGNS = 36
BLOCK = 2048
SEED = 20_24


def meet_chance(distance: float, width: float = WIDTH) -> float:
    """The chance that one quantised projection agrees on two points at a distance."""
    r = width / distance
    tail = 0.5 * math.erfc(r / math.sqrt(2))
    return 1 - 2 * tail - 2 / (math.sqrt(2 * math.pi) * r) * (1 - math.exp(-r * r / 2))


def parameters(largest: int, cosine: float, recall: float = RECALL) -> tuple[int, int]:
    """Projections per table, and tables, for a label of so many classes."""
    near, far = meet_chance(math.sqrt(2 - 2 * cosine)), meet_chance(math.sqrt(2))
    width = max(4, math.ceil(math.log(max(largest, 2 * BUCKET) / BUCKET) / -math.log(far)))
    return width, math.ceil(math.log(1 - recall) / math.log(1 - near**width))


def packed(v: np.ndarray) -> bytes:
    """A vector as bytes: in single precision where that holds it exactly, else in double."""
    with np.errstate(over="ignore"):
        short = v.astype("<f4")
    return b"f" + short.tobytes() if (short.astype("<f8") == v).all() else b"d" + v.tobytes()


def unit(raw: bytes) -> np.ndarray:
    """The packed vector at unit length, in double precision."""
    v = np.frombuffer(raw, "<f4" if raw[:1] == b"f" else "<f8", offset=1).astype("<f8")
    v = v / np.abs(v).max()
    return v / np.sqrt((v * v).sum())


def prepare(vectors: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """(vec_id, label, vkey, raw): the packed vector and the key of vector and label, null if it can't link."""
    chosen = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("string").alias("label"), F.col(vector_col).cast("array<double>").alias("v"))
    schema = pa.schema([("vec_id", pa.int64()), ("label", pa.string()), ("vkey", pa.binary()), ("raw", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            labels, keys, raws = batch.column(1).to_pylist(), [], []
            for label, v in zip(labels, batch.column(2), strict=True):
                key = raw = None
                if label is not None and v.is_valid and len(v.values):
                    own = v.values.to_numpy(zero_copy_only=False).astype("<f8") + 0.0  # a missing component becomes NaN
                    top = np.abs(own).max()
                    if np.isfinite(top) and top > 0:
                        raw = packed(own)
                        key = hashlib.blake2b(len(own).to_bytes(8, "little") + own.tobytes() + label.encode(), digest_size=16).digest()
                keys.append(key)
                raws.append(raw)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(keys, pa.binary()), pa.array(raws, pa.binary())], schema=schema)

    return chosen.mapInArrow(run, "vec_id long, label string, vkey binary, raw binary")


def hashed(classes: DataFrame, projections: int, tables: int) -> DataFrame:
    """(cid, keys, signs): each class's keys in all tables, and 128 signs."""
    schema = pa.schema([("cid", pa.int64()), ("keys", pa.binary()), ("signs", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[int, tuple] = {}
        mix = np.random.default_rng(SEED).integers(1, 1 << 62, (tables, projections), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                batch = whole.slice(at, 1000)
                units, sizes = [unit(r) for r in batch.column(2).to_pylist()], {}
                for row, v in enumerate(units):
                    sizes.setdefault(len(v), []).append(row)
                keys, signs = np.zeros((len(units), tables), np.uint64), np.zeros((len(units), 16), np.uint8)
                for size, rows in sizes.items():
                    if size not in planes:
                        draw = np.random.default_rng([SEED, size])
                        planes[size] = draw.standard_normal((size, tables * projections)), draw.uniform(0, WIDTH, tables * projections), draw.standard_normal((size, 128))
                    plane, shift, halves = planes[size]
                    points = np.stack([units[r] for r in rows])
                    cells = np.floor((points @ plane + shift) / WIDTH).astype(np.int64).view(np.uint64).reshape(len(rows), tables, projections)
                    keys[rows] = (cells * mix).sum(axis=2, dtype=np.uint64) + np.uint64(size)
                    signs[rows] = np.packbits(points @ halves > 0, axis=1)
                salt = np.array([int.from_bytes(hashlib.blake2b(x.encode(), digest_size=8).digest(), "little") for x in batch.column(1).to_pylist()], np.uint64)
                keys ^= salt[:, None]
                yield pa.RecordBatch.from_arrays([batch.column(0), _bytes(keys), _bytes(signs)], schema=schema)

    return classes.select("cid", "label", "raw").mapInArrow(run, "cid long, keys binary, signs binary")


def _bytes(rows: np.ndarray) -> pa.Array:
    """Each row's values as one binary value."""
    n, width = rows.shape
    offsets = np.arange(n + 1, dtype=np.int32) * (rows.itemsize * width)
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(rows).tobytes())])


def dealt(keyed: DataFrame, tables: int) -> DataFrame:
    """A row per class and table: (place, key, cid, signs)."""
    schema = pa.schema([("place", pa.int32()), ("key", pa.int64()), ("cid", pa.int64()), ("signs", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                batch = whole.slice(at, 1000)
                keys = np.frombuffer(b"".join(batch.column(1).to_pylist()), "<i8").reshape(batch.num_rows, tables)
                for t in range(tables):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(batch.num_rows, t), pa.int32()), pa.array(np.ascontiguousarray(keys[:, t]), pa.int64()), batch.column(0), batch.column(2)], schema=schema)

    return keyed.select("cid", "keys", "signs").mapInArrow(run, "place int, key long, cid long, signs binary")


def company(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """(place, key, cid) of the rows with another of nearly the same signs in their bucket, and of all in large buckets."""
    schema = pa.schema([("place", pa.int32()), ("key", pa.int64()), ("cid", pa.int64())])
    none = {c: F.lit(0) for c in ("blk_a", "blk_b", "side")}

    def handle(table: pa.Table, bounds: np.ndarray) -> Iterator[pa.RecordBatch]:
        sizes = np.diff(bounds)
        few = np.repeat((sizes > 1) & (sizes <= block), sizes)
        goes = np.repeat(sizes > block, sizes)
        if few.any():
            at, kept = np.flatnonzero(few), sizes[(sizes > 1) & (sizes <= block)]
            signs = np.frombuffer(b"".join(table.column("signs").take(pa.array(at)).to_pylist()), "<u8").reshape(len(at), 2)
            near = np.zeros(len(at), bool)
            for whole_i, whole_j in near_pairs(np.concatenate([[0], np.cumsum(kept)]), np.zeros(len(at), np.int64), 48):
                for a in range(0, len(whole_i), 1 << 18):
                    i, j = whole_i[a : a + (1 << 18)], whole_j[a : a + (1 << 18)]
                    close = np.bitwise_count(signs[i] ^ signs[j]).sum(axis=1) <= SIGNS
                    near[i[close]] = near[j[close]] = True
            goes[at[near]] = True
        chosen = table.select(["place", "key", "cid"]).filter(pa.array(goes)).cast(schema)
        yield from chosen.combine_chunks().to_batches()

    return by_group(rows.withColumns(none), ["place", "key"], ["cid"], handle, "place int, key long, cid long", ["place", "key", "cid", "signs"])


FOUND = pa.schema([("cid", pa.int64()), ("links", pa.int64()), ("parent", pa.int64())])


def compare(rows: DataFrame, cosine: float, tables: int, block: int = BLOCK) -> DataFrame:
    """(cid, links, parent): partial counts of linked vectors, and links of a spanning forest (else null)."""
    rows = blocked(rows, ["place", "key"], "cid", block)

    def handle(table: pa.Table, bounds: np.ndarray) -> Iterator[pa.RecordBatch]:
        sizes = np.diff(bounds)
        if sizes.max() < 2:
            return
        cid, n, side, place = (table.column(c).to_numpy() for c in ("cid", "n", "side", "place"))
        units = [unit(r) for r in table.column("raw").to_pylist()]
        counts, forest = np.zeros(len(cid), np.int64), Forest(len(cid))
        size = np.array([len(u) for u in units])
        points = np.zeros((len(cid), int(size.max())))
        for row, u in enumerate(units):
            points[row, : len(u)] = u
        every = np.frombuffer(b"".join(table.column("keys").to_pylist()), "<u8").reshape(len(cid), tables)
        _, name = np.unique(np.array(table.column("label").to_pylist(), object).astype(str), return_inverse=True)
        about = lambda a, b: points[a] @ points[b].T >= cosine - 1e-9
        for whole_i, whole_j in near_pairs(bounds, side, 32, about):
            for at in range(0, len(whole_i), 1 << 15):
                i, j = whole_i[at : at + (1 << 15)], whole_j[at : at + (1 << 15)]
                fit = (name[i] == name[j]) & (size[i] == size[j])
                i, j = i[fit], j[fit]
                close = np.einsum("ij,ij->i", points[i], points[j]) >= cosine
                i, j = i[close], j[close]
                forest.link(i, j)
                seen = ((every[i] == every[j]) & (np.arange(tables) < place[i][:, None])).any(axis=1)
                i, j = i[~seen], j[~seen]
                np.add.at(counts, i, n[j])
                np.add.at(counts, j, n[i])
        root = cid[forest.root]
        some = (counts > 0) | (root != cid)
        yield pa.RecordBatch.from_arrays([pa.array(cid[some]), pa.array(counts[some]), pa.array(root[some], mask=(root == cid)[some])], schema=FOUND)

    return by_group(rows, ["place", "key"], ["cid"], handle, "cid long, links long, parent long", ["cid", "n", "place", "label", "raw", "keys"])


def linked(classes: DataFrame, cosine: float, projections: int, tables: int, block: int = BLOCK) -> DataFrame:
    """:func:`compare` of the classes (cid, n, label, raw) that meet in some table."""
    keyed = pinned(hashed(classes, projections, tables))
    met = pinned(company(dealt(keyed, tables), block))
    vectors = classes.select("cid", "n", "label", "raw").join(keyed.select("cid", "keys"), "cid")
    return compare(met.join(vectors, "cid"), cosine, tables, block)


def near_dedup(vectors: DataFrame, cosine: float = COSINE, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept."""
    rows = pinned(prepare(vectors, id_col, vector_col, label_col))
    classes = rows.where("vkey is not null").groupBy("vkey").agg(F.count("*").alias("n"), F.min("vec_id").alias("least"), F.first("label").alias("label"), F.first("raw").alias("raw"))
    classes = pinned(classes.withColumn("cid", F.monotonically_increasing_id()))
    largest = classes.groupBy("label").count().agg(F.max("count")).first()[0] or 0
    found = pinned(linked(classes, cosine, *parameters(largest, cosine)))
    counts = found.groupBy("cid").agg(F.sum("links").alias("links"))
    tree = found.where("parent is not null").select(F.greatest("cid", "parent").alias("child"), F.least("cid", "parent").alias("parent"))
    roots = components(tree)
    rooted = classes.select("cid", "vkey", "n", "least").join(roots, F.col("cid") == F.col("node"), "left").select("cid", "vkey", "n", "least", F.coalesce("root", "cid").alias("root"))
    rooted = pinned(rooted.join(counts, "cid", "left").select("vkey", "n", "root", "least", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links")))
    least = pinned(rooted.groupBy("root").agg(F.min("least").alias("component_id")))
    named = pinned(rooted.join(least, "root").select("vkey", "n", "n_links", "component_id"))
    alone = rows.where("vkey is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    out = rejoin(rows.where("vkey is not null").select("vec_id", "vkey"), named, "vkey", "n").select("vec_id", "n_links", "component_id").unionByName(alone)
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
