"""What the near-duplicate operators share: bounded bucket comparison and components.

Rows that share a bucket key are compared in blocks. A bucket of more than
``block`` rows is split by a hash into blocks, and every pair of blocks becomes
a group of its own, so no group exceeds two blocks whatever share of the rows
one bucket holds, and every pair of rows still meets. A group's links are
reduced to a spanning forest before they leave the task: its output is linear
in its rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.session import pinned

FEW = 20_000
SHARE = 1000


def blocked(rows: DataFrame, keys: list[str], member: str, block: int) -> DataFrame:
    """Add ``blk_a``, ``blk_b`` and ``side`` (0: in blk_a, 1: in blk_b), a row for each pair of blocks it takes part in."""
    large = pinned(rows.groupBy(*keys).agg(F.count("*").alias("held")).where(F.col("held") > block))
    found = large.count()
    if not found:
        return rows.withColumns({"blk_a": F.lit(0), "blk_b": F.lit(0), "side": F.lit(0)})
    # A few keys go to all tasks; more than that meet the rows in a join that Spark can split where a key is hot.
    split = rows.join(F.broadcast(large) if found <= FEW else large, keys, "left").withColumn("blocks", F.coalesce(F.ceil(F.col("held") * 1.1 / block), F.lit(1)).cast("int"))
    split = split.withColumn("own", F.pmod(F.xxhash64(F.lit("block"), member), F.col("blocks")).cast("int"))
    split = split.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return split.withColumns({"blk_a": F.least("own", "other"), "blk_b": F.greatest("own", "other"), "side": (F.col("own") > F.col("other")).cast("int")}).drop("held", "blocks", "own", "other")


def by_group(rows: DataFrame, keys: list[str], order: list[str], handle: Callable, schema: str, columns: list[str]) -> DataFrame:
    """Deal groups out and call ``handle(columns, bounds)`` on runs of whole groups.

    ``columns`` arrive as arrow arrays in the order given; ``bounds`` are the offsets at
    which the groups begin, and the end. ``handle`` yields record batches.
    """
    group = [*keys, "blk_a", "blk_b"]
    dealt = rows.select(*group, "side", *columns).repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *group)
    dealt = dealt.sortWithinPartitions(*group, *order).select(F.xxhash64(*group).alias("g"), "side", *columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            part = pa.Table.from_batches([batch])
            g = part.column("g").to_numpy()
            other = np.flatnonzero(g != g[-1])
            cut = int(other[-1]) + 1 if len(other) else 0  # the last group may go on
            if cut or (held and held[-1].column("g")[-1].as_py() != g[0]):
                yield from _runs(pa.concat_tables([*held, part.slice(0, cut)]).combine_chunks(), handle)
                held = []
            held.append(part.slice(cut))
        if held:
            yield from _runs(pa.concat_tables(held).combine_chunks(), handle)

    return dealt.mapInArrow(run, schema)


def _runs(table: pa.Table, handle: Callable) -> Iterator[pa.RecordBatch]:
    if table.num_rows:
        g = table.column("g").to_numpy()
        bounds = np.concatenate([[0], np.flatnonzero(g[1:] != g[:-1]) + 1, [len(g)]])
        yield from handle(table, bounds)


def near_pairs(bounds: np.ndarray, side: np.ndarray, most: int, about: Callable | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions (i, j), i < j, of all pairs within groups that are to be compared, in bounded batches.

    Small groups are paired all at once by their distance; larger ones in slabs, where
    ``about(rows, columns)`` may leave out pairs that can't link (a matrix of booleans).
    A group of two blocks pairs only rows of different sides.
    """
    about = about or (lambda a, b: np.ones((len(a), len(b)), bool))
    sizes = np.diff(bounds)
    small = sizes <= most
    starts, ends = bounds[:-1][small], bounds[1:][small]
    rows = _rows_of(starts, ends)
    last = np.repeat(ends, ends - starts)
    two = np.repeat(np.add.reduceat(side, bounds[:-1]) > 0, sizes) if len(side) else np.zeros(0, bool)  # of groups of two blocks
    for gap in range(1, int(sizes[small].max(initial=1))):
        fits = rows + gap < last
        rows, last = rows[fits], last[fits]
        if not len(rows):
            break
        meet = ~two[rows] | (side[rows] != side[rows + gap])
        yield rows[meet], rows[meet] + gap
    for a, b in zip(bounds[:-1][~small], bounds[1:][~small]):
        own = side[a:b]
        if own.any():
            left, right = a + np.flatnonzero(own == 0), a + np.flatnonzero(own == 1)
            for at in range(0, len(left), 256):
                i, j = np.nonzero(about(left[at : at + 256], right))
                i, j = left[at : at + 256][i], right[j]
                yield np.minimum(i, j), np.maximum(i, j)
        else:
            for at in range(a, b, 256):
                block = np.arange(at, min(at + 256, b))
                rest = np.arange(at, b)
                i, j = np.nonzero(about(block, rest))
                i, j = block[i], rest[j]
                keep = i < j
                yield i[keep], j[keep]


def _rows_of(starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    lengths = ends - starts
    return np.arange(lengths.sum()) + np.repeat(starts - np.concatenate([[0], np.cumsum(lengths)[:-1]]), lengths)


class Forest:
    """Union of links among n positions; the smallest position of a tree is its root."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def link(self, i: np.ndarray, j: np.ndarray) -> None:
        root = self.root
        while len(i):
            a, b = root[i], root[j]
            low, high = np.minimum(a, b), np.maximum(a, b)
            apart = low != high
            i, j, low, high = i[apart], j[apart], low[apart], high[apart]
            np.minimum.at(root, high, low)
            while True:
                up = root[root]
                if (up == root).all():
                    break
                root = up
        self.root = root


def components(links: DataFrame) -> DataFrame:
    """(node, root) of every node in a table of links (child, parent), child > parent.

    Alternating large-star and small-star steps, each a pre-aggregated minimum and
    one join that Spark can split where a root has many children; the root is the
    smallest node. Every step is written to the shared checkpoint folder.
    """
    links = pinned(links.distinct())
    mark = _mark(links)
    while mark[0]:
        least = pinned(links.groupBy(F.col("child").alias("node")).agg(F.min("parent").alias("least")))
        large = links.join(least, links["parent"] == least["node"], "left").select("child", F.coalesce("least", "parent").alias("parent"))
        links = pinned(large.distinct())
        least = pinned(links.groupBy(F.col("child").alias("node")).agg(F.min("parent").alias("least")))
        met = links.join(least, links["child"] == least["node"])
        pairs = F.array(F.struct(F.col("child"), F.col("least").alias("parent")), F.struct(F.col("parent").alias("child"), F.col("least").alias("parent")))
        small = met.select(F.explode(pairs).alias("e")).select("e.child", "e.parent").where("child > parent")
        links = pinned(small.distinct())
        now = _mark(links)
        if now == mark:
            break
        mark = now
    return links.select(F.col("child").alias("node"), F.col("parent").alias("root"))


def rejoin(rows: DataFrame, found: DataFrame, key: str, held: str) -> DataFrame:
    """Rows with what was found for their key; ``held`` is how many rows have it.

    Keys that hold more than ``1 / SHARE`` of all rows, of which there are fewer than
    ``SHARE``, are broadcast; what remains to be shuffled has no hot key.
    """
    heavy = F.col(held) * SHARE > rows.count()
    large, small = found.where(heavy), found.where(~heavy)
    hot = rows.join(F.broadcast(large), key)
    return hot.unionByName(rows.join(F.broadcast(large.select(key)), key, "left_anti").join(small, key))


def _mark(links: DataFrame) -> tuple:
    row = links.agg(F.count("*"), F.coalesce(F.bit_xor(F.xxhash64("child", "parent")), F.lit(0)), F.coalesce(F.sum(F.xxhash64("parent", "child").cast("decimal(38,0)")), F.lit(0))).first()
    return tuple(row)
