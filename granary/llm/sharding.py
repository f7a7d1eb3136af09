"""Sharding by a minimax contiguous partition of ordered atomic groups.

Rows with equal texts form an atomic group; groups are ordered by the first 60
bits of their text's MD5 (texts that share those stay together). The smallest
shard capacity for which a greedy cut of that order needs no more shards than
there are is found by binary search, exactly over the groups, though the driver
never sees them all: it holds a list of intervals of the order with their sizes.
A search that lets intervals be cut anywhere bounds the capacity from below, one
that cuts only between them from above; the intervals in which the two searches
leave a cut open are split ``SPLIT``-fold, and so on until the bounds meet. At
most some ``2 * shards ** 2`` intervals are open at a time, whatever the input.

A group above the fair share forces the capacity alone; it gets a shard of its
own and the search runs over the rest with the shards left, so that one huge
group doesn't leave later shards empty.

Defined results: a null text weighs nothing but the row overhead and is a group
of its own with the empty text; null ids sort first; repeated rows are
interchangeable; further columns are ignored; an empty table gives an empty
result.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.llm.prefix import cell_count, cell_of, cell_totals, hash_key, within_cell
from granary.session import pinned

OVERHEAD = 16
BITS = 60  # of the order
CELLS = 1 << 14  # intervals at first
SPLIT = 1 << 6


def greedy_cuts(sizes: np.ndarray, capacity: int, shards: int) -> list[int] | None:
    """Ends of at most ``shards`` runs of total at most ``capacity``; None if it can't be."""
    sums = np.concatenate([[0], np.cumsum(sizes)])
    at, ends = 0, []
    while at < len(sizes):
        end = int(np.searchsorted(sums, sums[at] + capacity, side="right")) - 1
        if end == at or len(ends) == shards:
            return None
        ends.append(end)
        at = end
    return ends


def minimax_cuts(sizes: np.ndarray, shards: int) -> tuple[int, list[int]]:
    """The smallest feasible capacity and its greedy cuts."""
    if not len(sizes):
        return 0, []
    total, most = int(sizes.sum()), int(sizes.max())
    low, high = max(most, -(-total // shards)), -(-total // shards) + most
    while low < high:
        middle = (low + high) // 2
        if greedy_cuts(sizes, middle, shards) is None:
            low = middle + 1
        else:
            high = middle
    return low, greedy_cuts(sizes, low, shards)


def fluid_cuts(sizes: np.ndarray, whole: np.ndarray, capacity: int, shards: int) -> list[int] | None:
    """Where greedy cuts fall at best, in units of size, if only the intervals marked ``whole`` can't be cut."""
    sums = np.concatenate([[0], np.cumsum(sizes)])
    at, ends = 0, []
    while at < sums[-1]:
        if len(ends) == shards:
            return None
        goal = at + capacity
        if goal < sums[-1]:
            inside = int(np.searchsorted(sums, goal, side="right")) - 1
            if whole[inside] and sums[inside] < goal:
                goal = int(sums[inside])
        if goal <= at:
            return None
        at = min(goal, int(sums[-1]))
        ends.append(at)
    return ends


def fluid_capacity(sizes: np.ndarray, whole: np.ndarray, shards: int, high: int) -> int:
    """The smallest capacity that :func:`fluid_cuts` finds feasible; ``high`` is feasible."""
    low = max(int(sizes[whole].max(initial=0)), -(-int(sizes.sum()) // shards))
    while low < high:
        middle = (low + high) // 2
        if fluid_cuts(sizes, whole, middle, shards) is None:
            low = middle + 1
        else:
            high = middle
    return low


def unsure_intervals(sizes: np.ndarray, whole: np.ndarray, shards: int) -> tuple[np.ndarray, list[int]]:
    """The intervals to be split before the cuts are certain (none: they are), and the cuts between intervals.

    The k-th cut lies no earlier than that of the strict search at the lower bound of the
    capacity, and no later than that of the fluid search at the upper bound.
    """
    high, ends = minimax_cuts(sizes, shards)
    low = fluid_capacity(sizes, whole, shards, high)
    sums = np.concatenate([[0], np.cumsum(sizes)])
    latest = fluid_cuts(sizes, whole, high, shards) or []
    latest += [int(sums[-1])] * (shards - len(latest))
    unsure, at = np.zeros(len(sizes) + 1, bool), 0
    for last in latest:
        at = int(np.searchsorted(sums, sums[at] + low, side="right")) - 1
        unsure[at : int(np.searchsorted(sums, last, side="left"))] = True
    return np.flatnonzero(unsure[:-1] & ~whole), ends


def cuts(groups: DataFrame, shards: int, cells: int = CELLS, split: int = SPLIT) -> list[int]:
    """The places of the order at which shards after the first begin; ``groups`` has a row for each place, with its size."""
    wide, step = cells.bit_length() - 1, split.bit_length() - 1
    spark = groups.sparkSession

    def opened(rows: DataFrame, depth: int) -> list[tuple]:
        """(first place, depth, size, whether one group) of the intervals that hold groups."""
        cell = F.shiftright("place", BITS - depth)
        found = rows.groupBy(cell.alias("cell")).agg(F.sum("size").alias("size"), F.count("*").alias("n")).collect()
        return [(r["cell"] << (BITS - depth), depth, r["size"], r["n"] == 1) for r in found]

    held = sorted(opened(groups, wide))  # at most `cells` rows
    while True:
        sizes, whole = np.array([x[2] for x in held], np.int64), np.array([x[3] for x in held], bool)
        unsure, ends = unsure_intervals(sizes, whole, shards)
        if not len(unsure):
            return [held[e][0] for e in ends if e < len(held)]
        chosen = [held[k] for k in unsure]
        new = []
        for depth in sorted({x[1] for x in chosen}):
            cells_here = spark.createDataFrame([(x[0] >> (BITS - depth),) for x in chosen if x[1] == depth], "cell long")
            inside = groups.join(F.broadcast(cells_here), F.shiftright("place", BITS - depth) == F.col("cell"), "left_semi")  # some 2 * shards ** 2 cells
            new += opened(inside, min(depth + step, BITS))
        left = set(unsure.tolist())
        held = sorted([x for k, x in enumerate(held) if k not in left] + new)


def alone(groups: DataFrame, shards: int) -> list[int]:
    """The places of the groups above the fair share of what is left, largest first."""
    total = groups.agg(F.sum("size")).first()[0] or 0
    out = []
    for r in groups.orderBy(F.desc("size"), "place").limit(shards - 1).collect():
        if r["size"] * (shards - len(out)) <= total:
            break
        out.append(r["place"])
        total -= r["size"]
    return out


def shard(docs: DataFrame, shards: int = 40, cells: int = CELLS, split: int = SPLIT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, size, text_crc32, shard, slot (gapless per shard)."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = pinned(
        docs.select(
            F.col(id_col).cast("long").alias("doc_id"),
            (F.octet_length(text) + OVERHEAD).cast("long").alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            F.conv(F.substring(F.md5(text.cast("binary")), 1, BITS // 4), 16, 10).cast("long").alias("place"),
        )
    )
    groups = pinned(rows.groupBy("place").agg(F.sum("size").alias("size")))
    single = alone(groups, shards)
    begins = cuts(groups.where(~F.col("place").isin(single)) if single else groups, shards - len(single), cells, split)
    to = F.lit(len(single)) + F.size(F.filter(F.array(*map(F.lit, begins)), lambda b: b <= F.col("place"))) if begins else F.lit(len(single))
    for number, place in enumerate(single):
        to = F.when(F.col("place") == place, number).otherwise(to)
    dealt = rows.withColumns({"shard": to.cast("int"), "one": F.lit(1).cast("long")})
    # Slots: a running count per shard, in the order of a hash of the id, so a huge group is split too.
    dealt = dealt.withColumn("key", hash_key("slot", "doc_id", "text_crc32"))
    dealt = dealt.withColumn("part", cell_of("key", cell_count(rows)))
    counted = within_cell(dealt, "shard", "part", ["key", "doc_id", "text_crc32", "size"], "one")
    before = cell_totals(dealt, "shard", "part", "one").select("shard", "part", "cell_before")
    return counted.join(before, ["shard", "part"]).select("doc_id", "size", "text_crc32", "shard", (F.col("cell_before") + F.col("in_cell")).alias("slot"))
