"""Balanced partitions of sequence lengths, and token-budget micro-batches."""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame


def differencing(lengths: list[int], parts: int, equal: bool = False) -> list[list[int]]:
    """Partitions of near-equal sums by the largest differencing method.

    With ``equal`` all partitions have as many members: whole rounds of ``parts`` items
    are merged largest sum to smallest. Ties go to the earlier item.
    """
    if equal and len(lengths) % parts:
        raise ValueError("equal sizes need a multiple of the number of partitions")
    order = sorted(range(len(lengths)), key=lambda i: (lengths[i], i))
    heap: list = []
    step = parts if equal else 1
    for k in range(0, len(order), step):
        bins = [[(lengths[i]), [i]] for i in order[k : k + step]] + [[0, []] for _ in range(parts - min(step, len(order) - k))]
        bins.sort(key=lambda b: (-b[0], b[1]))
        heapq.heappush(heap, (-(bins[0][0] - bins[-1][0]), k, bins))
    while len(heap) > 1:
        _, key, a = heapq.heappop(heap)
        _, other, b = heapq.heappop(heap)
        merged = [[x[0] + y[0], x[1] + y[1]] for x, y in zip(a, reversed(b), strict=True)]
        merged.sort(key=lambda z: (-z[0], z[1]))
        heapq.heappush(heap, (-(merged[0][0] - merged[-1][0]), min(key, other), merged))
    return [sorted(b[1]) for b in heap[0][2]] if heap else [[] for _ in range(parts)]


def balanced(lengths: list[int], parts: int, equal: bool = False) -> list[list[int]]:
    """:func:`differencing`, checked: as many items as partitions at least, none empty, each item in one; members in order."""
    if len(lengths) < parts:
        raise ValueError("fewer items than partitions")
    found = [sorted(p) for p in differencing(lengths, parts, equal)]
    if len(found) != parts or not all(found) or sorted(i for p in found for i in p) != list(range(len(lengths))):
        raise ValueError("a partition is empty, or items are lost")
    return found


def differencing_even(lengths: list[int], parts: int) -> list[list[int]]:
    """``parts`` partitions of near-equal sums whose sizes differ by at most one, for any number of items.

    Empty items fill the batch up to a multiple of ``parts`` and are left out again. They come
    before all others, so they share the first round and no partition gets two of them.
    """
    pad = -len(lengths) % parts
    return [[i - pad for i in p if i >= pad] for p in differencing([0] * pad + lengths, parts, equal=True)]


def least_loaded(lengths: list[int], parts: int) -> list[list[int]]:
    """In input order, each item to the partition with the least load so far."""
    heap, out = [(0, p) for p in range(parts)], [[] for _ in range(parts)]
    for i, length in enumerate(lengths):
        load, p = heapq.heappop(heap)
        out[p].append(i)
        heapq.heappush(heap, (load + length, p))
    return out


def micro_batches(lengths: list[int], budget: int, least: int = 1, divisor: int = 1) -> list[list[int]]:
    """Balanced batches: as many as the budget needs, at least ``least``, rounded up to a multiple."""
    if max(lengths, default=0) > budget:
        raise ValueError("a sequence exceeds the budget")
    count = max(min(len(lengths), math.ceil(sum(lengths) / budget)), least)
    count = min(-(-count // divisor) * divisor, len(lengths))
    return sorted(differencing(lengths, count), key=lambda p: p[:1])


def by_group(rows: DataFrame, group: str, item: str, length: str, method, schema: str = "part int, pos int") -> DataFrame:
    """Partition every group's items with ``method(lengths)``: (group, item, part, pos)."""
    kinds = dict(rows.dtypes)

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(item).reset_index(drop=True)
        found: Iterator = ((p, k, i) for p, members in enumerate(method(frame[length].astype(int).tolist())) for k, i in enumerate(members))
        placed = pd.DataFrame(found, columns=["part", "pos", "i"]).astype(int)
        return pd.DataFrame({group: frame[group].iloc[placed.i].values, item: frame[item].iloc[placed.i].values, "part": placed.part.astype("int32"), "pos": placed.pos.astype("int32")})

    return rows.select(group, item, length).groupBy(group).applyInPandas(run, f"{group} {kinds[group]}, {item} {kinds[item]}, {schema}")
