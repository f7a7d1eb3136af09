"""SimHash near-deduplication by the generalised pigeonhole principle.

A text's fingerprint has a bit set where over half of the XXH64 hashes (seed
42) of its word shingles have it. Fingerprints within ``radius`` bits link.

The 64 bits are grouped into partitions, correlated bits together, and each
partition p gets a threshold t_p, allocated by dynamic programming so that the
thresholds sum to ``radius - partitions + 1`` at the least estimated cost. Two
fingerprints within the radius then agree to within t_p bits in some partition
p, so an index of every partition's exact value, probed with the values
within t_p of it, meets every pair. A threshold of -1 leaves a partition out.
Whatever meets is verified on all 64 bits.

Defined results: a null or blank text has fingerprint 0 and links like any
other; fewer words than a shingle make one shingle of all of them; repeated
rows and exact copies share a fingerprint and so a component; a null id takes
no part in a minimum; an empty table gives an empty result; further columns are
ignored or, in :func:`keep_one`, kept.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.llm.links import Forest, blocked, by_group, components, near_pairs, rejoin
from granary.llm.rows import likeness, numbered, without
from granary.llm.workers import release
from granary.session import pinned

SHINGLE = 3
RADIUS = 3
BLOCK = 1024
ROW_COST = 1.0  # of one row dealt to a bucket, next to
PAIR_COST = 0.005  # one pair compared there


def fingerprint(text: str, shingle: int = SHINGLE) -> int:
    """The signed 64-bit fingerprint of a text."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined, ends, at = b" ".join(words), [-1], -1
    for word in words:
        at += len(word) + 1
        ends.append(at)
    digest = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        hashes = [digest(joined, 42)]
    else:
        hashes = [digest(joined[a + 1 : b], 42) for a, b in zip(ends, ends[shingle:])]
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = np.array(hashes[at : at + (1 << 16)], "<u8")
        counts += np.unpackbits(part.view(np.uint8).reshape(len(part), 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(counts * 2 > len(hashes), bitorder="little")
    return int(bits.view("<i8")[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, text_col: str = "text", **others: Column) -> DataFrame:
    """(fp, and the ``others`` by name) of every row."""
    chosen = docs.select(*[c.alias(n) for n, c in others.items()], F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    schema = chosen.drop("text").withColumn("fp", F.lit(0).cast("long")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            found = [fingerprint(t.as_py(), shingle) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(found, pa.int64())], names=[*batch.schema.names[:-1], "fp"])

    return chosen.mapInArrow(run, schema)


def bit_statistics(fps: DataFrame) -> tuple[int, np.ndarray]:
    """How many fingerprints there are, and in how many bits i and j are both set, over all rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both, n = np.zeros((64, 64), np.int64), 0
        for batch in batches:
            own = np.ascontiguousarray(batch.column(0).to_numpy(zero_copy_only=False).astype("<i8"))
            for at in range(0, len(own), 1 << 16):
                bits = np.unpackbits(own[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
                both += (bits.T @ bits).astype(np.int64)
            n += len(own)
        cells = np.append(both.ravel(), n)
        yield pa.RecordBatch.from_pydict({"cell": pa.array(np.arange(4097), pa.int32()), "n": pa.array(cells, pa.int64())})

    sums = fps.select("fp").mapInArrow(run, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect()  # 4097 rows
    cells = np.zeros(4097, np.int64)
    for r in sums:
        cells[r["cell"]] = r["n"]
    return int(cells[4096]), cells[:4096].reshape(64, 64)


def group_bits(n: int, both: np.ndarray, parts: int) -> list[list[int]]:
    """Near-equal partitions of the bits, grown greedily by absolute correlation."""
    p = np.diag(both) / max(n, 1)
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    alike = np.abs(both / max(n, 1) - np.outer(p, p)) / np.outer(spread, spread)
    left, groups = set(range(64)), []
    for k in range(parts):
        size = 64 // parts + (k < 64 % parts)
        rest = sorted(left)
        sums = alike[np.ix_(rest, rest)].sum(axis=1)
        group = [rest[int(np.argmax(sums))]]
        left.remove(group[0])
        while len(group) < size:
            rest = sorted(left)
            near = alike[np.ix_(rest, group)].sum(axis=1)
            group.append(rest[int(np.argmax(near))])
            left.remove(group[-1])
        groups.append(sorted(group))
    return groups


def allocate(n: int, both: np.ndarray, radius: int = RADIUS) -> list[tuple[list[int], int]]:
    """Partitions and their thresholds at the least estimated cost over the numbers of partitions.

    The candidate count of a partition at threshold t is estimated as the number of pairs
    times the chance that two fingerprints differ in at most t of its bits, by each bit's rate.
    """
    p = np.diag(both) / max(n, 1)
    differ = 2 * p * (1 - p)
    best: tuple[float, list] = (np.inf, [])
    for parts in range(2, radius + 3):
        groups = group_bits(n, both, parts)
        costs = []
        for group in groups:
            law = np.zeros(radius + 2)
            law[0] = 1.0
            for bit in group:
                law[1:] = law[1:] * (1 - differ[bit]) + law[:-1] * differ[bit]
                law[0] *= 1 - differ[bit]
            costs.append([0.0, *(ROW_COST * n * sum(comb(len(group), k) for k in range(t + 1)) + PAIR_COST * n * n / 2 * law[: t + 1].sum() for t in range(radius + 1))])
        # least[s]: the least cost of thresholds for the groups so far with sum s - (their number)
        least: dict[int, tuple[float, tuple]] = {0: (0.0, ())}
        for cost in costs:
            new: dict[int, tuple[float, tuple]] = {}
            for done, (spent, chosen) in least.items():
                for t in range(-1, radius + 1):
                    option = (spent + cost[t + 1], (*chosen, t))
                    if done + t + 1 not in new or option < new[done + t + 1]:
                        new[done + t + 1] = option
            least = new
        spent, chosen = least[radius + 1]  # sum of (t + 1) over the partitions: radius - parts + 1 + parts
        if spent < best[0]:
            best = (spent, [(g, t) for g, t in zip(groups, chosen, strict=True) if t >= 0])
    return best[1]


def probes(fps: DataFrame, plan: list[tuple[list[int], int]]) -> DataFrame:
    """(part, key, fp, probe): each partition's exact value (probe 0) and the values within its threshold."""
    masks = [sum(1 << b for b in group) for group, _ in plan]
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    flips = [[0, *(sum(1 << b for b in c) for k in range(1, t + 1) for c in combinations(group, k))] for group, t in plan]

    def entry(part: int, mask: int, flip: list[int]) -> Column:
        value = F.col("fp").bitwiseAND(F.lit(signed(mask)))
        probe = lambda x: F.struct(F.lit(part).alias("part"), value.bitwiseXOR(x).alias("key"), (x != 0).cast("int").alias("probe"))
        return F.transform(F.array(*[F.lit(signed(x)).cast("long") for x in flip]), probe)

    entries = [entry(k, mask, flip) for k, (mask, flip) in enumerate(zip(masks, flips, strict=True))]
    return fps.select("fp", F.explode(F.concat(*entries)).alias("e")).select("e.part", "e.key", "fp", "e.probe")


def links(fps: DataFrame, radius: int = RADIUS, block: int = BLOCK) -> DataFrame:
    """A spanning forest, bucket by bucket, of all links between distinct fingerprints: (child, parent)."""
    n, both = bit_statistics(fps)
    rows = blocked(probes(fps, allocate(n, both, radius)), ["part", "key"], "fp", block)
    schema = pa.schema([("child", pa.int64()), ("parent", pa.int64())])

    def handle(table: pa.Table, bounds: np.ndarray) -> Iterator[pa.RecordBatch]:
        fp, probe, side = (table.column(c).to_numpy() for c in ("fp", "probe", "side"))
        bits, forest = fp.view(np.uint64), Forest(len(fp))
        for i, j in near_pairs(bounds, side, 48):
            close = np.bitwise_count(bits[i] ^ bits[j]) <= radius
            close &= (probe[i] == 0) | (probe[j] == 0)
            forest.link(i[close], j[close])
        below = np.flatnonzero(forest.root != np.arange(len(fp)))
        a, b = fp[below], fp[forest.root[below]]
        apart = a != b
        yield pa.RecordBatch.from_arrays([pa.array(np.maximum(a, b)[apart], pa.int64()), pa.array(np.minimum(a, b)[apart], pa.int64())], schema=schema)

    return by_group(rows, ["part", "key"], ["fp"], handle, "child long, parent long", ["fp", "probe"])


def _least(rows: DataFrame, value: Column, radius: int) -> DataFrame:
    """The rows, with ``least``: the smallest ``value`` of their component."""
    distinct = pinned(rows.groupBy("fp").agg(F.min(value).alias("own"), F.count("*").alias("held")))
    roots = pinned(components(links(distinct.select("fp"), radius)))
    rooted = pinned(distinct.join(roots, distinct["fp"] == roots["node"], "left").select("fp", "own", "held", F.coalesce("root", "fp").alias("root")))
    least = pinned(rooted.groupBy("root").agg(F.min("own").alias("least")))
    return rejoin(rows, pinned(rooted.join(least, "root").select("fp", "held", "least")), "fp", "held")


def near_dedup(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, fp, component_id (the smallest doc_id reachable)."""
    rows = pinned(fingerprints(docs, shingle, text_col, doc_id=F.col(id_col).cast("long")))
    return _least(rows, F.col("doc_id"), radius).select("doc_id", "fp", F.col("least").alias("component_id"))


def keep_one(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The input's rows that stay, with its columns: of each component the row with the smallest id.

    Of rows that share that id, or in a component without ids, the one with the smallest hash of all columns.
    """
    whole, file, index = numbered(docs)
    others = {"doc_id": F.col(id_col).cast("long"), "like": likeness(docs), "file": F.col(file), "index": F.col(index)}
    rows = pinned(fingerprints(whole, shingle, text_col, **others))
    rank = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "like", "file", "index")
    return without(whole, _least(rows, rank, radius).where(rank != F.col("least")), file, index)
