"""Batch algebra over frames with a dense, zero-based ``row_id``.

A batch is a frame whose order is its ``row_id``. All operators are lazy and
positional semantics become joins or arithmetic on ``row_id``; none brings rows
to the driver or sorts them globally, but for :func:`with_row_id`, whose range
shuffle numbers rows by per-partition offsets.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from granary.session import pinned


def with_row_id(df: DataFrame, *order: str) -> DataFrame:
    """Number rows from 0 in the given order; one offset per partition is all that is collected in one place."""
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    parts = pinned(ranged.withColumns({"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id()}))
    run = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    counts = parts.groupBy("_part").agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    offsets = counts.select("_part", "_first", F.coalesce(F.sum("_n").over(run), F.lit(0)).alias("_before"))
    numbered = parts.join(F.broadcast(offsets), "_part")  # a row per partition
    return numbered.withColumn("row_id", F.col("_before") + F.col("_at") - F.col("_first")).drop("_part", "_at", "_first", "_before", "_n")


def select(batch: DataFrame, *columns: str) -> DataFrame:
    return batch.select("row_id", *columns)


def pop(batch: DataFrame, *columns: str) -> tuple[DataFrame, DataFrame]:
    """What is taken out, and what is left."""
    missing = set(columns) - set(batch.columns)
    if missing:
        raise KeyError(sorted(missing))
    return batch.select("row_id", *columns), batch.drop(*columns)


def rename(batch: DataFrame, old: list[str], new: list[str]) -> DataFrame:
    if len(old) != len(new):
        raise ValueError("as many new names as old ones are needed")
    return batch.withColumnsRenamed(dict(zip(old, new, strict=True)))


def take_slice(batch: DataFrame, start: int | None = None, stop: int | None = None, step: int | None = None) -> DataFrame:
    """Rows ``start:stop:step`` as a Python slice takes them, numbered anew."""
    n = batch.count() if any(x is not None and x < 0 for x in (start, stop, step)) or stop is None else None
    if n is None:
        first, last, by = start or 0, stop, step or 1
    else:
        first, last, by = slice(start, stop, step).indices(n)
    if by > 0:
        kept = batch.where((F.col("row_id") >= first) & (F.col("row_id") < last) & ((F.col("row_id") - first) % by == 0))
    else:
        kept = batch.where((F.col("row_id") <= first) & (F.col("row_id") > last) & ((first - F.col("row_id")) % -by == 0))
    return kept.withColumn("row_id", ((F.col("row_id") - first) / by).cast("long"))


def gather(batch: DataFrame, index: DataFrame) -> DataFrame:
    """Rows by an index table (pos, idx); repeats and order are kept."""
    return index.join(batch, index["idx"] == batch["row_id"]).drop("row_id", "idx").withColumnRenamed("pos", "row_id")


def reorder(batch: DataFrame, index: DataFrame) -> DataFrame:
    return gather(batch, index)


def inverse(index: DataFrame) -> DataFrame:
    return index.select(F.col("idx").cast("long").alias("pos"), F.col("pos").alias("idx"))


def union(left: DataFrame, right: DataFrame) -> DataFrame:
    """Join two batches row by row; shared columns must be equal and so must the sizes."""
    shared = [c for c in left.columns if c in right.columns and c != "row_id"]
    other = right.withColumnsRenamed({c: f"_other_{c}" for c in shared}).withColumn("_right", F.lit(True))
    met = left.withColumn("_left", F.lit(True)).join(other, "row_id", "full")
    wrong = F.col("_left").isNull() | F.col("_right").isNull()
    for c in shared:
        wrong = wrong | ~F.col(c).eqNullSafe(F.col(f"_other_{c}"))
    checked = met.withColumn("row_id", F.when(wrong, F.raise_error(F.lit("batches differ in size or in a shared column"))).otherwise(F.col("row_id")))
    return checked.drop("_left", "_right", *[f"_other_{c}" for c in shared])


def concat(parts: list[DataFrame]) -> DataFrame:
    """One batch after another, with the first one's columns."""
    for part in parts[1:]:
        if set(part.columns) != set(parts[0].columns):
            raise KeyError(sorted(set(part.columns) ^ set(parts[0].columns)))
    out, offset = parts[0], 0
    for before, part in zip(parts, parts[1:], strict=False):
        offset += before.count()
        out = out.unionByName(part.select(*parts[0].columns).withColumn("row_id", F.col("row_id") + offset))
    return out


def chunk(batch: DataFrame, chunks: int, even: bool = False) -> DataFrame:
    """Add ``chunk_id``: runs of ceil(n / chunks) rows; with ``even`` the chunks must be equally large."""
    n = batch.count()
    if even and n % chunks:
        raise ValueError("the number of chunks must divide the batch")
    return batch.withColumn("chunk_id", F.floor(F.col("row_id") / max(1, -(-n // chunks))).cast("int"))


def repeat(batch: DataFrame, times: int, interleave: bool = True) -> DataFrame:
    """Every row ``times`` times, side by side or batch after batch."""
    n = None if interleave else batch.count()
    copies = batch.withColumn("sample_id", F.explode(F.sequence(F.lit(0), F.lit(times - 1))))
    row = F.col("row_id") * times + F.col("sample_id") if interleave else F.col("sample_id") * F.lit(n) + F.col("row_id")
    return copies.withColumn("row_id", row.cast("long"))


def sample_repeat(batch: DataFrame, times: str) -> DataFrame:
    """Row r as often as its column ``times`` says; ``sample_id`` tells the copies apart."""
    return batch.where(F.col(times) > 0).withColumn("sample_id", F.explode(F.sequence(F.lit(0), F.col(times).cast("int") - 1)))


def unfold(batch: DataFrame, chunks: int, columns: list[str]) -> DataFrame:
    """Split arrays into ``chunks`` rows; other columns repeat."""
    out = batch.withColumn("split_id", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))))
    for c in columns:
        width = F.floor(F.size(c) / chunks).cast("int")
        out = out.withColumn(c, F.slice(c, F.col("split_id") * width + 1, width))
    return out.withColumn("row_id", F.col("row_id") * chunks + F.col("split_id"))


def fold(batch: DataFrame, size: int, column: str) -> DataFrame:
    """Runs of ``size`` rows become one row with an array in row order."""
    rows = batch.groupBy(F.floor(F.col("row_id") / size).cast("long").alias("fold_id")).agg(F.array_sort(F.collect_list(F.struct("row_id", column))).alias("_rows"))
    return rows.select("fold_id", F.transform("_rows", lambda r: r[column]).alias(column))


def pad_to_divisor(batch: DataFrame, divisor: int) -> DataFrame:
    """Rows from the head, again and again, until the size is a multiple; ``is_pad`` marks them."""
    n = batch.count()
    pad = -n % divisor
    marked = batch.withColumn("is_pad", F.lit(False))
    if not n or not pad:
        return marked
    rounds = batch.withColumn("_k", F.explode(F.sequence(F.lit(0), F.lit((pad - 1) // n)))).withColumn("_p", F.col("_k") * n + F.col("row_id")).where(F.col("_p") < pad)
    return marked.unionByName(rounds.withColumn("row_id", F.lit(n) + F.col("_p")).withColumn("is_pad", F.lit(True)).drop("_k", "_p"))


def unpad(batch: DataFrame) -> DataFrame:
    return batch.where(~F.col("is_pad")).drop("is_pad")


def pad_with(batch: DataFrame, size: int, first: bool = False) -> DataFrame:
    """``size`` more copies of the last (or first) row."""
    n = batch.count()
    if not size or not n:
        return batch
    copies = batch.where(F.col("row_id") == (0 if first else n - 1)).withColumn("_k", F.explode(F.sequence(F.lit(0), F.lit(size - 1))))
    return batch.unionByName(copies.withColumn("row_id", F.lit(n) + F.col("_k")).drop("_k"))


def minibatches(batch: DataFrame, size: int, epochs: int = 1, seed: int | None = None) -> DataFrame:
    """Add ``epoch`` and ``batch_id``; the size must divide the batch. A seed deals the rows anew in every epoch."""
    if batch.count() % size:
        raise ValueError("the mini-batch size must divide the batch")
    if seed is not None:
        drawn = batch.withColumnRenamed("row_id", "_row").withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))))
        drawn = with_row_id(drawn.withColumn("_draw", F.md5(F.concat_ws(":", F.lit(seed), "epoch", "_row"))), "epoch", "_draw", "_row")
        placed = F.floor(F.col("row_id") / size) % F.lit(max(1, batch.count() // size))
        return drawn.withColumn("batch_id", placed.cast("int")).drop("row_id", "_draw").withColumnRenamed("_row", "row_id")
    return batch.withColumns({"epoch": F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))), "batch_id": F.floor(F.col("row_id") / size).cast("int")})


def pairs_unpivot(pairs: DataFrame, key: str, chosen: str, rejected: str) -> DataFrame:
    """Two rows a pair: the chosen text with label true, then the rejected one."""
    both = F.array(F.struct(F.col(chosen).alias("text"), F.lit(True).alias("chosen")), F.struct(F.col(rejected).alias("text"), F.lit(False).alias("chosen")))
    return pairs.select(key, F.posexplode(both).alias("side", "e")).select(key, "side", "e.text", "e.chosen")
