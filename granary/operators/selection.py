"""Selections and folds over rows: seeded samples, heads, strides, padded packs, top lists, controllers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from granary.operators.batch import with_row_id


def _draw(seed: int, *parts: Column) -> Column:
    """A text in random order, alike in every engine and run."""
    return F.md5(F.concat(F.lit(str(seed)), *[F.concat(F.lit(":"), p.cast("string")) for p in parts]))


def seeded_sample(rows: DataFrame, size: int, key: str, seed: int, group: str) -> DataFrame:
    """``size`` rows of each group in seeded random order; ``rank`` counts from 1.

    Spark keeps the best rows of each partition before the shuffle.
    """
    order = Window.partitionBy(group).orderBy(_draw(seed, F.col(key)), key)
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= size)


def shuffled(values: Column, key: Column, seed: int) -> Column:
    """An array's elements in an order drawn by key and seed."""
    drawn = F.transform(values, lambda x, i: F.struct(_draw(seed, key, i + 1).alias("draw"), i.alias("at"), x.alias("value")))
    return F.transform(F.array_sort(drawn), lambda x: x["value"])


def head_groups(rows: DataFrame, groups: int, each: int, uid: str, order: str) -> DataFrame:
    """The first ``groups`` groups by uid, and their first ``each`` rows."""
    chosen = rows.select(uid).distinct().orderBy(uid).limit(groups)
    first = F.row_number().over(Window.partitionBy(uid).orderBy(order))
    return rows.join(F.broadcast(chosen), uid, "left_semi").withColumn("_k", first).where(F.col("_k") <= each).drop("_k")  # ``groups`` rows


def strided(batch: DataFrame, ranks: int) -> DataFrame:
    """Add ``rank``: every rank takes each ``ranks``-th row; the rest that doesn't fill a round is dropped."""
    n = batch.count()
    return batch.where(F.col("row_id") < n - n % ranks).withColumn("rank", (F.col("row_id") % ranks).cast("int"))


def pad_packed(rows: DataFrame, group: str, order: str, length: str, multiple: int) -> DataFrame:
    """Add ``ends`` (running lengths) and, where a pack isn't a multiple long, a last sequence of padding (``pad``)."""
    sums = rows.groupBy(group).agg((F.max(order) + 1).alias(order), F.sum(length).alias(length))
    more = sums.where(F.col(length) % multiple > 0).withColumn(length, F.lit(multiple) - F.col(length) % multiple)
    both = rows.select(group, order, length).withColumn("pad", F.lit(False)).unionByName(more.select(group, order, length).withColumn("pad", F.lit(True)))
    run = Window.partitionBy(group).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return both.withColumn("ends", F.sum(length).over(run))


def top_lists(rows: DataFrame, k: int, query: str, document: str, score: str) -> DataFrame:
    """(query, result): its k best documents as a list of (document, score); ties go to the smaller document."""
    rank = F.row_number().over(Window.partitionBy(query).orderBy(F.desc(score), document))
    best = rows.withColumn("_r", rank).where(F.col("_r") <= k)
    held = F.array_sort(F.collect_list(F.struct("_r", F.col(document).alias("document"), F.col(score).alias("score"))))
    return best.groupBy(query).agg(F.transform(held, lambda x: F.struct(x["document"].alias("document"), x["score"].alias("score"))).alias("result"))


def adaptive_kl(steps: DataFrame, step: str, kl: str, n: str, start: float, target: float, horizon: float) -> DataFrame:
    """(step, beta): the coefficient after each step, from errors clipped at a fifth and scaled by n / horizon.

    One row a step, so the running product is one window over them.
    """
    error = F.greatest(F.lit(-0.2), F.least(F.lit(0.2), F.col(kl) / target - 1))
    run = Window.orderBy(step).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    grown = F.sum(F.log(1 + error * F.col(n) / horizon)).over(run)
    return steps.select(step, (start * F.exp(grown)).alias("beta"))


def date_range(rows: DataFrame, at: str, first: str, end: str) -> DataFrame:
    """Rows of the days from ``first`` up to and without ``end``; timestamps are compared, so that scans can skip files."""
    return rows.where((F.col(at) >= F.lit(first).cast("timestamp")) & (F.col(at) < F.lit(end).cast("timestamp")))


def keep_groups(rows: DataFrame, kept: DataFrame, uid: str) -> DataFrame:
    """The rows of the groups in ``kept`` (a column named like ``uid``)."""
    return rows.join(kept.select(uid), uid, "left_semi")


def drop_blocked(rows: DataFrame, blocked: DataFrame, key: str) -> DataFrame:
    """The rows whose key isn't in ``blocked``."""
    return rows.join(blocked.select(key), key, "left_anti")


def drop_empty(rows: DataFrame, label: str) -> DataFrame:
    """The rows with a label: no null, no empty text."""
    return rows.where(F.col(label).isNotNull() & (F.col(label).cast("string") != ""))


def drop_uneven(rows: DataFrame, *arrays: str) -> DataFrame:
    """The rows whose arrays are equally long; a missing array goes with none."""
    sizes = [F.coalesce(F.size(a), F.lit(-1)) for a in arrays]
    return rows.where(F.least(*sizes) == F.greatest(*sizes)).where(sizes[0] >= 0)


def lookup(hits: DataFrame, documents: DataFrame, key: str) -> DataFrame:
    """What was found with the documents' own columns; ids that no document has drop out."""
    return hits.join(documents, key)


def submit_order(rows: DataFrame, batch: str, offset: str) -> DataFrame:
    """Rows numbered (``row_id``) in the order in which they were asked for."""
    return with_row_id(rows, batch, offset)


def latest(rows: DataFrame, group: str, step: str, *carry: str) -> DataFrame:
    """Each group's largest step, with the columns of that row."""
    return rows.groupBy(group).agg(F.max(step).alias(step), *[F.max_by(c, step).alias(c) for c in carry])


def remaining_steps(steps: DataFrame, step: str, blocked: str, total: int, batch: int) -> DataFrame:
    """Add ``remaining``: the total less a step for each started batch of newly blocked prompts, no less than the step. A row per step."""
    run = Window.orderBy(step).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return steps.withColumn("remaining", F.greatest(F.lit(total) - F.sum(F.ceil(F.col(blocked) / batch)).over(run), step).cast("long"))


def transposed(rows: DataFrame, group: str, order: str, *columns: str) -> DataFrame:
    """A row per group with an array of each column, in the order of the rows: a list of records as a record of lists."""
    held = F.array_sort(F.collect_list(F.struct(order, *columns)))
    return rows.groupBy(group).agg(held.alias("_held")).select(group, *[F.col(f"_held.{c}").alias(c) for c in columns])


def pairs(rows: DataFrame, pair: str, score: str, order: str) -> DataFrame:
    """Chosen and rejected row of each pair; the first is chosen on a tie, a lone row has no rejected one."""
    rank = F.struct(score, -F.col(order))
    return rows.groupBy(pair).agg(F.max_by(order, rank).alias("chosen"), F.when(F.count("*") > 1, F.min_by(order, rank)).alias("rejected"))
