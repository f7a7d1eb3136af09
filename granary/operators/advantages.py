"""Group-relative advantage estimators over scalar scores, and reverse scans over token arrays.

Group statistics are windows over the group key, so a group's rows meet in one
shuffle and nothing is joined back; token scans are array folds within a row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from granary.functions.scans import reverse_scan
from granary.functions.tokens import masked_sum, total
from granary.operators.batch import with_row_id
from granary.session import pinned

EPS = 1e-6


def _stats(uid: str, score: str) -> tuple[Column, Column, Column]:
    group = Window.partitionBy(uid)
    return F.count(score).over(group), F.avg(score).over(group), F.stddev_samp(score).over(group)


def grpo(rows: DataFrame, uid: str = "uid", score: str = "score", by_std: bool = True) -> DataFrame:
    """(s - mean) / (std + eps), or s - mean; a group of one keeps mean 0 and std 1."""
    n, mean, std = _stats(uid, score)
    mean, std = F.when(n == 1, 0.0).otherwise(mean), F.when(n == 1, 1.0).otherwise(std)
    value = (F.col(score) - mean) / (std + EPS) if by_std else F.col(score) - mean
    return rows.withColumn("advantage", value)


def passk(rows: DataFrame, order: str, uid: str = "uid", score: str = "score") -> DataFrame:
    """Only a group's best row counts: (best - second) / (std + eps); groups need two rows."""
    n, _, std = _stats(uid, score)
    ranked = Window.partitionBy(uid).orderBy(F.desc(score), order)
    best = (F.col(score) - F.lead(score).over(ranked)) / (std + EPS)
    return rows.withColumn("advantage", F.when(n < 2, F.raise_error(F.lit("a group needs two samples")).cast("double")).when(F.row_number().over(ranked) == 1, best).otherwise(0.0))


def rloo(rows: DataFrame, uid: str = "uid", score: str = "score") -> DataFrame:
    n, mean, _ = _stats(uid, score)
    scale = n / F.greatest(n - 1, F.lit(1))
    return rows.withColumn("advantage", F.when(n > 1, F.col(score) * scale - mean * scale).otherwise(F.col(score)))


def opo(rows: DataFrame, uid: str = "uid", score: str = "score", length: str = "length") -> DataFrame:
    """The baseline is the length-weighted mean of the group."""
    group = Window.partitionBy(uid)
    base = F.sum(F.col(length) * F.col(score)).over(group) / F.sum(length).over(group)
    return rows.withColumn("advantage", F.col(score) - F.when(F.count(score).over(group) == 1, 0.0).otherwise(base))


def centred(rows: DataFrame, uid: str = "uid", score: str = "score") -> DataFrame:
    """s - mean of the group; a group of one keeps its score."""
    n, mean, _ = _stats(uid, score)
    return rows.withColumn("centred", F.col(score) - F.when(n == 1, 0.0).otherwise(mean))


def whiten(rows: DataFrame, value: str, weight: str, shift: bool = True) -> DataFrame:
    """(v - mean) / sqrt(var + 1e-8) over all valid tokens, a row standing for ``weight`` equal tokens.

    The mean first, then the squares about it, each a sum in one row that is joined back to
    every row. Weights that sum to 0 or 1 have no variance and raise an error.
    """
    w, v = F.col(weight), F.col(value)
    sums = rows.agg(F.coalesce(F.sum(w), F.lit(0)).cast("double").alias("_n"), F.sum(w * v).alias("_s"))
    means = sums.select("_n", (F.col("_s") / (F.col("_n") + 1e-8)).alias("_mean"))
    about = rows.crossJoin(F.broadcast(means)).agg(F.sum(w * (v - F.col("_mean")) * (v - F.col("_mean"))).alias("_q"))
    spread = F.col("_q") / (F.col("_n") + 1e-8) * F.col("_n") / (F.col("_n") - 1)
    known = F.when(F.col("_n").isin(0.0, 1.0), F.raise_error(F.lit("whitening needs more than one valid token")).cast("double")).otherwise(spread)
    stats = means.crossJoin(F.broadcast(about)).select("_mean", known.alias("_var"))
    met = rows.crossJoin(F.broadcast(stats))  # one row
    scaled = (v - F.col("_mean")) / F.sqrt(F.col("_var") + 1e-8)
    return met.withColumn("advantage", scaled if shift else scaled + F.col("_mean")).drop("_mean", "_var")


def whiten_arrays(rows: DataFrame, values: str, mask: str) -> DataFrame:
    """:func:`whiten` over the tokens of array columns, in place."""
    sums = rows.agg(F.coalesce(F.sum(total(F.col(mask))), F.lit(0.0)).alias("_n"), F.sum(masked_sum(F.col(values), F.col(mask))).alias("_s"))
    means = sums.select("_n", (F.col("_s") / (F.col("_n") + 1e-8)).alias("_mean"))
    squares = F.transform(values, lambda x: (x - F.col("_mean")) * (x - F.col("_mean")))
    about = rows.crossJoin(F.broadcast(means)).agg(F.sum(masked_sum(squares, F.col(mask))).alias("_q"))
    spread = F.col("_q") / (F.col("_n") + 1e-8) * F.col("_n") / (F.col("_n") - 1)
    known = F.when(F.col("_n").isin(0.0, 1.0), F.raise_error(F.lit("whitening needs more than one valid token")).cast("double")).otherwise(spread)
    met = rows.crossJoin(F.broadcast(means.crossJoin(F.broadcast(about)).select("_mean", known.alias("_var"))))  # one row
    return met.withColumn(values, F.transform(values, lambda x: (x - F.col("_mean")) / F.sqrt(F.col("_var") + 1e-8))).drop("_mean", "_var")


def gae(rewards: Column, values: Column, gamma: float, lam: float) -> Column:
    """Generalised advantages of one row's tokens, not whitened."""
    n = F.size(values)
    after = F.concat(F.slice(values, F.lit(2), F.greatest(n - 1, F.lit(0))), F.array(F.lit(0.0)))
    deltas = F.zip_with(F.zip_with(rewards, after, lambda r, v: r + gamma * v), values, lambda r, v: r - v)
    return reverse_scan(deltas, gamma * lam)


def gae_advantages(rows: DataFrame, rewards: str, values: str, mask: str, gamma: float, lam: float) -> DataFrame:
    """Add ``advantage``, whitened over the mask, and ``returns``, advantages before whitening plus values."""
    found = pinned(rows.withColumn("advantage", gae(F.col(rewards), F.col(values), gamma, lam)))
    found = found.withColumn("returns", F.zip_with("advantage", values, lambda a, v: a + v))
    return whiten_arrays(found, "advantage", mask)


def discounted(rewards: Column, mask: Column, gamma: float) -> Column:
    """Reverse discounted returns; what is carried on is masked at each place."""
    return reverse_scan(rewards, gamma, mask)


def discounted_advantages(rows: DataFrame, rewards: str, mask: str, gamma: float) -> DataFrame:
    """Add ``returns``, discounted, and ``advantage``, the same whitened over the mask and zero outside."""
    found = pinned(rows.withColumn("returns", discounted(F.col(rewards), F.col(mask), gamma)))
    found = whiten_arrays(found.withColumn("advantage", F.col("returns")), "advantage", mask)
    return found.withColumn("advantage", F.zip_with("advantage", mask, lambda a, m: a * m + 0.0))  # no negative zero


def remax(rewards: Column, mask: Column, baseline: Column) -> Column:
    """Reverse sums of the masked rewards, less the masked baseline."""
    returns = reverse_scan(F.zip_with(rewards, mask, lambda r, m: r * m))
    return F.zip_with(returns, mask, lambda r, m: r - baseline * m)


def softmean(rows: DataFrame, reward: str, beta: float) -> DataFrame:
    """reward - (logsumexp(beta * reward) - ln n) / beta over the whole frame; beta 0 takes the mean."""
    if beta == 0:
        stats = rows.agg(F.avg(reward).alias("_base"))
    else:
        top = rows.agg(F.max(reward).alias("_top"))
        stats = rows.crossJoin(F.broadcast(top)).agg(((F.max("_top") * beta + F.log(F.sum(F.exp(beta * (F.col(reward) - F.col("_top")))))) - F.log(F.count("*"))).alias("_l")).select((F.col("_l") / beta).alias("_base"))
    return rows.crossJoin(F.broadcast(stats)).withColumn("advantage", F.col(reward) - F.col("_base")).drop("_base")


def filter_variance(rows: DataFrame, uid: str = "uid", score: str = "score") -> DataFrame:
    """Groups whose scores differ, and groups of one."""
    group = Window.partitionBy(uid)
    marked = rows.withColumns({"_sd": F.stddev_pop(score).over(group), "_n": F.count(score).over(group)})
    return marked.where((F.col("_sd") > 0) | (F.col("_n") == 1)).drop("_sd", "_n")


def filter_thresholds(rows: DataFrame, persist: float, upper: float, lower: float, blocked: DataFrame | None = None, uid: str = "uid", score: str = "score", eps: float = 1e-8) -> DataFrame:
    """Add ``group_mean`` and ``drop_reason`` (persist, upper, lower, or null: kept).

    ``blocked`` holds the keys of groups blocked before (a column named like ``uid``).
    """
    mean = F.avg(score).over(Window.partitionBy(uid))
    marked = rows.withColumn("group_mean", mean)
    if blocked is None:
        known = F.lit(False)
    else:
        marked = marked.join(blocked.select(uid).distinct().withColumn("_blocked", F.lit(True)), uid, "left")
        known = F.col("_blocked").isNotNull()
    reason = F.when(known | (F.col("group_mean") >= persist - eps), "persist").when(F.col("group_mean") >= upper - eps, "upper").when(F.col("group_mean") <= lower + eps, "lower")
    return marked.withColumn("drop_reason", reason).drop("_blocked")


def filter_band(rows: DataFrame, low: float, high: float, longest: int, keep: int, order: str, uid: str = "uid", score: str = "score", length: str = "length") -> DataFrame:
    """Groups inside the band and below the length limit come first; the first ``keep`` rows stay.

    The rows are numbered over a range sort, so no task holds more than its range.
    """
    group = Window.partitionBy(uid)
    demoted = ~F.avg(score).over(group).between(low, high) | (F.max(length).over(group) >= longest - 1)
    numbered = with_row_id(rows.withColumn("_demoted", demoted.cast("int")), "_demoted", uid, order)
    return numbered.where(F.col("row_id") < keep).select(*rows.columns)
