"""Preference losses, implicit process rewards and reward shaping, per row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from granary.functions.scans import reverse_scan
from granary.functions.tokens import masked_sum, total
from granary.operators.advantages import whiten_arrays
from granary.session import pinned


def log_sigmoid(x: Column) -> Column:
    """Stable on both sides."""
    return F.least(x, F.lit(0.0)) - F.log1p(F.exp(-F.abs(x)))


def dpo_loss(chosen: Column, rejected: Column, beta: float, kind: str = "sigmoid", smoothing: float = 0.0) -> Column:
    """Of the log-ratios against the reference of a pair's two sides."""
    gap = chosen - rejected
    if kind == "sigmoid":
        return -log_sigmoid(beta * gap) * (1 - smoothing) - log_sigmoid(-beta * gap) * smoothing
    if kind == "ipo":
        return (gap - 1 / (2 * beta)) * (gap - 1 / (2 * beta))
    raise ValueError(kind)


def sequence_logp(logps: Column, labels: Column, average: bool = False, ignore: int = -100) -> Column:
    """Sum (or mean) of token log-probabilities whose label isn't ignored."""
    mask = F.transform(labels, lambda x: F.when(x == ignore, 0.0).otherwise(1.0))
    sums = masked_sum(logps, mask)
    return sums / F.greatest(total(mask), F.lit(1.0)) if average else sums


def ce_dpo(margins: Column, correct: Column, beta: float) -> Column:
    """Cross-entropy of sigmoid(beta * summed log-ratio) against correctness."""
    return -F.when(correct > 0, log_sigmoid(beta * margins)).otherwise(log_sigmoid(-beta * margins))


def sppo_loss(log_ratio: Column, reward: Column, eta: float) -> Column:
    return (log_ratio - eta * reward) * (log_ratio - eta * reward)


def blend(tokens: Column, overall: Column, weight: float) -> Column:
    return F.transform(tokens, lambda x: (1 - weight) * x + weight * overall)


def implicit_reward(logp: Column, ref: Column, valid: Column, beta: float) -> Column:
    """beta times the log-ratio on the first ``valid`` places, zero behind them."""
    ratio = F.zip_with(logp, ref, lambda a, b: beta * (a - b))
    return F.transform(ratio, lambda x, i: F.when(i < valid, x).otherwise(0.0))


def detached_dpo(score: Column, correct: Column, others: Column, others_correct: Column, beta: float, mode: str = "none") -> Column:
    """A row's loss against the mean score of the samples that did worse (of a wrong row: better), or 0 without any.

    ``bon_rm`` and ``bon_acc`` weigh it by n * share ** (n - 1), the share of samples with no larger
    score or correctness; such rows are summed, unweighted ones averaged.
    """
    rows = F.zip_with(others, others_correct, lambda q, a: F.struct(q.alias("q"), a.alias("a")))
    against = F.filter(rows, lambda x: F.when(correct > 0, x["a"] < correct).otherwise(x["a"] > correct))
    base = F.when(F.size(against) > 0, total(F.transform(against, lambda x: x["q"])) / F.size(against) * beta).otherwise(0.0)
    loss = -log_sigmoid((score * beta - base) * F.when(correct > 0, 1.0).otherwise(-1.0))
    if mode == "none":
        return loss
    n = F.size(rows)
    if mode == "bon_rm":
        below = F.filter(rows, lambda x: x["q"] * beta <= score * beta)
    elif mode == "bon_acc":
        below = F.filter(rows, lambda x: x["a"] <= correct)
    else:
        raise NotImplementedError(mode)
    return loss * n * F.pow(F.size(below) / n, (n - 1).cast("double"))


def prime_advantages(rows: DataFrame, uid: str, sources: list[tuple[str, str, float]], mask: str) -> DataFrame:
    """Add ``returns`` and ``advantage``: token rewards of several sources (values, mask, weight), each against its
    group's other rows, weighed and added, summed from behind on the mask, and whitened.
    """
    parts = []
    for k, (values, own, weight) in enumerate(sources):
        rows = prime_rloo(rows, uid, values, own, f"_part{k}")
        parts.append(_scaled(f"_part{k}", weight))
    whole = parts[0]
    for part in parts[1:]:
        whole = F.zip_with(whole, part, lambda a, b: a + b)
    found = pinned(rows.withColumn("returns", reverse_scan(F.zip_with(whole, F.col(mask), lambda x, m: x * m))).drop(*[f"_part{k}" for k in range(len(sources))]))
    return whiten_arrays(found.withColumn("advantage", F.col("returns")), "advantage", mask)


def _scaled(values: str, weight: float) -> Column:
    return F.transform(values, lambda x: x * weight)


def batch_norm(rows: DataFrame, values: str) -> DataFrame:
    """Divide by the batch's largest absolute reverse running sum."""
    sums = F.array_max(F.transform(reverse_scan(F.col(values)), F.abs))
    top = rows.agg(F.max(sums).alias("_top"))
    met = rows.crossJoin(F.broadcast(top))  # one row
    return met.withColumn(values, F.transform(values, lambda x: x / (F.col("_top") + 1e-6))).drop("_top")


def prime_rloo(rows: DataFrame, uid: str, values: str, mask: str, out: str = "centred") -> DataFrame:
    """Token rewards against the other rows' masked means: x * n / (n - 1) - sum of means / (n - 1), on the mask."""
    group = Window.partitionBy(uid)
    marked = rows.withColumns({"_mean": masked_sum(F.col(values), F.col(mask)) / F.greatest(total(F.col(mask)), F.lit(1.0)), "_n": F.count("*").over(group)})
    base = F.sum("_mean").over(group) / (F.col("_n") - 1)
    marked = marked.withColumn("_base", F.when(F.col("_n") > 1, base).otherwise(0.0))
    scale = F.when(F.col("_n") > 1, F.col("_n") / (F.col("_n") - 1)).otherwise(1.0)
    return marked.withColumn(out, F.zip_with(values, mask, lambda x, m: (x * scale - F.col("_base")) * m)).drop("_mean", "_n", "_base")


def resampling_weights(score: Column, kind: str, power: float = 2.0, low: Column | None = None, high: Column | None = None) -> Column:
    """Weights for drawing rows anew: a power of the score's size, 1 at the extremes ``low`` and ``high``, or 0.4 at ``high`` and 0.1 below."""
    if kind == "pow":
        weight = F.pow(F.abs(score), F.lit(power))
    elif kind == "max_min":
        weight = F.when((score == high) | (score == low), 1.0).otherwise(0.0)
    elif kind == "max_random":
        weight = F.when(score == high, 0.4).otherwise(0.1)
    else:
        raise ValueError(kind)
    return F.greatest(weight + 1e-8, F.lit(1e-8))
