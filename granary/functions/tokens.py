"""Column builders over token arrays: masks, padding, penalties and losses per token."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from granary.functions.scans import running_sum


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def prefix_mask(width: Column | int, length: Column) -> Column:
    """``length`` ones, then zeros."""
    width = F.lit(width) if isinstance(width, int) else width
    return F.when(width > 0, F.transform(F.sequence(F.lit(1), F.greatest(width, F.lit(1))), lambda i: F.when(i <= length, 1.0).otherwise(0.0))).otherwise(F.array().cast("array<double>"))


def masked_sum(values: Column, mask: Column) -> Column:
    return total(F.zip_with(values, mask, lambda v, m: v * m))


def masked_mean(values: Column, mask: Column) -> Column:
    return masked_sum(values, mask) / (total(mask) + 1e-8)


def aggregated_loss(loss: Column, mask: Column, mode: str) -> Column:
    """Over all rows: the loss by token, or by sequence of token sums, means, or sums over the width."""
    sums, n = masked_sum(loss, mask), total(mask)
    if mode == "token-mean":
        return F.sum(sums) / (F.sum(n) + 1e-8)
    if mode == "seq-mean-token-sum":
        return F.avg(sums)
    if mode == "seq-mean-token-mean":
        return F.avg(sums / n)
    if mode == "seq-mean-token-sum-norm":
        return F.sum(sums) / F.max(F.size(mask))
    raise ValueError(mode)


def kl(kind: str, logp: Column, ref: Column) -> Column:
    """Per-token divergence estimates: k1, abs, k2 or k3 (within 10 of 0)."""
    forms = {
        "k1": lambda a, b: a - b,
        "abs": lambda a, b: F.abs(a - b),
        "k2": lambda a, b: 0.5 * (a - b) * (a - b),
        "k3": lambda a, b: F.greatest(F.lit(-10.0), F.least(F.lit(10.0), F.exp(b - a) - (b - a) - 1)),
    }
    if kind not in forms:
        raise NotImplementedError(kind)
    return F.zip_with(logp, ref, forms[kind])


def shaped_reward(score: Column, kld: Column, mask: Column, beta: float) -> Column:
    return F.zip_with(score, F.zip_with(kld, mask, lambda k, m: k * m), lambda s, k: s - beta * k)


def clip(x: Column, low: Column, high: Column) -> Column:
    """x within its own bounds."""
    return F.greatest(F.least(x, high), low)


def _policy(old: Column, new: Column, advantage: Column, low: float, high: float, bound: float) -> Column:
    """Per token: its loss, whether the ratio's clip or the lower bound took effect, and the approximate divergence."""
    if bound <= 1:
        raise ValueError("the bound must exceed 1")
    gaps = F.zip_with(old, new, lambda a, b: a - b)
    pairs = F.zip_with(gaps, advantage, lambda g, a: F.struct(g.alias("kl"), F.exp(-g).alias("r"), a.alias("a")))

    def loss(x: Column) -> Column:
        plain, clipped, floor = -x["a"] * x["r"], -x["a"] * clip(x["r"], F.lit(1 - low), F.lit(1 + high)), -x["a"] * bound
        worst = F.greatest(plain, clipped)
        return F.struct(
            F.when(x["a"] < 0, F.least(worst, floor)).otherwise(worst).alias("loss"),
            F.when(clipped > plain, 1.0).otherwise(0.0).alias("clipped"),
            F.when((worst > floor) & (x["a"] < 0), 1.0).otherwise(0.0).alias("lower"),
            x["kl"].alias("kl"),
        )

    return F.transform(pairs, loss)


def policy_loss(old: Column, new: Column, advantage: Column, low: float, high: float, bound: float) -> Column:
    """Per-token clipped objective with the lower bound for negative advantages."""
    return F.transform(_policy(old, new, advantage, low, high, bound), lambda x: x["loss"])


def policy_sums(old: Column, new: Column, advantage: Column, mask: Column, low: float, high: float, bound: float) -> Column:
    """A row's masked sums for :func:`policy_metrics`: loss, clipped, lower, kl, n."""
    parts = _policy(old, new, advantage, low, high, bound)
    sums = [masked_sum(parts.getField(name), mask).alias(name) for name in ("loss", "clipped", "lower", "kl")]
    return F.struct(*sums, total(mask).alias("n"))


def policy_metrics(sums: Column) -> list[Column]:
    """Over all rows: the loss as a token mean, the shares of clipped tokens, and the approximate divergence."""
    n = F.sum(sums["n"])
    shares = [(F.sum(sums[part]) / (n + 1e-8)).alias(name) for part, name in (("clipped", "clip_fraction"), ("lower", "lower_fraction"), ("kl", "approximate_kl"))]
    return [(F.sum(sums["loss"]) / n).alias("loss"), *shares]


def value_loss(new: Column, old: Column, returns: Column, clip_at: float) -> Column:
    """Per token the larger of the squared errors with and without clipping."""
    return F.transform(_value(new, old, returns, clip_at), lambda x: F.greatest(x["plain"], x["clipped"]))


def _value(new: Column, old: Column, returns: Column, clip_at: float) -> Column:
    rows = F.zip_with(F.zip_with(new, old, lambda a, b: F.struct(a.alias("v"), b.alias("o"))), returns, lambda x, r: F.struct(x["v"].alias("v"), x["o"].alias("o"), r.alias("r")))

    def errors(x: Column) -> Column:
        plain, near = x["v"] - x["r"], clip(x["v"], x["o"] - clip_at, x["o"] + clip_at) - x["r"]
        return F.struct((plain * plain).alias("plain"), (near * near).alias("clipped"))

    return F.transform(rows, errors)


def value_sums(new: Column, old: Column, returns: Column, mask: Column, clip_at: float) -> Column:
    """A row's masked sums for :func:`value_metrics`: loss, clipped, n."""
    errors = _value(new, old, returns, clip_at)
    loss = masked_sum(F.transform(errors, lambda x: F.greatest(x["plain"], x["clipped"])), mask)
    taken = masked_sum(F.transform(errors, lambda x: F.when(x["clipped"] > x["plain"], 1.0).otherwise(0.0)), mask)
    return F.struct(loss.alias("loss"), taken.alias("clipped"), total(mask).alias("n"))


def value_metrics(sums: Column) -> list[Column]:
    """Over all rows: the loss as a token mean, and the share of tokens where the clipped error is larger."""
    n = F.sum(sums["n"])
    return [(F.sum(sums["loss"]) / n).alias("loss"), (F.sum(sums["clipped"]) / (n + 1e-8)).alias("clip_fraction")]


def logsumexp(logits: Column) -> Column:
    top = F.array_max(logits)
    return top + F.log(total(F.transform(logits, lambda x: F.exp(x - top))))


def entropy(logits: Column) -> Column:
    norm = logsumexp(logits)
    return norm - total(F.transform(logits, lambda x: F.exp(x - norm) * x))


def logprob(logits: Column, label: Column) -> Column:
    """The log-probability of the label, counted from 0."""
    return F.element_at(logits, label + 1) - logsumexp(logits)


def chosen_logps(logps: Column, steps: Column, tokens: Column, scores: Column) -> Column:
    """Log-probabilities of the chosen tokens, from the first source that gives any.

    ``logps`` as they are; else of each of the ``steps`` (a map of its candidates) the chosen
    token's, or the largest; else ``scores``. Missing ones are left out; without any, an empty array.
    """
    known = lambda x: F.filter(x, lambda v: v.isNotNull())
    some = lambda x: F.when(F.size(x) > 0, x)
    places = F.transform(steps, lambda step, i: F.coalesce(F.try_element_at(step, F.try_element_at(tokens, i + 1)), F.array_max(F.map_values(step))))
    return F.coalesce(some(known(logps)), some(known(places)), known(scores), F.array().cast("array<double>"))


def mean_logp(logps: Column) -> Column:
    """The mean, or NaN of no tokens."""
    return F.when(F.coalesce(F.size(logps), F.lit(0)) <= 0, F.lit(float("nan"))).otherwise(total(logps) / F.size(logps))


def topk_entropy(logps: Column, eps: float = 1e-12) -> Column:
    """Entropy of the listed probabilities and of the rest as one; no entries give NaN."""
    p = F.transform(logps, F.exp)
    tail = F.greatest(F.lit(0.0), 1 - total(p))
    some = -total(F.transform(p, lambda x: x * F.log(x + eps))) - tail * F.log(tail + eps)
    return F.when(F.size(logps) == 0, F.lit(float("nan"))).otherwise(some)


def mean_step_entropy(steps: Column) -> Column:
    """The mean over a text's steps of :func:`topk_entropy`, without steps that list nothing; NaN if none does."""
    found = F.transform(F.filter(steps, lambda s: F.coalesce(F.size(s), F.lit(0)) > 0), lambda s: topk_entropy(s))
    return F.when(F.coalesce(F.size(found), F.lit(0)) <= 0, F.lit(float("nan"))).otherwise(total(found) / F.size(found))


def mask_to_eos(ids: Column, eos: Column | list[int]) -> Column:
    """1 up to and including the first end token, of which there may be several kinds."""
    ends = F.array(*map(F.lit, eos)) if isinstance(eos, list) else F.array(eos)
    at = F.array_position(F.transform(ids, lambda x: F.array_contains(ends, x)), F.lit(True))
    return F.transform(ids, lambda x, i: F.when((at == 0) | (i < at), 1).otherwise(0))


def position_ids(mask: Column) -> Column:
    return F.transform(running_sum(mask), lambda s: F.greatest(s - 1, F.lit(0)).cast("int"))


def remove_pad(ids: Column, mask: Column) -> Column:
    """The ids that the mask marks, wherever they are."""
    return F.transform(F.filter(F.zip_with(ids, mask, lambda x, m: F.struct(x.alias("x"), m.alias("m"))), lambda e: e["m"] != 0), lambda e: e["x"])


def pad_left(ids: Column, width: int, fill: Column) -> Column:
    return F.concat(F.array_repeat(fill, F.greatest(F.lit(width) - F.size(ids), F.lit(0))), ids)


def truncate(ids: Column, most: int, side: str) -> Column:
    """Cut to ``most`` tokens from the left, the right or the middle, or fail."""
    if side == "left":
        cut = F.slice(ids, F.lit(-most), F.lit(most))
    elif side == "right":
        cut = F.slice(ids, F.lit(1), F.lit(most))
    elif side == "middle":
        head = most // 2
        cut = F.concat(F.slice(ids, F.lit(1), F.lit(head)), F.slice(ids, F.lit(head - most), F.lit(most - head)))
    elif side == "error":
        cut = F.raise_error(F.lit(f"more than {most} tokens")).cast("array<int>")
    else:
        raise ValueError(side)
    return F.when(F.size(ids) > most, cut).otherwise(ids)


def sft_loss_mask(attention: Column, prompt: Column, response: Column) -> Column:
    """The prompt but its last token, and the response's last token, carry no loss."""
    return F.transform(attention, lambda m, i: F.when((prompt > 1) & (i < prompt - 1), 0).when(i == F.least(prompt + response, F.size(attention)) - 1, 0).otherwise(m))


def scatter_last(score: Column, width: int, valid: Column) -> Column:
    """Zeros but for the score at the last valid place (the last place of all if none is valid)."""
    at = F.when(valid > 0, valid - 1).otherwise(width - 1)
    return F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda i: F.when(i == at, score).otherwise(0.0))


def overlong_penalty(length: Column, longest: int, buffer: int, factor: float) -> Column:
    return F.least(-(length - (longest - buffer)) / F.lit(float(buffer)) * factor, F.lit(0.0)) + 0.0  # no negative zero
