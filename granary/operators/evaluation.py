"""Evaluation over sampled responses: fusion of answers, votes, best and worst of n."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from granary.functions.tokens import total

CONSISTENCY, AVERAGE, MAXIMUM = 0.25, 0.2, 0.55  # fixed weights of the fusion


def fusion_select(samples: DataFrame, row: str, pos: str, answer: str, logprob: str, entropy: str, carry: list[str] | None = None) -> DataFrame:
    """For each row the sample to answer with: (row, pos, answer, fused), and its columns to carry along.

    Null answers are none. Confidence is exp(logprob) * (1 - entropy); samples without one drop out. Per answer the
    count, mean and maximum of confidence are each divided by the row's largest and blended;
    the best answer gives its most confident sample, ties going to the earlier one.
    """
    conf = F.exp(logprob) * (1 - F.col(entropy))
    valid = samples.withColumn("_c", conf).where(F.col("_c").isNotNull() & ~F.isnan("_c"))
    best = F.max_by(F.struct(pos, *carry or ()), F.struct("_c", -F.col(pos)))
    # Samples without an answer go after the grouping: a filter before it would be pushed below, and evaluate, the extraction.
    groups = valid.groupBy(row, answer).agg(F.count(answer).alias("_n"), F.avg("_c").alias("_avg"), F.max("_c").alias("_max"), F.min(pos).alias("_first"), best.alias("_best")).where("_n > 0")
    own = Window.partitionBy(row)
    share = lambda c: F.try_divide(F.col(c), F.max(c).over(own))
    fused = groups.withColumn("fused", CONSISTENCY * share("_n") + AVERAGE * share("_avg") + MAXIMUM * share("_max"))
    ranked = fused.withColumn("_r", F.row_number().over(own.orderBy(F.desc_nulls_last("fused"), "_first")))
    return ranked.where("_r = 1").select(row, "_best.*", answer, "fused")


def majority(votes: DataFrame, group: list[str], pred: str, value: str, pos: str) -> DataFrame:
    """The most frequent prediction, the earlier seen of equals, with its first value."""
    counts = votes.groupBy(*group, pred).agg(F.count("*").alias("votes"), F.min(pos).alias("_first"), F.min_by(value, pos).alias(value))
    ranked = counts.withColumn("_r", F.row_number().over(Window.partitionBy(*group).orderBy(F.desc("votes"), "_first")))
    return ranked.where("_r = 1").drop("_r", "_first")


def mean_std(votes: DataFrame, source: str, prompt: str, value: str) -> DataFrame:
    """Per source the mean over prompts of each prompt's mean and population deviation."""
    per = votes.groupBy(source, prompt).agg(F.avg(value).alias("_m"), F.stddev_pop(value).alias("_s"), F.count("*").alias("_n"))
    return per.groupBy(source).agg(F.avg("_m").alias("mean_n"), F.avg("_s").alias("std_n"), F.max("_n").alias("n_max"))


def resamples(n: int, size: int, rounds: int = 1000, seed: int = 42) -> np.ndarray:
    """Positions of ``rounds`` resamples of ``size`` out of ``n``, with replacement; seeded anew for each call."""
    state = np.random.RandomState(seed)
    return np.stack([state.choice(n, size, replace=True) for _ in range(rounds)])


def sizes_below(n: int) -> list[int]:
    """2, 4, 8, ... below n, and n."""
    out, k = [], 2
    while k < n:
        out.append(k)
        k *= 2
    return [*out, n]


@lru_cache(maxsize=16)
def _draws(n: int, size: int, rounds: int) -> np.ndarray:
    return resamples(n, size, rounds).astype(np.int32)


def _first_of_most(codes: np.ndarray) -> np.ndarray:
    """In each row the place of the most frequent code, the earlier seen of equals."""
    rounds, kinds = len(codes), int(codes.max()) + 1
    tally = np.bincount((np.arange(rounds)[:, None] * kinds + codes).ravel(), minlength=rounds * kinds).reshape(rounds, kinds)
    return np.take_along_axis(tally, codes, axis=1).argmax(axis=1)


def bootstrap(votes: DataFrame, source: str, prompt: str, value: str, pos: str, pred: str | None = None, rounds: int = 1000) -> DataFrame:
    """(source, n, best, best_std, worst, worst_std[, maj, maj_std]) by resampling each prompt's values.

    The resampled positions depend on (group size, n) alone. A task holds one prompt's values and
    ``rounds`` resamples of them at a time; what leaves it is a row a prompt and n. Null values
    take no part, prompts with fewer than two values have no resamples.
    """
    names = ["best", "worst", *(["maj"] if pred else [])]
    kind = dict(votes.dtypes)[source]
    entry = F.struct(F.col(pos).alias("pos"), F.col(value).cast("double").alias("value"), (F.col(pred) if pred else F.lit(None)).cast("string").alias("pred"))
    held = votes.where(F.col(value).isNotNull()).groupBy(source, prompt).agg(F.array_sort(F.collect_list(entry)).alias("rows")).where(F.size("rows") > 1)
    columns = ["n", *(f"{name}{end}" for name in names for end in ("", "_std"))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sources, found = [], []
            for at, rows in enumerate(batch.column(1)):
                values = rows.values.field("value").to_numpy()
                codes = np.unique(np.array(rows.values.field("pred").to_pylist(), object).astype(str), return_inverse=True)[1]
                for n in sizes_below(len(values)):
                    draws = _draws(len(values), n, rounds)
                    drawn = values[draws]
                    taken = [drawn.max(axis=1), drawn.min(axis=1)]
                    if pred:
                        taken.append(drawn[np.arange(rounds), _first_of_most(codes[draws])])
                    sources.append(at)
                    found.append((n, *(x for t in taken for x in (t.mean(), t.std()))))
            if found:
                data = [pa.array(c, pa.float64() if k else pa.int32()) for k, c in enumerate(zip(*found, strict=True))]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(sources)), *data], [source, *columns])

    each = held.select(source, "rows").mapInArrow(run, f"`{source}` {kind}, n int, " + ", ".join(f"{c} double" for c in columns[1:]))
    return each.groupBy(source, "n").agg(*[F.avg(c).alias(c) for c in columns[1:]])


def spread_of(values: Column, prefix: str) -> list[Column]:
    """Mean, maximum and minimum."""
    return [F.avg(values).alias(f"{prefix}_mean"), F.max(values).alias(f"{prefix}_max"), F.min(values).alias(f"{prefix}_min")]


def data_metrics(rows: DataFrame, scores: str, rewards: str, advantages: str, returns: str, mask: str, prompt_mask: str, values: str | None = None) -> DataFrame:
    """One row: means, maxima and minima of a batch's sequence scores and rewards, of the advantages, returns and
    values of valid tokens, of response and prompt lengths with the shares at the full width, and the explained
    variance of the returns (both last only with ``values``).
    """
    parts = [F.col(scores).alias("s"), F.col(rewards).alias("w"), F.col(mask).alias("m"), F.col(prompt_mask).alias("p"), F.col(advantages).alias("a"), F.col(returns).alias("t")]
    rows = rows.select(*parts, *([F.col(values).alias("v")] if values else []))
    whole = rows.select(total(F.col("s")).alias("score"), total(F.col("w")).alias("reward"), total(F.col("m")).alias("response"), F.size("m").alias("wide"), total(F.col("p")).alias("prompt"), F.size("p").alias("prompt_wide"))
    full = lambda n, wide, name: F.avg((F.col(n) == F.col(wide)).cast("int")).alias(name)
    columns = [*spread_of(F.col("score"), "score"), *spread_of(F.col("reward"), "reward"), *spread_of(F.col("response"), "response_length"), full("response", "wide", "response_length_clipped")]
    sequences = whole.agg(*columns, *spread_of(F.col("prompt"), "prompt_length"), full("prompt", "prompt_wide", "prompt_length_clipped"))
    places = rows.select(F.explode(F.arrays_zip("m", "a", "t", *(["v"] if values else []))).alias("e")).where("e.m != 0")
    columns = [*spread_of(F.col("e.a"), "advantage"), *spread_of(F.col("e.t"), "return")]
    if values:
        explained = 1 - F.var_samp(F.col("e.t") - F.col("e.v")) / (F.var_samp("e.t") + 1e-5)
        columns += [*spread_of(F.col("e.v"), "value"), explained.alias("explained_variance")]
    return sequences.crossJoin(F.broadcast(places.agg(*columns)))  # one row each


def timing_metrics(stages: DataFrame, stage: str, seconds: str, tokens: int | Column, response_tokens: int | Column, generating: tuple = ("gen",), whole: tuple = ("ref", "values", "adv", "update_critic", "update_actor")) -> DataFrame:
    """Per stage its seconds and milliseconds a token: of the response for generating stages, of all tokens for ``whole`` ones, else null."""
    of = F.when(F.col(stage).isin(*generating), response_tokens).when(F.col(stage).isin(*whole), tokens)
    return stages.select(F.col(stage).alias("stage"), F.col(seconds).alias("seconds"), (F.col(seconds) * 1000 / of).alias("ms_per_token"))


def reduced(rows: DataFrame, name: str = "name", value: str = "value") -> DataFrame:
    """Per name the maximum, minimum or mean of its values, as the name says."""
    picked = F.when(F.col(name).contains("max"), F.max(value)).when(F.col(name).contains("min"), F.min(value)).otherwise(F.avg(value))
    return rows.groupBy(name).agg(picked.alias(value))


def metric_names(rows: DataFrame, source: str, variable: str, metric: str, core: str = "acc") -> DataFrame:
    """Add ``name``: val-core for the core variable's mean, maj and best at the largest number of its source, else val-aux.

    The number is what stands behind the metric's ``@``; the core variable is ``core`` where the
    source has it, else ``reward``.
    """
    number = F.coalesce(F.regexp_extract(metric, r"@([0-9]+)[^@]*\z", 1).try_cast("int"), F.lit(0))
    one = Window.partitionBy(source, variable)
    known = F.max((F.col(variable) == core).cast("int")).over(Window.partitionBy(source))
    marked = rows.withColumns({"_most": F.max(number).over(one), "_core": F.when(known == 1, F.lit(core)).otherwise("reward")})
    top = (F.col(variable) == F.col("_core")) & F.col(metric).rlike("^(mean|maj|best)") & F.col(metric).contains(F.concat(F.lit("@"), F.col("_most")))
    return marked.withColumn("name", F.concat_ws("/", F.when(top, "val-core").otherwise("val-aux"), source, variable, metric)).drop("_most", "_core")


def step_rewards(rows: DataFrame, group: str, order: str, score: str, reward: float = 0.0, penalty: float = -0.05) -> DataFrame:
    """Add ``reward``: ``reward`` where a step scores above the one before (0 before the first), else ``penalty``."""
    before = F.coalesce(F.lag(score).over(Window.partitionBy(group).orderBy(order)), F.lit(0.0))
    return rows.withColumn("reward", F.when(F.col(score) > before, reward).otherwise(penalty))
