"""Sequence packing layout, rank slices, and rollouts folded over their turns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def packed_offsets(rows: DataFrame, group: str, order: str, length: str) -> DataFrame:
    """Add ``begins`` and ``ends`` (cumulative lengths from 0) and the group's ``longest``."""
    run = Window.partitionBy(group).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ends = F.sum(length).over(run)
    return rows.withColumns({"ends": ends, "begins": ends - F.col(length), "longest": F.max(length).over(Window.partitionBy(group))})


def rank_slice(ids: Column, rank: int, ranks: int, fill: Column) -> Column:
    """Pad to a multiple of ``ranks`` and take one rank's share."""
    padded = F.concat(ids, F.array_repeat(fill, F.pmod(-F.size(ids), F.lit(ranks))))
    share = (F.size(padded) / ranks).cast("int")
    return F.slice(padded, share * rank + 1, share)


def fold_turns(turns: Column, max_turns: int, max_tokens: int) -> Column:
    """The final state of a rollout over its turns (role, n): COMPLETED, LENGTH or TURNS, with counts.

    Turns are taken until the turn or token limit; the first that would exceed one ends the rollout.
    """
    start = F.struct(F.lit("RUNNING").alias("state"), F.lit(0).alias("turns"), F.lit(0).cast("long").alias("tokens"))

    def step(s: Column, t: Column) -> Column:
        over_turns, over_tokens = s["turns"] + 1 > max_turns, s["tokens"] + t["n"] > max_tokens
        halted = s["state"] != "RUNNING"
        state = F.when(halted, s["state"]).when(over_turns, "TURNS").when(over_tokens, "LENGTH").otherwise("RUNNING")
        more = state == "RUNNING"
        return F.struct(state.alias("state"), (s["turns"] + more.cast("int")).alias("turns"), (s["tokens"] + F.when(more, t["n"]).otherwise(0)).alias("tokens"))

    return F.aggregate(turns, start, step, lambda s: F.struct(F.when(s["state"] == "RUNNING", "COMPLETED").otherwise(s["state"]).alias("state"), s["turns"].alias("turns"), s["tokens"].alias("tokens")))


def kl_controller(kls: list[float], steps: int, target: float, horizon: float, start: float) -> list[float]:
    """The adaptive coefficient after each step, from 20 % clipped proportional errors."""
    out, beta = [], start
    for kl in kls:
        beta *= 1 + max(-0.2, min(0.2, kl / target - 1)) * steps / horizon
        out.append(beta)
    return out
