"""Scorers chosen by data source, and how their results become columns."""

from __future__ import annotations

from collections.abc import Callable, Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


class Scorers:
    """A registry: sources (or a prefix ending in *) to functions of (answer, truth) columns.

    A function returns a number, or a struct whose ``score`` field is the reward and
    whose other fields become columns.
    """

    def __init__(self):
        self.entries: list[tuple[tuple[str, ...], Callable[[Column, Column], Column]]] = []

    def register(self, *sources: str):
        def add(function):
            self.entries.append((sources, function))
            return function

        return add

    def score(self, source: Column, answer: Column, truth: Column) -> Column:
        """A case expression over the sources; an unknown source raises."""
        out = None
        for sources, function in self.entries:
            match = F.lit(False)
            for name in sources:
                match = match | (source.startswith(name[:-1]) if name.endswith("*") else source == name)
            value = function(answer, truth)
            out = F.when(match, value) if out is None else out.when(match, value)
        return out.otherwise(F.raise_error(F.concat(F.lit("no scorer for "), source)).cast("double"))


def apply(rows: DataFrame, scorers: Scorers, source: str, answer: str, truth: str) -> DataFrame:
    """Add ``score``; rows that come with ``rm_scores`` keep those."""
    made = scorers.score(F.col(source), F.col(answer), F.col(truth))
    return rows.withColumn("score", F.coalesce("rm_scores", made) if "rm_scores" in rows.columns else made)


def guarded(function: Callable[[str, str], float]):
    """A row scorer as an Arrow UDF in which a failure scores 0."""

    def run(answers: pd.Series, truths: pd.Series) -> pd.Series:
        def one(answer, truth):
            try:
                return float(function(answer, truth))
            except Exception:  # a scorer's failure is a score by contract
                return 0.0

        return pd.Series([one(a, t) for a, t in zip(answers, truths, strict=True)], dtype="float64")

    return F.pandas_udf(run, T.DoubleType())


def expand(rows: DataFrame, result: str, fields: Iterable[str]) -> DataFrame:
    """The fields of a scorer's struct as columns."""
    return rows.select("*", *[F.col(f"{result}.{f}").alias(f) for f in fields]).drop(result)
