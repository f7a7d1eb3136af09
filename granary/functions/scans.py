"""Running folds over token arrays, linear in their length: Arrow batches of rows, one place of all rows at a time."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

CELLS = 1 << 21  # numbers of a matrix of rows


def _blocks(arrays: pd.Series):
    """Positions of consecutive rows that make a matrix of at most about ``CELLS`` numbers."""
    widths = [0 if x is None else len(x) for x in arrays]
    at, widest = 0, 1
    for k, width in enumerate(widths):
        if k > at and max(widest, width) * (k - at + 1) > CELLS:
            yield at, k
            at, widest = k, 1
        widest = max(widest, width)
    if widths:
        yield at, len(widths)


def _matrix(arrays: pd.Series, fill: float) -> np.ndarray:
    out = np.full((len(arrays), max((0 if x is None else len(x) for x in arrays), default=0)), fill)
    for row, x in zip(out, arrays, strict=True):
        if x is not None:
            row[: len(x)] = x
    return out


def _listed(rows: np.ndarray, like: pd.Series) -> list:
    return [None if x is None else row[: len(x)] for row, x in zip(rows, like, strict=True)]


def reverse_scan(values: Column, gain: float = 1.0, keep: Column | None = None) -> Column:
    """``s[t] = values[t] + gain * keep[t + 1] * s[t + 1]``, in array order; ``keep`` is 1 where left out."""

    @F.pandas_udf("array<double>")
    def run(values: pd.Series, keep: pd.Series) -> pd.Series:
        out: list = []
        for a, b in _blocks(values):
            x, k = _matrix(values[a:b], 0.0), _matrix(keep[a:b], 1.0)
            k = np.pad(k, ((0, 0), (0, max(0, x.shape[1] - k.shape[1]))), constant_values=1.0)
            for t in range(x.shape[1] - 2, -1, -1):
                x[:, t] += gain * k[:, t + 1] * x[:, t + 1]
            out += _listed(x, values[a:b])
        return pd.Series(out, dtype=object)

    return run(values.cast("array<double>"), (F.array().cast("array<double>") if keep is None else keep.cast("array<double>")))


def running_sum(values: Column) -> Column:
    """``s[t] = values[0] + ... + values[t]``."""

    @F.pandas_udf("array<double>")
    def run(values: pd.Series) -> pd.Series:
        out: list = []
        for a, b in _blocks(values):
            out += _listed(np.cumsum(_matrix(values[a:b], 0.0), axis=1), values[a:b])
        return pd.Series(out, dtype=object)

    return run(values.cast("array<double>"))
