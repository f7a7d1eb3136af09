"""Plug-in functions over a batch: chunk by chunk, or the same for all rows, as Arrow-fed pandas functions."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame

from granary.operators.batch import chunk


def by_chunk(batch: DataFrame, chunks: int, function: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """Apply a function to each of ``chunks`` equal runs of a batch, whole and in row order.

    A chunk must fit a task: choose their number by the batch's size, or use :func:`by_piece`.
    """

    def run(part: pd.DataFrame) -> pd.DataFrame:
        return function(part.sort_values("row_id").reset_index(drop=True))

    return chunk(batch, chunks).groupBy("chunk_id").applyInPandas(run, schema)


def by_piece(batch: DataFrame, function: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """Apply a function to Arrow-sized pieces where they are: bounded memory, no shuffle, no promise on their bounds."""

    def run(pieces: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield from map(function, pieces)

    return batch.mapInPandas(run, schema)
