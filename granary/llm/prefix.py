"""Distributed running totals over hash-ordered rows.

Rows get a uniform hash key; its leading bits cut every group into
``ceil(sqrt(n))`` equal cells, so that both the rows of one cell and the cells
of one group number about ``sqrt(n)``, whatever share of the rows one group
holds. A cell's rows are summed by one window, the cells by a second, and the
two meet on (group, cell).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def hash_key(seed: str, *cols: str | Column) -> Column:
    """32 hex digits, uniform; nulls take part as a text of their own."""
    parts = [F.coalesce((F.col(c) if isinstance(c, str) else c).cast("string"), F.lit("~")) for c in cols]
    return F.md5(F.concat_ws(":", F.lit(seed), *parts))


def cell_count(rows: DataFrame) -> int:
    return max(1, math.ceil(math.sqrt(rows.count())))


def cell_of(key: str, cells: int) -> Column:
    """The cell of a hash key: order-preserving, from its first 32 bits."""
    head = F.conv(F.substring(F.col(key), 1, 8), 16, 10).cast("long")
    return F.floor(head * F.lit(cells) / F.lit(float(1 << 32))).cast("int")


def cell_totals(rows: DataFrame, group: str, cell: str, value: str) -> DataFrame:
    """(group, cell, cell_total, cell_before): what the group holds before each cell."""
    totals = rows.groupBy(group, cell).agg(F.sum(value).alias("cell_total"))
    run = Window.partitionBy(group).orderBy(cell).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return totals.withColumn("cell_before", F.sum("cell_total").over(run) - F.col("cell_total"))


def within_cell(rows: DataFrame, group: str, cell: str, order: list[str], value: str) -> DataFrame:
    """Add ``in_cell``: the total of the rows before this one in its cell."""
    run = Window.partitionBy(group, cell).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumn("in_cell", F.sum(value).over(run) - F.col(value))
