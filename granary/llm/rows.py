"""Rows that can be found again: stable numbers, names that don't clash, and dropping by number.

An operator that keeps or repeats rows decides on narrow columns only and carries
each row's number: for a file scan the digest of the file's path and the row's
index in it, which a second scan gives again however it is split; for anything
else the table is pinned first and numbered there.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.session import pinned

FEW = 200_000  # rows of a number each that may be broadcast, some tens of MB


def fresh(taken: list[str], *names: str) -> list[str]:
    """The names, each with underscores added until no column has it."""
    used, out = {c.lower() for c in taken}, []
    for name in names:
        while name.lower() in used:
            name += "_"
        used.add(name.lower())
        out.append(name)
    return out


def named(name: str) -> Column:
    """A column by its exact name, whatever characters that holds."""
    return F.col("`" + name.replace("`", "``") + "`")


def numbered(docs: DataFrame) -> tuple[DataFrame, str, str]:
    """The rows with two more columns that together are unique and stable, and their names."""
    file, index = fresh(docs.columns, "file", "index")
    if _is_scan(docs):
        try:
            return docs.withColumns({file: F.unhex(F.md5(F.col("_metadata.file_path").cast("binary"))), index: F.col("_metadata.row_index")}), file, index
        except AnalysisException:  # of files whose rows have no index
            pass
    return pinned(docs).withColumns({file: F.lit(b""), index: F.monotonically_increasing_id()}), file, index


def _is_scan(docs: DataFrame) -> bool:
    """Whether every row is one row of a file: a scan, filtered or projected at most."""
    node = docs._jdf.queryExecution().analyzed()
    while node.nodeName() in ("Project", "Filter", "SubqueryAlias"):
        node = node.children().head()
    return node.nodeName() == "LogicalRelation" and "_metadata" not in docs.columns


def likeness(docs: DataFrame) -> Column:
    """A hash of all columns: decides between rows of equal id and text, so that reruns agree."""
    parts = []
    for field in docs.schema.fields:
        c = named(field.name)
        parts += [F.to_json(F.struct(c)) if "map<" in field.dataType.simpleString() else c, c.isNull()]
    return F.xxhash64(*parts)


def without(docs: DataFrame, dropped: DataFrame, file: str, index: str) -> DataFrame:
    """The numbered rows less those in ``dropped`` (file, index), and less the numbers; few are broadcast, and no row moves."""
    dropped = pinned(dropped.select(F.col("file").alias(file), F.col("index").alias(index)))
    return docs.join(F.broadcast(dropped) if dropped.count() <= FEW else dropped, [file, index], "left_anti").drop(file, index)
