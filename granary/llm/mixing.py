"""Mixing sources to target weights, in DataFrame operations only.

Each row gets a uniform hash key; within its source the rows are ordered by
that key (range cells of equal width, see :mod:`granary.llm.prefix`), running
totals of sizes are computed in two levels, and every source is cut at its
exact budget. A budget above the source's size repeats whole epochs first.

Targets: the sources in code-point order, null last, weigh ``weights`` in turn
and share ``share`` of all sizes; no target exceeds ``cap`` times its source,
and the excess is shared by weight among the others. That is the water level
``L`` with ``sum(min(cap_s, L * w_s)) = budget``, found by running sums over
the sources in the order of ``cap_s / w_s``.

Defined results: null texts have size 0; a null source is a source; repeated
rows, ids and null ids are mixed each row for itself; an empty table gives an
empty result; further columns are ignored or, in :func:`mixed_rows`, kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from granary.llm.prefix import cell_count, cell_of, hash_key, within_cell
from granary.llm.rows import FEW, fresh, likeness, named, numbered
from granary.session import pinned

WEIGHTS = (5, 2, 1)
SHARE = 1.5
CAP = 2


def word_count(text: Column) -> Column:
    """Number of runs of anything but ASCII white space; null counts 0."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sources: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, cap: int = CAP) -> DataFrame:
    """(src, source, source_size) gets ``target``. The windows see one row per source."""
    everything = Window.partitionBy(F.lit(1))
    ranked = sources.withColumn("place", F.row_number().over(everything.orderBy(F.col("source").asc_nulls_last())) - 1)
    weighed = ranked.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("place") % len(weights) + 1).cast("int")).cast("double"))
    filled = weighed.withColumn("most", F.col("source_size") * cap).withColumn("level", F.col("most") / F.col("weight"))
    upward = everything.orderBy("level", "place")
    before = upward.rowsBetween(Window.unboundedPreceding, -1)
    onward = upward.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    filled = filled.withColumn("budget", F.sum("source_size").over(everything) * F.lit(share)).withColumn("at", F.row_number().over(upward))
    filled = filled.withColumn("water", (F.col("budget") - F.coalesce(F.sum("most").over(before), F.lit(0))) / F.sum("weight").over(onward))
    first = F.min(F.when(F.col("water") <= F.col("level"), F.struct("at", "water"))).over(everything)
    filled = filled.withColumn("water", first["water"])
    return filled.select("src", "source", "source_size", F.least(F.col("most").cast("double"), F.coalesce(F.col("water"), F.lit(0.0)) * F.col("weight")).alias("target"))


ORDER = ("key", "doc_id", "size", "like", "file", "index")  # of a source's rows; the first decides but for repeated ids


def _placed(docs: DataFrame, weights: tuple, share: float, cap: int, seed: str, id_col: str, text_col: str, source_col: str, like: Column, file: Column, index: Column) -> DataFrame:
    """One narrow row per document, with ``taken`` and ``copies`` as in :func:`mix`."""
    source = F.col(source_col).cast("string")
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), source.alias("source"), _bucket(source).alias("src"), word_count(F.col(text_col)).alias("size"),
        like.alias("like"), file.alias("file"), index.alias("index"),
    )
    rows = pinned(rows.withColumn("key", hash_key(seed, "doc_id")))
    rows = rows.withColumn("cell", cell_of("key", cell_count(rows)))
    cells = rows.groupBy("src", "cell").agg(F.sum("size").alias("cell_total"), F.first("source").alias("source"))
    sources = cells.groupBy("src").agg(F.sum("cell_total").alias("source_size"), F.first("source").alias("source"))
    run = Window.partitionBy("src").orderBy("cell").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cells = cells.select("src", "cell", (F.sum("cell_total").over(run) - F.col("cell_total")).alias("cell_before"))
    cells = cells.join(targets(sources, weights, share, cap).select("src", "source_size", "target"), "src")
    placed = within_cell(rows, "src", "cell", list(ORDER), "size").join(cells, ["src", "cell"])
    goal = F.floor("target").cast("long")
    epochs = F.when(F.col("source_size") > 0, F.floor(goal / F.col("source_size"))).otherwise(0).cast("long")
    rest = goal - epochs * F.col("source_size") - (F.col("cell_before") + F.col("in_cell"))
    part = F.greatest(F.lit(0), F.least(F.col("size"), rest))
    placed = placed.withColumns({"epochs": epochs.cast("int"), "whole": F.when((rest > 0) & (part * 2 >= F.col("size")), 1).otherwise(0), "part": part})
    return placed.withColumns({"taken": (F.col("epochs") * F.col("size") + F.col("part")).cast("long"), "copies": F.col("epochs") + F.col("whole")})


def _bucket(source: Column) -> Column:
    return F.coalesce(F.concat(F.lit("="), source), F.lit("~"))


def mix(docs: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, cap: int = CAP, seed: str = "mix", id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, taken, copies, key.

    ``taken`` is what the mix takes of the document's size over all epochs;
    ``copies`` is the same in whole documents, the one at the cut rounded.
    """
    placed = _placed(docs, weights, share, cap, seed, id_col, text_col, source_col, likeness(docs), F.lit(b""), F.monotonically_increasing_id())
    return placed.select("doc_id", "source", "size", "source_size", "target", "taken", "copies", "key")


def mixed_rows(docs: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, cap: int = CAP, seed: str = "mix", id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The documents of the mix with the input's columns, each as often as its copies.

    In a source's order the documents with one copy more come first, so a row's copies
    follow from the last of them: one place per source meets the documents, which don't move.
    """
    rows, file, index = numbered(docs)
    placed = _placed(rows, weights, share, cap, seed, id_col, text_col, source_col, likeness(docs), F.col(file), F.col(index))
    last = placed.groupBy("src").agg(F.max(F.when(F.col("whole") == 1, F.struct(*ORDER))).alias("last"), F.first("epochs").alias("epochs"))
    src, ends, epochs, copy = fresh(rows.columns, "src", "last", "epochs", "copy")
    last = pinned(last.select(F.col("src").alias(src), F.col("last").alias(ends), F.col("epochs").alias(epochs)))
    met = rows.withColumn(src, _bucket(named(source_col).cast("string"))).join(F.broadcast(last) if last.count() <= FEW else last, src)
    doc_id, size = named(id_col).cast("long"), word_count(named(text_col))
    own = F.struct(hash_key(seed, doc_id).alias("key"), doc_id.alias("doc_id"), size.alias("size"), likeness(docs).alias("like"), named(file).alias("file"), named(index).alias("index"))
    copies = F.col(epochs) + F.when(own <= F.col(ends), 1).otherwise(0)
    return met.withColumn(copy, F.explode(F.sequence(F.lit(1), F.greatest(copies, F.lit(1)), F.lit(1)))).where(copies > 0).select(*[named(c) for c in docs.columns])
