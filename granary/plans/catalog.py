"""The tables of queries and statements, and the frames that queries share.

``ROLLOUTS`` and the like are the same derivations as DuckDB text; the statements
below them start from these.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from granary.session import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name."""

    def add(function):
        QUERIES[function.__name__] = function
        if sql:
            ORACLES[function.__name__] = sql
        return function

    return add


LINE_ORDER = ("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_shipdate")

ROLLOUTS = """rollouts AS (
    SELECT l_orderkey AS uid, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_shipdate) - 1 AS sample_id,
           l_quantity AS score, 1 + floor(l_extendedprice)::BIGINT % 50 AS length
    FROM lineitem)"""

TOKENS = """tokens AS (
    SELECT vec_id, label, list_transform(embedding[1:16], lambda x: x::DOUBLE) AS r, list_transform(embedding[17:32], lambda x: x::DOUBLE) AS v,
           list_transform(embedding[33:48], lambda x: x::DOUBLE) AS o, list_transform(embedding[49:64], lambda x: x::DOUBLE) AS a,
           list_transform(range(1, 17), lambda i: CASE WHEN i <= label THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS m
    FROM embeddings)"""

VOTES = """votes AS (
    SELECT event_type AS source, user_id AS prompt, strftime(ts, '%d') AS day, event_type AS pred, value,
           row_number() OVER (PARTITION BY user_id, strftime(ts, '%d') ORDER BY event_id) - 1 AS pos
    FROM events)"""


def rollouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem")
    order = Window.partitionBy("l_orderkey").orderBy(*LINE_ORDER)
    return lines.select(F.col("l_orderkey").alias("uid"), (F.row_number().over(order) - 1).alias("sample_id"), F.col("l_quantity").alias("score"), (1 + F.floor("l_extendedprice") % 50).alias("length"))


def tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """r, v, o, a: four arrays of 16 numbers; m: a mask of ``label`` ones."""
    rows = table(spark, sf_dir, "embeddings")
    part = lambda k: F.slice("embedding", 16 * k + 1, 16).cast("array<double>")
    mask = F.transform(F.sequence(F.lit(1), F.lit(16)), lambda i: F.when(i <= F.col("label"), 1.0).otherwise(0.0))
    return rows.select("vec_id", "label", part(0).alias("r"), part(1).alias("v"), part(2).alias("o"), part(3).alias("a"), mask.alias("m"))


def votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").withColumn("day", F.date_format("ts", "dd"))
    order = Window.partitionBy("user_id", "day").orderBy("event_id")
    return events.select(F.col("event_type").alias("source"), F.col("user_id").alias("prompt"), "day", F.col("event_type").alias("pred"), "value", (F.row_number().over(order) - 1).alias("pos"))


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A batch: customer keys are dense from 0."""
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("row_id"), F.col("c_acctbal").alias("obs"), F.col("c_mktsegment").alias("label"), F.col("c_nationkey").alias("times"))


CUSTOMERS = "batch AS (SELECT c_custkey AS row_id, c_acctbal AS obs, c_mktsegment AS label, c_nationkey AS times FROM customer)"


def r6(column, name: str):
    """Rounded for comparison: sums of doubles depend on their order in the last places."""
    return F.round(column, 6).alias(name)


def rounded(x: Column, places: int) -> Column:
    """As ``round`` in the statements: halves of the scaled double go away from zero, and a zero keeps the sign of what it was."""
    scaled = x * 10.0**places
    return F.when(F.abs(scaled) == float("inf"), x).otherwise(F.signum(scaled) * F.abs(F.round(scaled)) / 10.0**places)
