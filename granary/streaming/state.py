"""Stateful iteration as Structured Streaming: a persistent blocklist and batch accumulation."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from granary.operators.advantages import filter_thresholds


def read_stream(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.readStream.schema(schema).parquet(path)


def blocklist_step(blocklist: str, out: str, persist: float, upper: float, lower: float) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function: keep groups that train, and append newly persistent keys to the blocklist.

    Both tables get a folder for each batch, overwritten if the batch runs again.
    """

    def step(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        keys = f"uid {dict(batch.dtypes)['uid']}, batch int"
        known = spark.read.schema(keys).option("basePath", blocklist).parquet(blocklist).where(F.col("batch") != number).select("uid") if _exists(spark, blocklist) else spark.createDataFrame([], keys.split(",")[0])
        marked = filter_thresholds(batch, persist, upper, lower, known).cache()
        marked.where("drop_reason is null").drop("group_mean", "drop_reason").write.mode("overwrite").parquet(f"{out}/batch={number}")
        new = marked.where("drop_reason = 'persist'").select("uid").distinct().join(known, "uid", "left_anti")
        new.write.mode("overwrite").parquet(f"{blocklist}/batch={number}")
        marked.unpersist()

    return step


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def accumulate(batches: DataFrame, prompts: str, size: int, order: str, most: int = 0) -> DataFrame:
    """Add ``running`` and ``full``: the first arrival with which the running number of prompts reaches ``size``.

    It is an error if ``most`` batches (0: any number) have come and it hasn't.
    """
    run = Window.orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    running = F.sum(prompts).over(run)
    if most:
        running = F.when((F.count(F.lit(1)).over(run) >= most) & (running < size), F.raise_error(F.lit(f"{most} batches hold too few prompts")).cast("long")).otherwise(running)
    counted = batches.withColumn("running", running)
    return counted.withColumn("full", (F.col("running") >= size) & (F.col("running") - F.col(prompts) < size))
