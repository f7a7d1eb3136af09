"""Sources and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.operators.batch import with_row_id


def parquet_in_order(spark: SparkSession, *paths: str) -> DataFrame:
    """Files read one after another, with a dense ``row_id`` over them in the order given."""
    parts = [spark.read.parquet(p).withColumns({"_file": F.lit(i), "_name": F.col("_metadata.file_path"), "_block": F.col("_metadata.file_block_start"), "_at": F.monotonically_increasing_id()}) for i, p in enumerate(paths)]
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return with_row_id(whole, "_file", "_name", "_block", "_at").drop("_file", "_name", "_block", "_at")


def percent_slice(batch: DataFrame, first: int | None = None, last: int | None = None) -> DataFrame:
    """Rows of a batch from one percentage to another; negative ones count from the end."""
    n = batch.count()
    at = lambda p, other: other if p is None else int(n * (p if p >= 0 else 100 + p) / 100)
    low, high = at(first, 0), at(last, n)
    return batch.where((F.col("row_id") >= low) & (F.col("row_id") < high))


def jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def write_steps(df: DataFrame, path: str, step: str = "step") -> None:
    """JSON lines, a folder for each step."""
    df.write.mode("append").partitionBy(step).json(path)


def write_metrics(metrics: DataFrame, path: str) -> None:
    """Append a long table (step, metric, value)."""
    metrics.write.mode("append").parquet(path)


def console_line(metrics: DataFrame, step: str = "step") -> DataFrame:
    """'step:N - name:value' for each step, names in order."""
    parts = F.array_sort(F.collect_list(F.struct("metric", F.format_string("%.3f", "value").alias("text"))))
    rows = metrics.groupBy(step).agg(parts.alias("_p"))
    return rows.select(step, F.concat_ws(" - ", F.concat(F.lit("step:"), step), F.concat_ws(" - ", F.transform("_p", lambda x: F.concat_ws(":", x["metric"], x["text"])))).alias("line"))


def flattened(df: DataFrame, separator: str = "/") -> DataFrame:
    """Nested structs as columns named by their path."""

    def walk(schema, prefix, path):
        for field in schema.fields:
            name, at = f"{prefix}{field.name}", f"{path}`{field.name}`"
            if field.dataType.typeName() == "struct":
                yield from walk(field.dataType, name + separator, at + ".")
            else:
                yield F.col(at).alias(name)

    return df.select(*walk(df.schema, "", ""))
