"""The batch algebra over the customer table."""

from __future__ import annotations

from pyspark.sql import functions as F

from granary.operators import batch as B
from granary.plans.catalog import CUSTOMERS, customers, query
from granary.session import table

WITH = f"WITH {CUSTOMERS} "


@query(WITH + "SELECT row_id, obs FROM batch")
def batch_select(spark, sf_dir):
    return B.select(customers(spark, sf_dir), "obs")


@query(WITH + "SELECT row_id, label, times FROM batch")
def batch_pop(spark, sf_dir):
    return B.pop(customers(spark, sf_dir), "obs")[1]


@query(WITH + "SELECT row_id, obs AS observation, label, times FROM batch")
def batch_rename(spark, sf_dir):
    return B.rename(customers(spark, sf_dir), ["obs"], ["observation"])


@query(WITH + "SELECT (row_id - (SELECT count(*) - 100 FROM batch)) // 3 AS row_id, obs, label, times FROM batch WHERE row_id >= (SELECT count(*) - 100 FROM batch) AND row_id < (SELECT count(*) - 5 FROM batch) AND (row_id - (SELECT count(*) - 100 FROM batch)) % 3 = 0")
def batch_slice(spark, sf_dir):
    return B.take_slice(customers(spark, sf_dir), -100, -5, 3)


@query(WITH + "SELECT o_orderkey AS row_id, obs, label, times FROM orders JOIN batch ON row_id = o_custkey")
def batch_gather(spark, sf_dir):
    index = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("pos"), F.col("o_custkey").alias("idx"))
    return B.gather(customers(spark, sf_dir), index)


@query(WITH + "SELECT * FROM batch WHERE obs > 0")
def batch_mask(spark, sf_dir):
    return customers(spark, sf_dir).where("obs > 0")


@query(WITH + "SELECT row_id, obs, label, times, obs * 2 AS twice FROM batch")
def batch_union(spark, sf_dir):
    rows = customers(spark, sf_dir)
    return B.union(rows, rows.select("row_id", "label", (F.col("obs") * 2).alias("twice")))


@query(WITH + "SELECT * FROM batch UNION ALL SELECT row_id + (SELECT count(*) FROM batch), obs, label, times FROM batch")
def batch_concat(spark, sf_dir):
    return B.concat([customers(spark, sf_dir)] * 2)


@query(WITH + "SELECT *, (row_id // ((SELECT count(*) + 6 FROM batch) // 7))::INT AS chunk_id FROM batch")
def batch_chunk(spark, sf_dir):
    return B.chunk(customers(spark, sf_dir), 7)


@query(WITH + "SELECT row_id * 3 + s AS row_id, obs, label, times, s::INT AS sample_id FROM batch, range(3) t(s)")
def batch_repeat_interleave(spark, sf_dir):
    return B.repeat(customers(spark, sf_dir), 3)


@query(WITH + "SELECT s * (SELECT count(*) FROM batch) + row_id AS row_id, obs, label, times, s::INT AS sample_id FROM batch, range(3) t(s)")
def batch_repeat_tile(spark, sf_dir):
    return B.repeat(customers(spark, sf_dir), 3, interleave=False)


@query(WITH + "SELECT row_id, obs, label, times, s::INT AS sample_id FROM batch, range(30) t(s) WHERE s < times")
def batch_sample_repeat(spark, sf_dir):
    return B.sample_repeat(customers(spark, sf_dir), "times")


@query("SELECT vec_id * 4 + s AS row_id, round(list_sum(list_transform(embedding[s * 16 + 1:s * 16 + 16], lambda x: x::DOUBLE)), 6) AS total, s::INT AS split_id FROM embeddings, range(4) t(s)")
def batch_unfold_columns(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("row_id"), F.col("embedding").cast("array<double>").alias("e"))
    return B.unfold(rows, 4, ["e"]).select("row_id", F.round(F.aggregate("e", F.lit(0.0), lambda a, x: a + x), 6).alias("total"), "split_id")


@query(WITH + "SELECT row_id // 5 AS fold_id, list(label ORDER BY row_id) AS label FROM batch GROUP BY 1")
def batch_fold(spark, sf_dir):
    return B.fold(customers(spark, sf_dir), 5, "label")


@query(WITH + "SELECT (SELECT count(*) - 1 FROM batch) - row_id AS row_id, obs, label, times FROM batch")
def batch_reorder(spark, sf_dir):
    rows = customers(spark, sf_dir)
    n = rows.count()
    return B.reorder(rows, rows.select(F.col("row_id").alias("pos"), (F.lit(n - 1) - F.col("row_id")).alias("idx")))


@query("SELECT c_custkey AS idx, (SELECT count(*) - 1 FROM customer) - c_custkey AS pos FROM customer")
def batch_inverse(spark, sf_dir):
    rows = customers(spark, sf_dir)
    n = rows.count()
    return B.inverse(rows.select((F.lit(n - 1) - F.col("row_id")).alias("idx"), F.col("row_id").alias("pos")))


@query(WITH + "SELECT *, false AS is_pad FROM batch UNION ALL SELECT (SELECT count(*) FROM batch) + row_id, obs, label, times, true FROM batch WHERE row_id < (64 - (SELECT count(*) FROM batch) % 64) % 64")
def batch_pad_divisor(spark, sf_dir):
    return B.pad_to_divisor(customers(spark, sf_dir), 64)


@query(WITH + "SELECT * FROM batch UNION ALL SELECT row_id + 1 + s, obs, label, times FROM batch, range(5) t(s) WHERE row_id = (SELECT count(*) - 1 FROM batch)")
def batch_padding_last(spark, sf_dir):
    return B.pad_with(customers(spark, sf_dir), 5)


@query(WITH + "SELECT *, e::INT AS epoch, (row_id // 10)::INT AS batch_id FROM batch, range(2) t(e)".replace("SELECT *,", "SELECT row_id, obs, label, times,"))
def batch_minibatches(spark, sf_dir):
    return B.minibatches(customers(spark, sf_dir), 10, 2)


@query("SELECT o_orderkey, 0 AS side, o_orderstatus AS text, true AS chosen FROM orders UNION ALL SELECT o_orderkey, 1, o_orderpriority, false FROM orders")
def pairs_unpivot(spark, sf_dir):
    return B.pairs_unpivot(table(spark, sf_dir, "orders"), "o_orderkey", "o_orderstatus", "o_orderpriority")


@query("SELECT row_number() OVER (ORDER BY ts, event_id) - 1 AS row_id, event_id FROM events")
def batch_row_ids(spark, sf_dir):
    return B.with_row_id(table(spark, sf_dir, "events").select("ts", "event_id"), "ts", "event_id").select("row_id", "event_id")
