"""Evaluation metrics, votes, balance and retrieval."""

from __future__ import annotations


from pyspark.sql import functions as F

from granary.operators import balance, evaluation, retrieval, selection
from granary.plans.catalog import ROLLOUTS, VOTES, query, r6, rollouts, table, votes

WITH = f"WITH {VOTES} "


@query(WITH + "SELECT prompt, day, pred, votes, round(value, 6) AS value FROM (SELECT prompt, day, pred, count(*) AS votes, min(pos) AS first, arg_min(value, pos) AS value FROM votes GROUP BY 1, 2, 3) QUALIFY row_number() OVER (PARTITION BY prompt, day ORDER BY votes DESC, first) = 1")
def majority_vote(spark, sf_dir):
    return evaluation.majority(votes(spark, sf_dir), ["prompt", "day"], "pred", "value", "pos").select("prompt", "day", "pred", "votes", r6(F.col("value"), "value"))


@query(WITH + "SELECT source, round(avg(m), 6) AS mean_n, round(avg(s), 6) AS std_n, max(n) AS n_max FROM (SELECT source, prompt, avg(value) AS m, stddev_pop(value) AS s, count(*) AS n FROM votes GROUP BY 1, 2) GROUP BY 1")
def val_mean_std(spark, sf_dir):
    found = evaluation.mean_std(votes(spark, sf_dir), "source", "prompt", "value")
    return found.select("source", r6(F.col("mean_n"), "mean_n"), r6(F.col("std_n"), "std_n"), "n_max")


@query()
def val_bootstrap(spark, sf_dir):
    """best, worst and majority at n; the resampled positions are NumPy's, so tests hold it against NumPy."""
    small = votes(spark, sf_dir).withColumn("prompt", F.concat_ws("/", "prompt", "day"))
    return evaluation.bootstrap(small.withColumn("source", F.lit("events")), "source", "prompt", "value", "pos", "pred")


@query("SELECT event_type AS data_source, round(avg(value), 6) AS score, count(*) AS n FROM events GROUP BY 1")
def score_by_source(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("data_source")).agg(r6(F.avg("value"), "score"), F.count("*").alias("n"))


STAGES = ("gen", "ref", "values", "adv", "testing")


@query("""WITH t AS (SELECT CASE o_orderkey % 5 WHEN 0 THEN 'gen' WHEN 1 THEN 'ref' WHEN 2 THEN 'values' WHEN 3 THEN 'adv' ELSE 'testing' END AS stage, sum(o_totalprice) AS seconds FROM orders GROUP BY 1),
    n AS (SELECT sum(l_quantity) AS tokens, sum(l_linenumber) AS responses FROM lineitem)
    SELECT stage, round(seconds, 6) AS seconds, round(seconds * 1000 / CASE WHEN stage = 'gen' THEN responses WHEN stage <> 'testing' THEN tokens END, 6) AS ms_per_token, round(tokens / (seconds * 8), 6) AS throughput FROM t, n""")
def timing_metrics(spark, sf_dir):
    stage = F.element_at(F.array(*map(F.lit, STAGES)), (F.col("o_orderkey") % 5 + 1).cast("int"))
    stages = table(spark, sf_dir, "orders").groupBy(stage.alias("stage")).agg(F.sum("o_totalprice").alias("seconds"))
    n = table(spark, sf_dir, "lineitem").agg(F.sum("l_quantity"), F.sum("l_linenumber")).first()
    found = evaluation.timing_metrics(stages, "stage", "seconds", n[0], n[1])
    return found.select("stage", r6(F.col("seconds"), "seconds"), r6(F.col("ms_per_token"), "ms_per_token"), r6(n[0] / (F.col("seconds") * 8), "throughput"))


@query("SELECT name, round(CASE WHEN contains(name, 'max') THEN max(value) WHEN contains(name, 'min') THEN min(value) ELSE avg(value) END, 6) AS value FROM (SELECT event_type || CASE event_id % 3 WHEN 0 THEN '/max' WHEN 1 THEN '/min' ELSE '/mean' END AS name, value FROM events) GROUP BY name")
def reduce_metrics(spark, sf_dir):
    kind = F.element_at(F.array(F.lit("/max"), F.lit("/min"), F.lit("/mean")), (F.col("event_id") % 3 + 1).cast("int"))
    rows = table(spark, sf_dir, "events").select(F.concat("event_type", kind).alias("name"), "value")
    return evaluation.reduced(rows).select("name", r6(F.col("value"), "value"))


@query("""WITH m AS (SELECT DISTINCT event_type AS source, CASE event_id % 2 WHEN 0 THEN CASE WHEN event_type < 'l' THEN 'acc' ELSE 'reward' END ELSE 'len' END AS var,
        CASE event_id % 3 WHEN 0 THEN 'mean' WHEN 1 THEN 'best' ELSE 'std' END || '@' || (2 + user_id % 7) || CASE WHEN event_id % 3 = 1 THEN '/mean' ELSE '' END AS metric FROM events),
    n AS (SELECT *, max(CAST(split_part(split_part(metric, '@', 2), '/', 1) AS INT)) OVER (PARTITION BY source, var) AS most, max((var = 'acc')::INT) OVER (PARTITION BY source) AS acc FROM m)
    SELECT CASE WHEN var = (CASE acc WHEN 1 THEN 'acc' ELSE 'reward' END) AND regexp_matches(metric, '^(mean|maj|best)') AND contains(metric, '@' || most) THEN 'val-core/' ELSE 'val-aux/' END || source || '/' || var || '/' || metric AS name FROM n""")
def metric_naming(spark, sf_dir):
    kind = F.when(F.col("event_id") % 3 == 0, "mean").when(F.col("event_id") % 3 == 1, "best").otherwise("std")
    metric = F.concat(kind, F.lit("@"), (2 + F.col("user_id") % 7).cast("string"), F.when(F.col("event_id") % 3 == 1, "/mean").otherwise(""))
    core = F.when(F.col("event_type") < "l", "acc").otherwise("reward")
    rows = table(spark, sf_dir, "events").select(F.col("event_type").alias("source"), F.when(F.col("event_id") % 2 == 0, core).otherwise("len").alias("var"), metric.alias("metric")).distinct()
    return evaluation.metric_names(rows, "source", "var", "metric").select("name")


@query(f"WITH {ROLLOUTS}, c AS (SELECT uid // 50 AS part, sum(length) AS total FROM rollouts GROUP BY 1) SELECT min(total)::BIGINT AS least, max(total)::BIGINT AS most, (max(total) - min(total))::BIGINT AS gap, round(avg(total), 6) AS mean FROM c")
def seqlen_stats(spark, sf_dir):
    sums = rollouts(spark, sf_dir).groupBy(F.floor(F.col("uid") / 50)).agg(F.sum("length").alias("total"))
    return sums.agg(F.min("total").alias("least"), F.max("total").alias("most"), (F.max("total") - F.min("total")).alias("gap"), r6(F.avg("total"), "mean"))


def _lengths(spark, sf_dir):
    return rollouts(spark, sf_dir).withColumn("batch", F.floor(F.col("uid") / 100)).withColumn("item", F.col("uid") * 100 + F.col("sample_id"))


@query()
def kk_partition(spark, sf_dir):
    return balance.by_group(_lengths(spark, sf_dir), "batch", "item", "length", lambda x: balance.differencing(x, 8))


@query()
def kk_equal_size(spark, sf_dir):
    return balance.by_group(_lengths(spark, sf_dir), "batch", "item", "length", lambda x: balance.differencing_even(x, 4))


@query()
def greedy_partition(spark, sf_dir):
    return balance.by_group(_lengths(spark, sf_dir), "batch", "item", "length", lambda x: balance.least_loaded(x, 8))


@query()
def micro_batches(spark, sf_dir):
    return balance.by_group(_lengths(spark, sf_dir), "batch", "item", "length", lambda x: balance.micro_batches(x, 300))


@query("SELECT q.vec_id AS query_id, c.vec_id, round(list_inner_product(q.embedding::DOUBLE[], c.embedding::DOUBLE[]), 6) AS score, row_number() OVER (PARTITION BY q.vec_id ORDER BY list_inner_product(q.embedding::DOUBLE[], c.embedding::DOUBLE[]) DESC, c.vec_id)::INT AS rank FROM embeddings q JOIN embeddings c ON q.vec_id % 50 = 0 QUALIFY rank <= 3")
def dense_topk(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings")
    found = retrieval.dense_topk(rows.where("vec_id % 50 = 0"), rows, 3, "vec_id", "vec_id", "embedding")
    return found.select("query_id", "vec_id", r6(F.col("score"), "score"), "rank")


@query("SELECT label, [" + ", ".join(f"round(avg(embedding[{i}]::DOUBLE), 6)" for i in range(1, 65)) + "] AS pooled FROM embeddings GROUP BY label")
def embedding_mean_pool(spark, sf_dir):
    pooled = retrieval.mean_pool(table(spark, sf_dir, "embeddings"), "label", "embedding", 64)
    return pooled.select("label", F.transform("embedding", lambda x: F.round(x, 6)).alias("pooled"))


@query("""WITH d AS (SELECT doc_id, unnest(regexp_split_to_array(lower(text), '\\s+')) AS term FROM documents), t AS (SELECT doc_id, term, count(*) AS tf FROM d WHERE term <> '' GROUP BY 1, 2),
    l AS (SELECT doc_id, sum(tf) AS dl FROM t GROUP BY 1), s AS (SELECT avg(dl) AS avgdl, count(*) AS docs FROM l), f AS (SELECT term, count(*) AS df FROM t GROUP BY 1),
    q AS (SELECT DISTINCT item_id, unnest(regexp_split_to_array(lower(text), '\\s+')) AS term FROM benchmark),
    x AS (SELECT item_id AS query_id, doc_id, round(sum(ln(1 + (docs - df + 0.5) / (df + 0.5)) * tf * 1.9 / (tf + 0.9 * (0.6 + 0.4 * dl / avgdl))), 9) AS score FROM q JOIN f USING (term) JOIN t USING (term) JOIN l USING (doc_id), s GROUP BY 1, 2)
    SELECT query_id, doc_id, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id)::INT AS rank FROM x QUALIFY rank <= 3""")
def bm25_topk(spark, sf_dir):
    found = retrieval.bm25_topk(table(spark, sf_dir, "benchmark"), table(spark, sf_dir, "documents"), 3, "item_id", "doc_id", "text")
    return found.select("query_id", "doc_id", r6(F.col("score"), "score"), "rank")


@query("SELECT event_type AS step, 'step:' || event_type || ' - max:' || printf('%.3f', max(value)) || ' - n:' || printf('%.3f', count(*)::DOUBLE) AS line FROM events GROUP BY event_type")
def console_line(spark, sf_dir):
    from granary.sources.files import console_line as lines

    found = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("step")).agg(F.max("value").alias("max"), F.count("*").cast("double").alias("n"))
    return lines(found.unpivot("step", ["max", "n"], "metric", "value"))


@query("SELECT user_id, event_id, CASE WHEN value > coalesce(lag(value) OVER (PARTITION BY user_id ORDER BY event_id), 0) THEN 0.0::DOUBLE ELSE -0.05::DOUBLE END AS reward FROM events")
def tool_step_reward(spark, sf_dir):
    return evaluation.step_rewards(table(spark, sf_dir, "events"), "user_id", "event_id", "value").select("user_id", "event_id", "reward")


@query("SELECT event_id, ts, user_id, event_type, (props::JSON) IS NOT NULL AS has_props FROM events WHERE strftime(ts, '%Y-%m-%d') >= '2024-01-05' AND strftime(ts, '%Y-%m-%d') < '2024-01-20'")
def date_range(spark, sf_dir):
    return selection.date_range(table(spark, sf_dir, "events"), "ts", "2024-01-05", "2024-01-20").select("event_id", "ts", "user_id", "event_type", F.col("props").isNotNull().alias("has_props"))


@query("WITH b AS (SELECT strftime(ts, '%d') AS day, count(DISTINCT user_id) AS prompts FROM events GROUP BY 1), r AS (SELECT *, sum(prompts) OVER (ORDER BY day) AS running FROM b) SELECT day, prompts, running::BIGINT AS running, running >= 500 AND running - prompts < 500 AS \"full\" FROM r")
def accumulate_batches(spark, sf_dir):
    from granary.streaming.state import accumulate

    days = table(spark, sf_dir, "events").groupBy(F.date_format("ts", "dd").alias("day")).agg(F.countDistinct("user_id").alias("prompts"))
    return accumulate(days, "prompts", 500, "day")


