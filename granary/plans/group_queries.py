"""Group-relative advantages and group filters over the line items of each order."""

from __future__ import annotations

from pyspark.sql import functions as F

from granary.operators import advantages as A
from granary.plans.catalog import ROLLOUTS, TOKENS, query, r6, rollouts, table, tokens

WITH = f"WITH {ROLLOUTS} "
KEYS = ["uid", "sample_id"]


def value(frame, column="advantage"):
    return frame.select(*KEYS, r6(F.col(column), "advantage"))


@query(WITH + "SELECT uid, sample_id, round(CASE WHEN count(*) OVER g = 1 THEN score / (1 + 1e-6) ELSE (score - avg(score) OVER g) / (stddev_samp(score) OVER g + 1e-6) END, 6) AS advantage FROM rollouts WINDOW g AS (PARTITION BY uid)")
def adv_grpo(spark, sf_dir):
    return value(A.grpo(rollouts(spark, sf_dir)))


@query(WITH + "SELECT uid, sample_id, round(CASE WHEN count(*) OVER g = 1 THEN score ELSE score - avg(score) OVER g END, 6) AS advantage FROM rollouts WINDOW g AS (PARTITION BY uid)")
def adv_drgrpo(spark, sf_dir):
    return value(A.grpo(rollouts(spark, sf_dir), by_std=False))


@query(WITH + """, many AS (SELECT * FROM rollouts WHERE uid IN (SELECT uid FROM rollouts GROUP BY uid HAVING count(*) > 1)),
    ranked AS (SELECT *, row_number() OVER o AS place, lead(score) OVER o AS next, stddev_samp(score) OVER (PARTITION BY uid) AS sd FROM many WINDOW o AS (PARTITION BY uid ORDER BY score DESC, sample_id))
    SELECT uid, sample_id, round(CASE WHEN place = 1 THEN (score - next) / (sd + 1e-6) ELSE 0 END, 6) AS advantage FROM ranked""")
def adv_passk(spark, sf_dir):
    rows = rollouts(spark, sf_dir)
    many = rows.join(rows.groupBy("uid").count().where("count > 1").select("uid"), "uid", "left_semi")
    return value(A.passk(many, "sample_id"))


@query(WITH + "SELECT uid, sample_id, round(CASE WHEN count(*) OVER g > 1 THEN (score - avg(score) OVER g) * (count(*) OVER g)::DOUBLE / (count(*) OVER g - 1) ELSE score END, 6) AS advantage FROM rollouts WINDOW g AS (PARTITION BY uid)")
def adv_rloo(spark, sf_dir):
    return value(A.rloo(rollouts(spark, sf_dir)))


@query(WITH + "SELECT uid, sample_id, round(CASE WHEN count(*) OVER g = 1 THEN score ELSE score - sum(length * score) OVER g / sum(length) OVER g END, 6) AS advantage FROM rollouts WINDOW g AS (PARTITION BY uid)")
def adv_opo(spark, sf_dir):
    return value(A.opo(rollouts(spark, sf_dir)))


@query(WITH + """, c AS (SELECT *, score - CASE WHEN count(*) OVER g = 1 THEN 0 ELSE avg(score) OVER g END AS v FROM rollouts WINDOW g AS (PARTITION BY uid)),
    s AS (SELECT sum(length * v) / (sum(length) + 1e-8) AS mu, sum(length) AS n FROM c),
    w AS (SELECT sum(length * (v - mu) * (v - mu)) / (max(n) + 1e-8) * max(n) / (max(n) - 1) AS var, max(mu) AS mu FROM c, s)
    SELECT uid, sample_id, round((v - mu) / sqrt(var + 1e-8), 6) AS advantage FROM c, w""")
def adv_rfpp_baseline(spark, sf_dir):
    return value(A.whiten(A.centred(rollouts(spark, sf_dir)), "centred", "length"))


WHITE = """s AS (SELECT sum(m * x) / (sum(m) + 1e-8) AS mu, sum(m) AS n FROM g),
    w AS (SELECT sum(m * (x - mu) * (x - mu)) / (max(n) + 1e-8) * max(n) / (max(n) - 1) AS var, max(mu) AS mu FROM g, s)"""


def exploded(rows):
    places = rows.select("vec_id", F.posexplode(F.arrays_zip("advantage", "returns")).alias("pos", "e"))
    return places.select("vec_id", "pos", r6(F.col("e.advantage"), "advantage"), r6(F.col("e.returns"), "returns"))


@query(f"""WITH {TOKENS}, e AS (SELECT vec_id, i, r[i] AS r, v[i] AS v, coalesce(v[i + 1], 0) AS w, m[i] AS m FROM tokens, range(1, 17) t(i)),
    d AS (SELECT vec_id, i, r + 0.9 * w - v AS d, v, m FROM e),
    g AS (SELECT a.vec_id, a.i, sum(b.d * pow(0.9 * 0.8, b.i - a.i)) AS x, any_value(a.v) AS v, any_value(a.m) AS m FROM d a JOIN d b ON a.vec_id = b.vec_id AND b.i >= a.i GROUP BY 1, 2), {WHITE}
    SELECT vec_id, i::INT - 1 AS pos, round((x - mu) / sqrt(var + 1e-8), 6) AS advantage, round(x + v, 6) AS returns FROM g, w""")
def adv_gae(spark, sf_dir):
    return exploded(A.gae_advantages(tokens(spark, sf_dir).select("vec_id", "r", "v", "m"), "r", "v", "m", 0.9, 0.8))


@query(f"""WITH {TOKENS}, e AS (SELECT vec_id, i, r[i] AS r, m[i] AS m FROM tokens, range(1, 17) t(i)),
    g AS (SELECT a.vec_id, a.i, any_value(a.m) AS m, any_value(a.r) + any_value(a.m) * coalesce(sum(b.r * b.m * pow(0.95, b.i - a.i)), 0) + (1 - any_value(a.m)) * coalesce(sum(b.r * b.m * pow(0.95, b.i - a.i)), 0) AS x
        FROM e a LEFT JOIN e b ON a.vec_id = b.vec_id AND b.i > a.i GROUP BY 1, 2), {WHITE}
    SELECT vec_id, i::INT - 1 AS pos, round(m * (x - mu) / sqrt(var + 1e-8) + 0.0, 6) + 0.0 AS advantage, round(x, 6) AS returns FROM g, w""")
def adv_rfpp(spark, sf_dir):
    return exploded(A.discounted_advantages(tokens(spark, sf_dir).select("vec_id", "r", "m"), "r", "m", 0.95))


@query(f"""WITH {TOKENS}, e AS (SELECT vec_id, label, i, r[i] * m[i] AS x, m[i] AS m FROM tokens, range(1, 17) t(i))
    SELECT vec_id, i::INT - 1 AS pos, round(sum(x) OVER (PARTITION BY vec_id ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) - label * m, 6) AS advantage FROM e""")
def adv_remax(spark, sf_dir):
    rows = tokens(spark, sf_dir).select("vec_id", A.remax(F.col("r"), F.col("m"), F.col("label")).alias("g"))
    return rows.select("vec_id", F.posexplode("g").alias("pos", "advantage")).select("vec_id", "pos", r6(F.col("advantage"), "advantage"))


@query(WITH + ", s AS (SELECT (ln(sum(exp(0.1 * (score - 50)))) + 5.0 - ln(count(*))) / 0.1 AS base FROM rollouts) SELECT uid, sample_id, round(score - base, 6) AS advantage FROM rollouts, s")
def adv_sppo(spark, sf_dir):
    return value(A.softmean(rollouts(spark, sf_dir), "score", 0.1))


@query(WITH + "SELECT uid, sample_id, score FROM rollouts QUALIFY stddev_pop(score) OVER (PARTITION BY uid) > 0 OR count(*) OVER (PARTITION BY uid) = 1")
def filter_variance(spark, sf_dir):
    return A.filter_variance(rollouts(spark, sf_dir)).select(*KEYS, "score")


@query(WITH + """, b AS (SELECT o_orderkey AS uid FROM orders WHERE o_orderstatus = 'P'), m AS (SELECT *, avg(score) OVER (PARTITION BY uid) AS mean FROM rollouts)
    SELECT uid, sample_id, round(mean, 6) AS group_mean, CASE WHEN uid IN (SELECT uid FROM b) OR mean >= 45 - 1e-8 THEN 'persist' WHEN mean >= 35 - 1e-8 THEN 'upper' WHEN mean <= 10 + 1e-8 THEN 'lower' END AS drop_reason FROM m""")
def filter_thresholds(spark, sf_dir):
    blocked = table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("uid"))
    return A.filter_thresholds(rollouts(spark, sf_dir), 45, 35, 10, blocked).select(*KEYS, r6(F.col("group_mean"), "group_mean"), "drop_reason")


@query(WITH + """, m AS (SELECT *, NOT (avg(score) OVER g BETWEEN 15 AND 35) OR max(length) OVER g >= 49 AS demoted FROM rollouts WINDOW g AS (PARTITION BY uid))
    SELECT uid, sample_id, score FROM m ORDER BY demoted, uid, sample_id LIMIT 2000""")
def filter_accuracy_band(spark, sf_dir):
    return A.filter_band(rollouts(spark, sf_dir), 15, 35, 50, 2000, "sample_id").select(*KEYS, "score")


@query(WITH + """, p AS (SELECT a.uid, abs(a.score - b.score) AS w, ((a.score - b.score) * (a.length - b.length) > 0)::INT AS same FROM rollouts a JOIN rollouts b ON a.uid = b.uid AND a.sample_id < b.sample_id)
    SELECT round(avg(acc), 6) AS accuracy FROM (SELECT uid, CASE WHEN sum(w) > 0 THEN sum(w * same) / sum(w) ELSE 0.5 END AS acc FROM p GROUP BY uid)""")
def dpo_accuracy(spark, sf_dir):
    rows = rollouts(spark, sf_dir)
    pairs = rows.alias("a").join(rows.alias("b"), (F.col("a.uid") == F.col("b.uid")) & (F.col("a.sample_id") < F.col("b.sample_id")))
    gap, other = F.col("a.score") - F.col("b.score"), F.col("a.length") - F.col("b.length")
    per = pairs.select(F.col("a.uid").alias("uid"), F.abs(gap).alias("w"), (gap * other > 0).cast("int").alias("same")).groupBy("uid").agg(F.sum(F.col("w") * F.col("same")).alias("s"), F.sum("w").alias("w"))
    return per.agg(r6(F.avg(F.when(F.col("w") > 0, F.col("s") / F.col("w")).otherwise(0.5)), "accuracy"))


@query(WITH + "SELECT uid // 2 AS pair, bool_or(uid % 2 = 0 AND s >= coalesce(t, s)) AS first_wins FROM (SELECT uid, sum(score) AS s, max(sum(score)) FILTER (WHERE uid % 2 = 1) OVER (PARTITION BY uid // 2) AS t FROM rollouts GROUP BY uid) GROUP BY 1")
def pref_online_dpo(spark, sf_dir):
    sums = rollouts(spark, sf_dir).groupBy("uid").agg(F.sum("score").alias("s"))
    pair = sums.groupBy(F.floor(F.col("uid") / 2).alias("pair")).agg(F.max(F.when(F.col("uid") % 2 == 0, F.col("s"))).alias("a"), F.max(F.when(F.col("uid") % 2 == 1, F.col("s"))).alias("b"))
    return pair.select("pair", F.coalesce(F.col("a") >= F.coalesce("b", "a"), F.lit(False)).alias("first_wins"))
