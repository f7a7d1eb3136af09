"""Masks, penalties, losses and sequence layout over arrays of 16 tokens."""

from __future__ import annotations

from pyspark.sql import functions as F

from granary.functions import tokens as T
from granary.operators import retrieval
from granary.plans.catalog import TOKENS, query, r6, table, tokens

WITH = f"WITH {TOKENS} "
C = F.col


def rows_of(column):
    """A query function of one rounded number for each row."""

    def run(spark, sf_dir):
        return tokens(spark, sf_dir).select("vec_id", r6(column(), "value"))

    return run


def add(name, column, form):
    run = rows_of(column)
    run.__name__ = name
    query(WITH + f"SELECT vec_id, round({form}, 6) AS value FROM tokens")(run)


def summed(form: str) -> str:
    return f"list_sum(list_transform(range(1, 17), lambda i: {form}))"


add("masked_mean", lambda: T.masked_mean(C("r"), C("m")), summed("r[i] * m[i]") + " / (label + 1e-8)")
add("kl_k1", lambda: T.masked_sum(T.kl("k1", C("r"), C("v")), C("m")), summed("(r[i] - v[i]) * m[i]"))
add("kl_abs", lambda: T.masked_sum(T.kl("abs", C("r"), C("v")), C("m")), summed("abs(r[i] - v[i]) * m[i]"))
add("kl_k2", lambda: T.masked_sum(T.kl("k2", C("r"), C("v")), C("m")), summed("0.5 * (r[i] - v[i]) * (r[i] - v[i]) * m[i]"))
add("kl_k3", lambda: T.masked_sum(T.kl("k3", C("r"), C("v")), C("m")), summed("greatest(-10, least(10, exp(v[i] - r[i]) - (v[i] - r[i]) - 1)) * m[i]"))
add("kl_shaped_reward", lambda: T.total(T.shaped_reward(C("o"), T.kl("k1", C("r"), C("v")), C("m"), 0.1)), summed("o[i] - 0.1 * (r[i] - v[i]) * m[i]"))
add(
    "policy_loss_dual_clip",
    lambda: T.masked_sum(T.policy_loss(C("r"), C("v"), C("a"), 0.2, 0.28, 3.0), C("m")),
    summed("m[i] * CASE WHEN a[i] < 0 THEN least(greatest(-a[i] * exp(v[i] - r[i]), -a[i] * greatest(0.8, least(1.28, exp(v[i] - r[i])))), -a[i] * 3.0) ELSE greatest(-a[i] * exp(v[i] - r[i]), -a[i] * greatest(0.8, least(1.28, exp(v[i] - r[i])))) END"),
)
add(
    "value_loss_clipped",
    lambda: T.masked_sum(T.value_loss(C("r"), C("v"), C("o"), 0.05), C("m")),
    summed("m[i] * greatest((r[i] - o[i]) * (r[i] - o[i]), (greatest(v[i] - 0.05, least(v[i] + 0.05, r[i])) - o[i]) * (greatest(v[i] - 0.05, least(v[i] + 0.05, r[i])) - o[i]))"),
)
LSE = "ln(" + summed("exp(r[i])") + ")"
add("entropy_logits", lambda: T.entropy(C("r")), f"{LSE} - " + summed("exp(r[i]) * r[i]") + " / " + summed("exp(r[i])"))
add("logprob_logits", lambda: T.logprob(C("r"), C("label")), f"r[label + 1] - {LSE}")
add(
    "topk_entropy",
    lambda: T.topk_entropy(F.transform(F.slice("r", 1, 5), lambda x: x - 3)),
    "-list_sum(list_transform(r[1:5], lambda x: exp(x - 3) * ln(exp(x - 3) + 1e-12))) - greatest(0, 1 - list_sum(list_transform(r[1:5], lambda x: exp(x - 3)))) * ln(greatest(0, 1 - list_sum(list_transform(r[1:5], lambda x: exp(x - 3)))) + 1e-12)",
)
ROW = "-list_sum(list_transform({x}, lambda x: exp(x - 3) * ln(exp(x - 3) + 1e-12))) - greatest(0, 1 - list_sum(list_transform({x}, lambda x: exp(x - 3)))) * ln(greatest(0, 1 - list_sum(list_transform({x}, lambda x: exp(x - 3)))) + 1e-12)"
add(
    "step_entropy",
    lambda: T.mean_step_entropy(F.transform(F.array(F.slice("r", 1, 4), F.array().cast("array<double>"), F.slice("v", 1, 8)), lambda s: F.transform(s, lambda x: x - 3))),
    f"(({ROW.format(x='r[1:4]')}) + ({ROW.format(x='v[1:8]')})) / 2",
)
add("overlong_penalty", lambda: T.overlong_penalty(C("label").cast("double"), 8, 4, 0.5), "least(-(label::DOUBLE - 4) / 4.0 * 0.5, 0.0) + 0.0::DOUBLE")
add("l2_norm_check", lambda: retrieval.dot(retrieval.normalise(C("r")), retrieval.normalise(C("v"))), f"{summed('r[i] * v[i]')} / sqrt({summed('r[i] * r[i]')}) / sqrt({summed('v[i] * v[i]')})")

EXPLODED = f"WITH {TOKENS}, e AS (SELECT vec_id, label, i, r[i] AS r, v[i] AS v, m[i] AS m FROM tokens, range(1, 17) t(i)) "


def aggregated(name, column, sql):
    def run(spark, sf_dir):
        return tokens(spark, sf_dir).agg(r6(column(), "value"))

    run.__name__ = name
    query(EXPLODED + sql)(run)




aggregated("loss_agg_token_mean", lambda: T.aggregated_loss(C("r"), C("m"), "token-mean"), "SELECT round(sum(r * m) / sum(m), 6) AS value FROM e")
aggregated("loss_agg_seq_sum", lambda: T.aggregated_loss(C("r"), C("m"), "seq-mean-token-sum"), "SELECT round(avg(s), 6) AS value FROM (SELECT sum(r * m) AS s FROM e GROUP BY vec_id)")
aggregated("loss_agg_seq_mean", lambda: F.avg(T.masked_mean(C("r"), C("m"))), "SELECT round(avg(s), 6) AS value FROM (SELECT sum(r * m) / (sum(m) + 1e-8) AS s FROM e GROUP BY vec_id)")
aggregated("loss_agg_seq_sum_norm", lambda: T.aggregated_loss(C("r"), C("m"), "seq-mean-token-sum-norm"), "SELECT round(sum(r * m) / 16, 6) AS value FROM e")


@query(EXPLODED + "SELECT round(max(d), 6) AS most, round(avg(d), 6) AS mean, round(stddev_samp(d), 6) AS sd FROM (SELECT abs(exp(r) - exp(v)) AS d FROM e WHERE m = 1)")
def prob_diff_stats(spark, sf_dir):
    both = tokens(spark, sf_dir).select(F.explode(F.arrays_zip("r", "v", "m")).alias("e")).where("e.m = 1")
    gap = F.abs(F.exp("e.r") - F.exp("e.v"))
    return both.agg(r6(F.max(gap), "most"), r6(F.avg(gap), "mean"), r6(F.stddev_samp(gap), "sd"))


@query(EXPLODED + """, s AS (SELECT sum(r * m) / (sum(m) + 1e-8) AS mu, sum(m) AS n FROM e), w AS (SELECT sum(m * (r - mu) * (r - mu)) / (max(n) + 1e-8) * max(n) / (max(n) - 1) AS var, max(mu) AS mu FROM e, s)
    SELECT vec_id, i::INT - 1 AS pos, round((r - mu) / sqrt(var + 1e-8), 6) AS value FROM e, w""")
def masked_whiten(spark, sf_dir):
    from granary.operators.advantages import whiten

    places = tokens(spark, sf_dir).select("vec_id", F.posexplode(F.arrays_zip("r", "m")).alias("pos", "e")).select("vec_id", "pos", "e.r", "e.m")
    return whiten(places, "r", "m").select("vec_id", "pos", r6(C("advantage"), "value"))


ALL = f"WITH {TOKENS}, e AS (SELECT vec_id, label, i, r[i] AS r, v[i] AS v, o[i] AS o, a[i] AS a, m[i] AS m FROM tokens, range(1, 17) t(i)) "


def spread_sql(value: str, name: str) -> str:
    return f"round(avg({value}), 6) AS {name}_mean, round(max({value}), 6) AS {name}_max, round(min({value}), 6) AS {name}_min"


@query(ALL + f"""SELECT * FROM (SELECT {spread_sql("s", "score")}, {spread_sql("w", "reward")}, {spread_sql("n", "response_length")}, round(avg((n = 16)::INT), 6) AS response_length_clipped, {spread_sql("16 - n", "prompt_length")}, round(avg((n = 0)::INT), 6) AS prompt_length_clipped
        FROM (SELECT sum(r) AS s, sum(o) AS w, sum(m) AS n FROM e GROUP BY vec_id)),
    (SELECT {spread_sql("a", "advantage")}, {spread_sql("v", "return")}, {spread_sql("o", "value")}, round(1 - var_samp(v - o) / (var_samp(v) + 1e-5), 6) AS explained_variance FROM e WHERE m = 1)""")
def data_metrics(spark, sf_dir):
    from granary.operators import evaluation

    rows = tokens(spark, sf_dir).withColumn("p", F.transform("m", lambda x: 1 - x))
    found = evaluation.data_metrics(rows, "r", "o", "a", "v", "m", "p", "o")
    return found.select(*[r6(C(c), c) for c in found.columns])


PLAIN, CLIPPED = "-a * exp(v - r)", "-a * greatest(0.95, least(1.08, exp(v - r)))"


@query(ALL + f""", l AS (SELECT *, {PLAIN} AS p, {CLIPPED} AS c FROM e)
    SELECT round(sum(m * CASE WHEN a < 0 THEN least(greatest(p, c), -a * 1.1) ELSE greatest(p, c) END) / sum(m), 6) AS loss, round(sum(m * (c > p)::INT) / (sum(m) + 1e-8), 6) AS clip_fraction,
        round(sum(m * (greatest(p, c) > -a * 1.1 AND a < 0)::INT) / (sum(m) + 1e-8), 6) AS lower_fraction, round(sum(m * (r - v)) / (sum(m) + 1e-8), 6) AS approximate_kl FROM l""")
def policy_metrics(spark, sf_dir):
    sums = tokens(spark, sf_dir).select(T.policy_sums(C("r"), C("v"), C("a"), C("m"), 0.05, 0.08, 1.1).alias("x"))
    found = sums.agg(*T.policy_metrics(C("x")))
    return found.select(*[r6(C(c), c) for c in found.columns])


@query(ALL + """, l AS (SELECT m, (r - o) * (r - o) AS p, (greatest(v - 0.05, least(v + 0.05, r)) - o) * (greatest(v - 0.05, least(v + 0.05, r)) - o) AS c FROM e)
    SELECT round(sum(m * greatest(p, c)) / sum(m), 6) AS loss, round(sum(m * (c > p)::INT) / (sum(m) + 1e-8), 6) AS clip_fraction FROM l""")
def value_metrics(spark, sf_dir):
    sums = tokens(spark, sf_dir).select(T.value_sums(C("r"), C("v"), C("o"), C("m"), 0.05).alias("x"))
    found = sums.agg(*T.value_metrics(C("x")))
    return found.select(*[r6(C(c), c) for c in found.columns])


@query(EXPLODED + "SELECT round(avg(k), 6) AS kl FROM (SELECT sum((r - v) * m) / (sum(m) + 1e-8) AS k FROM e GROUP BY vec_id)")
def kl_metric(spark, sf_dir):
    """The mean over rows of a row's masked mean divergence, as it is reported beside the shaped reward."""
    return tokens(spark, sf_dir).agg(r6(F.avg(T.masked_mean(T.kl("k1", C("r"), C("v")), C("m"))), "kl"))


@query(f"WITH {TOKENS} " + """SELECT vec_id, round(CASE WHEN label % 4 = 0 THEN list_avg(r[1:3]) WHEN label % 4 = 1 THEN (v[1] + greatest(v[2], o[2])) / 2 WHEN label % 4 = 2 THEN list_avg(a[1:2]) ELSE 'nan'::DOUBLE END, 6) AS mean FROM tokens""")
def chosen_logps(spark, sf_dir):
    """Logged directly, from the candidates of each step, from scores, or missing."""
    k = C("label") % 4
    step = lambda i, name: F.create_map(F.lit(name), F.element_at("v", i), F.lit("other"), F.element_at("o", i))
    logps = F.when(k == 0, F.concat(F.slice("r", 1, 3), F.array(F.lit(None).cast("double"))))
    steps = F.when(k == 1, F.array(step(1, "x"), step(2, "y")))
    found = T.chosen_logps(logps, steps, F.array(F.lit("x"), F.lit("z")), F.when(k == 2, F.slice("a", 1, 2)))
    return tokens(spark, sf_dir).select("vec_id", r6(T.mean_logp(found), "mean"))


def ids(spark, sf_dir):
    """Token ids: the signs and sizes of the first numbers as small integers."""
    return tokens(spark, sf_dir).select("vec_id", "label", F.transform("r", lambda x: F.pmod(F.floor(x * 100), F.lit(7)).cast("int")).alias("ids"))


IDS = f"WITH {TOKENS}, ids AS (SELECT vec_id, label, list_transform(r, lambda x: (((floor(x * 100)::BIGINT % 7) + 7) % 7)::INT) AS ids FROM tokens) "


@query(IDS + "SELECT vec_id, list_transform(range(1, 17), lambda i: (coalesce(list_position(ids, 3), 99) >= i)::INT) AS mask FROM ids")
def resp_mask_eos(spark, sf_dir):
    return ids(spark, sf_dir).select("vec_id", T.mask_to_eos(C("ids"), F.lit(3)).alias("mask"))


@query(IDS + "SELECT vec_id, list_transform(range(1, 17), lambda i: greatest(len(list_filter(ids[1:i], lambda x: x > 2)) - 1, 0)::INT) AS positions FROM ids")
def position_ids(spark, sf_dir):
    return ids(spark, sf_dir).select("vec_id", T.position_ids(F.transform("ids", lambda x: (x > 2).cast("int"))).alias("positions"))


@query(IDS + "SELECT vec_id, list_concat(list_transform(range(0, 20 - label), lambda i: 0::INT), ids[1:label]) AS padded FROM ids")
def pad_left(spark, sf_dir):
    return ids(spark, sf_dir).select("vec_id", T.pad_left(F.slice("ids", F.lit(1), C("label")), 20, F.lit(0)).alias("padded"))


@query(IDS + "SELECT vec_id, ids[12:16] AS from_left, ids[1:5] AS from_right, list_concat(ids[1:2], ids[14:16]) AS from_middle FROM ids")
def truncate(spark, sf_dir):
    return ids(spark, sf_dir).select("vec_id", *[T.truncate(C("ids"), 5, side).alias(f"from_{side}") for side in ("left", "right", "middle")])


@query(IDS + "SELECT vec_id, list_transform(range(0, 16), lambda i: CASE WHEN label > 1 AND i < label - 1 THEN 0 WHEN i = 15 THEN 0 ELSE 1 END) AS mask FROM ids")
def sft_loss_mask(spark, sf_dir):
    attention = F.transform("ids", lambda x: F.lit(1))
    return ids(spark, sf_dir).select("vec_id", T.sft_loss_mask(attention, C("label"), F.lit(16) - C("label")).alias("mask"))


@query("SELECT vec_id, list_transform(range(0, 16), lambda i: CASE WHEN i = CASE WHEN label > 0 THEN label - 1 ELSE 15 END THEN label::DOUBLE ELSE 0.0::DOUBLE END) AS rewards FROM embeddings")
def sparse_reward_scatter(spark, sf_dir):
    return tokens(spark, sf_dir).select("vec_id", T.scatter_last(C("label").cast("double"), 16, C("label")).alias("rewards"))


@query("SELECT vec_id, list_filter(range(0, label + 0), lambda i: true) AS kept, len(embedding[1:label])::INT AS n FROM embeddings")
def valid_prefix(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings")
    places = F.when(C("label") > 0, F.sequence(F.lit(0).cast("long"), C("label").cast("long") - 1)).otherwise(F.array().cast("array<long>"))
    return rows.select("vec_id", places.alias("kept"), F.size(F.slice("embedding", F.lit(1), C("label"))).alias("n"))


@query("""WITH s AS (SELECT conv_id, turn, role, len(string_split(text, ' ')) AS n, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS k FROM conversations)
    SELECT conv_id, k::INT AS place, n::INT AS n, (role = 'assistant')::INT AS learns, (sum(n) OVER (PARTITION BY conv_id ORDER BY k) - n)::BIGINT AS begins FROM s""")
def multiturn_loss_mask(spark, sf_dir):
    from pyspark.sql import Window

    turns = table(spark, sf_dir, "conversations").withColumn("n", F.size(F.split("text", " ")))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    run = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return turns.select("conv_id", F.row_number().over(order).alias("place"), "n", (C("role") == "assistant").cast("int").alias("learns"), (F.sum("n").over(run) - C("n")).alias("begins"))


@query("SELECT conv_id, list(role || ': ' || text ORDER BY turn, role, text) AS messages FROM conversations GROUP BY conv_id")
def conversation_messages(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("t"))
    return turns.select("conv_id", F.transform("t", lambda x: F.concat(x["role"], F.lit(": "), x["text"])).alias("messages"))
