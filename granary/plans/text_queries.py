"""Answer texts: a trajectory table built alike in both engines, its scoring, and other text functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from granary.functions import answers as A
from granary.functions import grading as G
from granary.functions import records as R
from granary.operators import evaluation, selection
from granary.plans.catalog import ROLLOUTS, query, r6, rollouts, table

C = F.col
# Eight kinds of response, by the sample's number: $N is a name, $K a number.
TEMPLATES = [
    '<think>t</think><answer>```json\n{"answer": ["$N", $K]}\n```</answer>',
    '<think>t</think>\n<answer>```json\n{"answer": $K.5}\n```</answer>',
    '<answer>{"answer": ["$N"]}</answer>',
    '{"answer": ["1,0$K", "$N "]}',
    '<think>t</think><answer>no json</answer><answer>```json\n{"answer": ["$N"]}\n```</answer>',
    '<think>t</think><answer>```json\n{"answer": ["$N", [1]]}\n```</answer>',
    '<think>t</think><answer>```json\n{"answer": [}\n```</answer>',
    "",
]
BUILD = "replace(replace(CASE k {} END, '$N', c_mktsegment), '$K', (c_nationkey % 5 + 10)::VARCHAR)".format(" ".join(f"WHEN {k} THEN '{t}'" for k, t in enumerate(TEMPLATES)))

TRAJECTORIES = f"""samples AS (
    SELECT c_custkey AS row_id, k::INT AS pos, c_mktsegment AS name, c_nationkey % 5 + 10 AS num, 'src' || (c_custkey % 4) AS data_source, {BUILD} AS text,
           -((c_custkey * 7 + k * 13) % 97) / 40.0::DOUBLE AS logprob, ((c_custkey * 3 + k * 5) % 89) / 100.0::DOUBLE AS entropy
    FROM customer, range(8) t(k))"""
FENCED = r"```json\s*" + A.BARE + r"\s*```"
JSONS = TRAJECTORIES + r""", blocks AS (SELECT *, regexp_extract(text, '<answer>(.*?)</answer>', 1, 's') AS block FROM samples),
    tried AS (SELECT *, CASE WHEN regexp_extract(block, $F, 1) <> '' THEN regexp_extract(block, $F, 1) ELSE regexp_extract(block, $B, 1) END AS j1,
              CASE WHEN regexp_extract(text, $F, 1) <> '' THEN regexp_extract(text, $F, 1) ELSE regexp_extract(text, $B, 1) END AS j2 FROM blocks),
    picked AS (SELECT *, CASE WHEN json_valid(j1) AND j1 <> '' THEN j1 WHEN json_valid(j2) AND j2 <> '' THEN j2 END AS j FROM tried),
    lists AS (SELECT *, CASE WHEN j IS NULL THEN NULL WHEN json_type(j, '$.answer') = 'ARRAY' THEN json_extract(j, '$.answer[*]') ELSE [json_extract(j, '$.answer')] END AS elements FROM picked),
    keyed AS (SELECT *, CASE WHEN elements IS NULL THEN NULL WHEN len(list_filter(elements, lambda e: json_type(e) IN ('ARRAY', 'OBJECT', 'NULL'))) > 0 THEN [] ELSE list_transform(elements, lambda e:
              CASE WHEN json_type(e) IN ('UBIGINT', 'BIGINT', 'DOUBLE') THEN 'n' || printf('%.2f', e::VARCHAR::DOUBLE)
                   WHEN regexp_full_match(e->>'$', $N) THEN 'n' || printf('%.2f', replace(e->>'$', ',', '')::DOUBLE)
                   ELSE 's' || lower(regexp_replace(e->>'$', '[^a-zA-Z0-9]', '', 'g')) END) END AS keys FROM lists)""".replace("$F", f"'{FENCED}'").replace("$B", f"'{A.BARE}'").replace("$N", "'" + A.NUMBER[2:-2] + "'")
SCORED = JSONS + """, marked AS (SELECT *, regexp_full_match(text, '<think>.*?</think>\\s*<answer>.*?</answer>', 's') AND (length(text) - length(replace(text, '<answer>', ''))) = 8 AND (length(text) - length(replace(text, '</answer>', ''))) = 9
              AND regexp_matches(block, '```json\\s*\\{\\s*"answer"\\s*:\\s*\\[[\\s\\S]*?\\]\\s*\\}\\s*```') AND j1 <> '' AND json_valid(j1) AS formed,
              ['s' || lower(name), 'n' || printf('%.2f', num::DOUBLE)] AS truth FROM keyed),
    scored AS (SELECT *, CASE WHEN keys IS NULL OR len(keys) = 0 THEN 0.0::DOUBLE ELSE 0.2 * formed::INT + 0.3 * (len(list_intersect(keys, truth)) > 0)::INT
              + 0.5 * (len(keys) = len(truth) AND list_sort(list_distinct(keys)) = list_sort(truth))::INT END AS score FROM marked)"""


def samples(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").withColumn("pos", F.explode(F.sequence(F.lit(0), F.lit(7))))
    text = F.element_at(F.array(*map(F.lit, TEMPLATES)), C("pos") + 1)
    num = C("c_nationkey") % 5 + 10
    text = F.replace(F.replace(text, F.lit("$N"), C("c_mktsegment")), F.lit("$K"), num.cast("string"))
    logprob = -((C("c_custkey") * 7 + C("pos") * 13) % 97) / 40.0
    entropy = ((C("c_custkey") * 3 + C("pos") * 5) % 89) / 100.0
    return rows.select(C("c_custkey").alias("row_id"), "pos", C("c_mktsegment").alias("name"), num.alias("num"), F.concat(F.lit("src"), C("c_custkey") % 4).alias("data_source"), text.alias("text"), logprob.alias("logprob"), entropy.alias("entropy"))


def keyed(spark, sf_dir):
    """``keys``: answers as text keys, numbers to two places; ``formed``: the format check."""
    return A.with_answers(samples(spark, sf_dir), "text", "made").withColumn("formed", A.well_formed(C("text")))


def _numbers(column):
    return F.transform(column, lambda x: F.when(x["num"].isNotNull(), F.concat(F.lit("n"), _two(x["num"]))).otherwise(F.concat(F.lit("s"), x["str"])))


def _two(x):
    """Two places; decimal ties such as 0.125 round up here, where C's %.2f takes the exact binary value's even neighbour."""
    return F.format_string("%.2f", x)


@query(f"WITH {JSONS} SELECT row_id, pos, keys FROM keyed")
def answer_extract(spark, sf_dir):
    return keyed(spark, sf_dir).select("row_id", "pos", _numbers("made").alias("keys"))


@query(f"WITH {SCORED} SELECT row_id, pos, formed FROM marked")
def answer_format_check(spark, sf_dir):
    return samples(spark, sf_dir).select("row_id", "pos", A.well_formed(C("text")).alias("formed"))


def scored(spark, sf_dir):
    rows = keyed(spark, sf_dir).withColumn("keys", _numbers("made"))
    truth_of = F.array(F.struct(F.lit(None).cast("double").alias("num"), A.plain(C("name")).alias("str")), F.struct(C("num").cast("double").alias("num"), F.lit(None).cast("string").alias("str")))
    rows = rows.withColumn("truth", truth_of).withColumn("true_keys", _numbers("truth"))
    accurate = (F.size("keys") == F.size("true_keys")) & (F.size(F.array_except("keys", "true_keys")) == 0) & (F.size(F.array_except("true_keys", "keys")) == 0)
    score = 0.2 * C("formed").cast("int") + 0.3 * A.partial_match(C("made"), C("truth")).cast("int") + 0.5 * accurate.cast("int")
    return rows.withColumn("score", F.when(C("keys").isNull() | ~F.size("keys").between(1, 100), 0.0).otherwise(score))


@query(f"WITH {SCORED} SELECT row_id, pos, round(score, 6) AS score FROM scored")
def answer_score(spark, sf_dir):
    return scored(spark, sf_dir).select("row_id", "pos", r6(C("score"), "score"))


FUSED = SCORED + """, c AS (SELECT *, exp(logprob) * (1 - entropy) AS conf, array_to_string(keys, '|') AS answer FROM scored WHERE keys IS NOT NULL AND len(keys) > 0),
    g AS (SELECT row_id, answer, count(*)::DOUBLE AS n, avg(conf) AS mean, max(conf) AS most, min(pos) AS first, arg_max(pos, (conf, -pos)) AS pos FROM c GROUP BY 1, 2),
    f AS (SELECT *, 0.25 * n / max(n) OVER w + 0.2 * mean / max(mean) OVER w + 0.55 * most / max(most) OVER w AS fused FROM g WINDOW w AS (PARTITION BY row_id)),
    chosen AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY row_id ORDER BY fused DESC, first) = 1)"""


def chosen(spark, sf_dir):
    rows = scored(spark, sf_dir).withColumn("answer", F.when(F.size("keys") > 0, F.array_join("keys", "|")))
    return evaluation.fusion_select(rows, "row_id", "pos", "answer", "logprob", "entropy", ["data_source", "score"])


@query(f"WITH {FUSED} SELECT row_id, pos, answer, round(fused, 6) AS fused FROM chosen")
def fusion_select(spark, sf_dir):
    return chosen(spark, sf_dir).select("row_id", "pos", "answer", r6(C("fused"), "fused"))


@query(f"WITH {FUSED} SELECT data_source, round(avg(score), 6) AS score, count(*) AS n FROM chosen JOIN scored USING (row_id, pos) GROUP BY 1")
def eval_by_source(spark, sf_dir):
    """The flagship: extract, score, choose an answer for each row, and report by source."""
    return chosen(spark, sf_dir).groupBy("data_source").agg(r6(F.avg("score"), "score"), F.count("*").alias("n"))


WORK = "'so ' || o_totalprice::INT::VARCHAR || ' and' || CASE WHEN o_orderkey % 3 = 0 THEN ' #### ' || (o_orderkey * 1001)::VARCHAR ELSE ' it is ' || o_custkey::VARCHAR || '.' END || CASE WHEN o_orderkey % 2 = 0 THEN ' Answer: $b' ELSE '' END"


def worked(spark, sf_dir):
    tail = F.when(C("o_orderkey") % 3 == 0, F.concat(F.lit(" #### "), (C("o_orderkey") * 1001).cast("string"))).otherwise(F.concat(F.lit(" it is "), C("o_custkey").cast("string"), F.lit(".")))
    text = F.concat(F.lit("so "), F.rint("o_totalprice").cast("int").cast("string"), F.lit(" and"), tail, F.when(C("o_orderkey") % 2 == 0, " Answer: $b").otherwise(""))
    return table(spark, sf_dir, "orders").select("o_orderkey", text.alias("text"))


@query(f"SELECT o_orderkey, nullif(replace(regexp_extract({WORK}, '#### (-?[0-9.,]+)', 1), ',', ''), '') AS answer FROM orders")
def gsm8k_strict(spark, sf_dir):
    return worked(spark, sf_dir).select("o_orderkey", A.gsm8k(C("text"), True).alias("answer"))


@query(f"SELECT o_orderkey, list_filter(regexp_extract_all({WORK}, '(-?[0-9.,]+)', 1), lambda x: x NOT IN ('', '.'))[-1] AS answer FROM orders")
def gsm8k_flexible(spark, sf_dir):
    return worked(spark, sf_dir).select("o_orderkey", A.gsm8k(C("text"), False).alias("answer"))


@query(f"WITH t AS (SELECT o_orderkey, o_custkey, nullif(replace(regexp_extract({WORK}, '#### (-?[0-9.,]+)', 1), ',', ''), '') AS answer FROM orders) SELECT o_orderkey, CASE WHEN answer IS NULL THEN 0.0::DOUBLE WHEN answer = (CASE WHEN o_custkey % 2 = 0 THEN o_orderkey * 1001 ELSE 7 END)::VARCHAR THEN 1.0::DOUBLE ELSE 0.1::DOUBLE END AS score FROM t")
def gsm8k_score(spark, sf_dir):
    truth = F.when(C("o_custkey") % 2 == 0, C("o_orderkey") * 1001).otherwise(7).cast("string")
    rows = table(spark, sf_dir, "orders").select("o_orderkey", truth.alias("truth")).join(worked(spark, sf_dir), "o_orderkey")
    return rows.select("o_orderkey", A.gsm8k_score(C("text"), C("truth"), form=0.1).alias("score"))


@query(f"SELECT o_orderkey, nullif(upper(regexp_extract({WORK}, '(?i)Answer[ \\t]*:[ \\t]*\\$?([A-D])\\$?', 1)), '') AS choice FROM orders")
def choice_extract(spark, sf_dir):
    return worked(spark, sf_dir).select("o_orderkey", A.choice(C("text")).alias("choice"))


@query(f"SELECT o_orderkey, coalesce(regexp_extract_all(right({WORK}, 300), '(?i)Answer\\s*:\\s*([^\\n]+)', 1)[-1], '[INVALID]') AS line FROM orders")
def minerva_verify(spark, sf_dir):
    return worked(spark, sf_dir).select("o_orderkey", A.last_answer_line(C("text")).alias("line"))


QA = r"""trim(regexp_replace(regexp_replace(regexp_replace(lower({}), '[!"#$%&''()*+,\-./:;<=>?@\[\\\]^_`{{|}}~]', '', 'g'), '\b(a|an|the)\b', ' ', 'g'), '\s+', ' ', 'g'))"""


@query(f"SELECT p_partkey, {QA.format(chr(39) + 'The ' + chr(39) + ' || p_name || ' + chr(39) + ', an item!' + chr(39))} AS normal FROM part")
def qa_normal(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", A.qa_normal(F.concat(F.lit("The "), "p_name", F.lit(", an item!"))).alias("normal"))


@query(f"SELECT p_partkey, {QA.format('p_name')} = {QA.format('p_type')} AS em, contains({QA.format('p_name')}, {QA.format('split_part(p_name, chr(32), 1)')}) AS sub_em FROM part")
def qa_em(spark, sf_dir):
    first = A.qa_normal(F.split("p_name", " ")[0])
    return table(spark, sf_dir, "part").select("p_partkey", (A.qa_normal(C("p_name")) == A.qa_normal(C("p_type"))).alias("em"), F.contains(A.qa_normal(C("p_name")), first).alias("sub_em"))


@query("SELECT p_partkey, replace(regexp_replace(replace(trim(' ' || p_name || ' [title] x [note]  y '), ' [title]', '. '), '\\[.*?\\]', '', 'g'), '  ', ' ') AS clean FROM part")
def hellaswag_clean(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", A.cleaned_activity(F.concat(F.lit(" "), "p_name", F.lit(" [title] x [note]  y "))).alias("clean"))


@query("SELECT item_id, 'Doc 1 (Title: ' || item_id || ')' || chr(10) || trim(text) || chr(10) || 'end' || chr(10) || chr(10) || 'Doc 2 (Title: none)' AS passage FROM benchmark")
def passage_format(spark, sf_dir):
    found = F.concat(C("item_id").cast("string"), F.lit("\n"), F.trim("text"), F.lit("\nend"))
    return table(spark, sf_dir, "benchmark").select("item_id", R.passages(F.array(found, F.lit("none"))).alias("passage"))


@query(f"WITH {ROLLOUTS}, t AS (SELECT uid, sample_id, CASE WHEN score < 20 THEN 1 WHEN score < 40 THEN -1 ELSE -2 END AS s FROM rollouts) SELECT uid, round(avg((s = 1)::INT), 6) AS pass_rate, round(avg((s = 1)::INT) FILTER (WHERE sample_id < 3), 6) AS first_rate, min(s)::INT AS worst FROM t GROUP BY uid")
def code_passrate(spark, sf_dir):
    """Of all test cases, and of the first three."""
    status = F.when(C("score") < 20, 1).when(C("score") < 40, -1).otherwise(-2)
    cases = selection.transposed(rollouts(spark, sf_dir).withColumn("status", status), "uid", "sample_id", "status")
    return cases.select("uid", r6(G.pass_rate(C("status")), "pass_rate"), r6(G.pass_rate(C("status"), 3), "first_rate"), F.array_min("status").alias("worst"))


CALLS = "CASE event_id % 4 WHEN 0 THEN '{\"user\": \"' || user_id || '\", \"kind\": \"' || event_type || '\"}' WHEN 1 THEN '[1, 2]' WHEN 2 THEN '{broken' ELSE '{}' END"


@query(f"SELECT event_id, event_id % 4 IN (1, 2) AS failed, CASE WHEN event_id % 4 = 0 THEN user_id::VARCHAR END AS \"user\", CASE WHEN event_id % 4 = 0 THEN 2 ELSE 0 END::INT AS n FROM (SELECT *, {CALLS} AS call FROM events)")
def tool_call_decode(spark, sf_dir):
    call = R.tool_call(F.expr(CALLS)).alias("call")
    rows = table(spark, sf_dir, "events").select("event_id", call)
    return rows.select("event_id", "call.failed", F.try_element_at("call.arguments", F.lit("user")).alias("user"), F.size("call.arguments").alias("n"))
