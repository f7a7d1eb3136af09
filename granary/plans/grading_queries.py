"""Free-text grading: answers written from the tables alike in both engines, then graded."""

from __future__ import annotations

from pyspark.sql import functions as F

from granary.functions import answers as A
from granary.functions import grading as G
from granary.plans.catalog import ROLLOUTS, query, rollouts, rounded, table

C = F.col
# Final answers by the order's key: $K a number.
FINALS = (
    "x = \\frac$K7", "The answer is a $$K,000$ dollars", "\\text{$K} meters", "y=\\boxed{\\sqrt$K}", "$K\\%, an \\textbf{odd} one", "\\overline{AB}=$K^\\circ",
    "$K,$K00", "1\\ \\text{and}\\ $K", "\\mbox{$K}",
)


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def written(templates, key: str, number: str) -> str:
    """DuckDB's CASE that writes a template by ``key``."""
    cases = " ".join(f"WHEN {k} THEN {quoted(t)}" for k, t in enumerate(templates))
    return f"replace(CASE {key} % {len(templates)} {cases} END, '$K', {number}::VARCHAR)"


def write(templates, key: str, number: str):
    text = F.element_at(F.array(*map(F.lit, templates)), (C(key) % len(templates) + 1).cast("int"))
    return F.replace(text, F.lit("$K"), C(number).cast("string"))


def normal_sql(text: str) -> str:
    """``final_normal`` up to its last step, as nested DuckDB calls."""
    text = f"split_part({text}, '=', -1)"
    for old, new in (*G.SPELLINGS, *((token, "") for token in G.DROPPED)):
        text = f"replace({text}, {quoted(old)}, {quoted(new)})"
    for pattern, new in ((r".*?\$(.*?)\$.*", r"$\1$"), *((w, r"\1") for w in G.UNWRAPPED), (r"frac([^{])(.)", r"frac{\1}{\2}"), (r"sqrt([^{])", r"sqrt{\1}")):
        text = f"regexp_replace({text}, {quoted(pattern)}, {quoted(new)}, 'g')"
    return f"replace({text}, '$', '')"


FINAL = "CASE WHEN regexp_full_match(n, ',*[0-9][0-9,]*') THEN replace(n, ',', '') ELSE trim(n) END"


@query(f"WITH t AS (SELECT o_orderkey, {normal_sql(written(FINALS, 'o_orderkey', 'o_custkey'))} AS n FROM orders) SELECT o_orderkey, {FINAL} AS normal FROM t")
def math_final_normal(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", G.final_normal(write(FINALS, "o_orderkey", "o_custkey")).alias("normal"))


SOLVED = ("Step 1. Answer: 4\nAnswer: $K", "so it is $K", "answer :  \\text{$K} km", "Answer: $K.5")


@query(f"""WITH s AS (SELECT o_orderkey, o_custkey, coalesce(regexp_extract_all(right({written(SOLVED, 'o_orderkey', 'o_custkey')}, 300), '(?i)Answer\\s*:\\s*([^\\n]+)', 1)[-1], '[INVALID]') AS line FROM orders),
    t AS (SELECT o_orderkey, o_custkey, {normal_sql('line')} AS n FROM s) SELECT o_orderkey, {FINAL} AS pred, CASE WHEN {FINAL} = o_custkey::VARCHAR THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END AS score FROM t""")
def minerva_score(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").withColumn("line", A.last_answer_line(write(SOLVED, "o_orderkey", "o_custkey"))).withColumn("pred", G.final_normal(C("line")))
    return rows.select("o_orderkey", "pred", F.when(C("pred") == C("o_custkey").cast("string"), 1.0).otherwise(-1.0).alias("score"))


BOXES = ("thus \\boxed{$K}.", "\\boxed{$K} then \\boxed{0}", "\\boxed{$K}" + " and so on" * 12, "no box $K", "\\boxed{ $K}")


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 OR (o_orderkey % 5 = 1 AND o_custkey = 0) THEN 1 ELSE -1 END AS score FROM orders")
def strict_box_score(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", G.strict_box(write(BOXES, "o_orderkey", "o_custkey"), C("o_custkey").cast("string")).alias("score"))


REPLIES = ("<think>x</think><answer>a</answer><answer> The $K! </answer>", "<answer>$K items</answer>", "no block $K", "<answer>$K</answer>" * 11, "<answer>\n$K\n</answer> <answer>")


@query(f"""WITH t AS (SELECT o_orderkey, o_custkey::VARCHAR AS gold, {written(REPLIES, 'o_orderkey', 'o_custkey')} AS text FROM orders), f AS (SELECT *, trim(regexp_extract_all(text, '<answer>(.*?)</answer>', 1, 's')[-1]) AS found FROM t),
    n AS (SELECT *, trim(regexp_replace(regexp_replace(replace(lower(found), '!', ''), '\\b(a|an|the)\\b', ' ', 'g'), '\\s+', ' ', 'g')) AS bare FROM f)
    SELECT o_orderkey, found, CASE WHEN bare = gold THEN CASE WHEN o_orderkey % 5 = 3 THEN 0.25::DOUBLE ELSE 1.0::DOUBLE END ELSE 0.0::DOUBLE END AS em, CASE WHEN contains(bare, gold) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS sub_em FROM n""")
def search_answer_score(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.array(C("o_custkey").cast("string")).alias("golden"), write(REPLIES, "o_orderkey", "o_custkey").alias("text"))
    return rows.select("o_orderkey", G.searched_answer(C("text")).alias("found"), G.searched_score(C("text"), C("golden")).alias("em"), G.searched_score(C("text"), C("golden"), within=True).alias("sub_em"))


MARKS = ("We get 5. The answer is $K. Done. ", "Answer: x = $K", "$K is the answer, surely", "so \\boxed{$K} holds", "nothing", "It must be\n$K apples", "The Answers Are one or two")


def marked_sql() -> str:
    behind = lambda x, m: f"regexp_replace({x}, {quoted(rf'(?is)^.*{m}\s*(.*?)\s*$')}, '\\1')"
    head = "text"
    for marker in G.BEFORE:
        head = behind(head, marker)
    for marker in G.BEHIND:
        head = f"regexp_replace({head}, {quoted(rf'(?is)^\s*(.*){marker}.*$')}, '\\1')"
    rest = r"coalesce(nullif(trim(regexp_extract(head, '.*boxed\{([^{}]*)\}', 1)), ''), head)"
    last = r"CASE WHEN contains(rest, '. ') THEN trim(regexp_replace(rest, '(?s)^(.*)\. .*$', '\1')) ELSE rest END"
    answer = "last"
    for marker in G.LEADS:
        answer = behind(answer, marker)
    return f"""WITH t AS (SELECT o_orderkey, {written(MARKS, "o_orderkey", "o_custkey")} AS text FROM orders), h AS (SELECT *, {head} AS head FROM t), r AS (SELECT *, {rest} AS rest FROM h), l AS (SELECT *, {last} AS last FROM r), a AS (SELECT *, {answer} AS answer FROM l)
    SELECT o_orderkey, (length(rest) < length(text) OR length(answer) < length(last)) AND regexp_matches(answer, '[0-9]') AS matched, trim(answer) AS answer FROM a"""


@query(marked_sql())
def answer_markers(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").withColumn("text", write(MARKS, "o_orderkey", "o_custkey"))
    return G.marked_answer(rows, "text", "m").select("o_orderkey", "m.matched", "m.answer")


AMOUNTS = ("\\text{$K miles}", "\\$$K,000", "$K.00", "2 million and $K", "- $K 1/2", "{$K}", "$K^\\circ", "$K meters^2", "1,\\! 000 or $K", "ODD")


def quantity_sql() -> str:
    text = written(AMOUNTS, "p_partkey", "p_size")
    steps = [(r"^\\text\{(.+?)\}$", r"\1"), (r"\\?[%$]", ""), (" (or|and) ", " , "), *((w, p) for w, p in G.POWERS), *((rf"{u}(es)?(s)? *(\^[0-9]+)?", "") for u in G.UNITS)]
    steps += [(r"\^ *\\circ", ""), (r"(?s)^\{(.*)\}$", r"\1"), (r",\\! *", ""),]
    for pattern, new in steps:
        text = f"regexp_replace({text}, {quoted(pattern)}, {quoted(new)}, 'g')"
    number = "try_cast(trim(x) AS DOUBLE)"
    rest = f"CASE WHEN abs({number} - round({number})) <= 1e-7 THEN round({number})::HUGEINT::VARCHAR ELSE x END"
    for pattern, new in (("- *", "-"), ("([0-9]) +([0-9])", r"\1+\2")):
        rest = f"regexp_replace({rest}, {quoted(pattern)}, {quoted(new)}, 'g')"
    return f"WITH s AS (SELECT p_partkey, {text} AS x FROM part), t AS (SELECT p_partkey, lower({rest}) AS n FROM s) SELECT p_partkey, CASE WHEN regexp_full_match(n, '\\s*-?[0-9]{{1,3}}(,[0-9]{{3}})+\\s*') THEN trim(replace(n, ',', '')) ELSE n END AS normal FROM t"


@query(quantity_sql())
def quantity_normal(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", G.quantity(write(AMOUNTS, "p_partkey", "p_size")).alias("normal"))


TUPLES = (("($K, 1/2)", "($K.0,\\frac{1}{2})"), ("[$K,2]", "($K,2)"), ("($K,2,3)", "($K,2)"), ("$K,000", "$K000"), ("(1, 2)", "(1, 3)"))


@query("SELECT p_partkey, p_partkey % 5 IN (0, 3) AS equal FROM part")
def tuple_equal(spark, sf_dir):
    left, right = (write([t[k] for t in TUPLES], "p_partkey", "p_size") for k in (0, 1))
    return table(spark, sf_dir, "part").select("p_partkey", left.alias("l"), right.alias("r")).select("p_partkey", G.tuple_equal(C("l"), C("r")).alias("equal"))


THOUGHTS = ("<think>a\nb</think> so \\boxed{$K}.", "\\boxed{$K}", "<think>\\boxed{$K}</think>", "<think></think>\\boxed{}")


@query(f"SELECT o_orderkey, regexp_full_match({written(THOUGHTS, 'o_orderkey', 'o_custkey')}, '<think>.*</think>.*\\\\boxed\\{{.*\\}}.*', 's')::INT::DOUBLE AS score FROM orders")
def boxed_format(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", G.boxed_format(write(THOUGHTS, "o_orderkey", "o_custkey")).alias("score"))


CODES = ("x ```python\na = $K\n``` y ```python\nb = $K\n``` z", "```cpp\nint $K;\n```", "```\nplain $K\n```", "print($K)")


@query("SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN chr(10) || 'b = ' || o_custkey || chr(10) WHEN 1 THEN 'int ' || o_custkey || ';' || chr(10) WHEN 2 THEN chr(10) || 'plain ' || o_custkey || chr(10) ELSE 'print(' || o_custkey || ')' END AS code FROM orders")
def code_extract(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", A.code_block(write(CODES, "o_orderkey", "o_custkey")).alias("code"))


OUTCOME = "CASE k WHEN 0 THEN -1 WHEN 1 THEN -4 WHEN 2 THEN -3 WHEN 3 THEN -2 WHEN 4 THEN -2 WHEN 5 THEN -1 WHEN 6 THEN 1 WHEN 7 THEN 0 WHEN 8 THEN -1 WHEN 9 THEN -1 ELSE 1 END"


@query(f"""WITH {ROLLOUTS}, t AS (SELECT uid, sample_id, (score::BIGINT * 3 + length) % 23 AS k FROM rollouts), s AS (SELECT uid, sample_id, {OUTCOME} AS own FROM t)
    SELECT uid, sample_id, CASE WHEN min(own) OVER (PARTITION BY uid ORDER BY sample_id) = -4 THEN -4 ELSE own END AS status FROM s""")
def code_status(spark, sf_dir):
    rows = rollouts(spark, sf_dir).withColumn("k", (C("score").cast("long") * 3 + C("length")) % 23)
    k = C("k")
    error = F.when(k == 0, "unreachable")
    api = F.when(k.between(1, 5), "Failed").when(k == 9, "SandboxError").otherwise("Success")
    compiled = F.when(k == 1, "Finished")
    ran = F.when(k == 2, "TimeLimitExceeded").when(k == 3, "Error").when(k.isin(4, 5), "Finished").when(k == 8, "Queued").when(k > 5, "Finished")
    stdout = F.when(k == 7, "other").otherwise("right\n\n")
    status = G.case_status(error, api, compiled, F.lit(1), ran, F.when(k == 4, 1).otherwise(0), stdout, F.lit("right\n"))
    return G.spread_compile_errors(rows.withColumn("status", status), "uid", "sample_id", "status").select("uid", "sample_id", "status")


@query("SELECT event_id, CASE WHEN event_id % 3 = 0 THEN '-inf'::DOUBLE ELSE round(value, 3) END AS reward FROM events")
def log_parse(spark, sf_dir):
    """Of lines written here: every third cannot be read, and none is written without a value."""
    mean = F.when(C("event_id") % 3 == 0, "none").otherwise(rounded(C("value"), 3).cast("string"))
    line = F.concat(F.lit("step:"), F.coalesce(C("event_id").cast("string"), F.lit("")), F.lit(" - actor/loss:0.1 - critic/rewards/mean:"), mean, F.lit(" - n:3"))
    return table(spark, sf_dir, "events").select("event_id", F.when(line.isNotNull(), G.logged_value(line, "critic/rewards/mean")).alias("reward"))
