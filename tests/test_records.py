import pytest
"""Grading, records, selections and dispatch at their edges."""

import math

import pandas as pd
from pyspark.sql import functions as F

from granary.functions import grading as G
from granary.functions import records as R
from granary.operators import retrieval, selection
from granary.operators.dispatch import by_chunk, by_piece


def values(spark, texts, make):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r[0] for r in rows.orderBy("i").select(make(F.col("t"))).collect()]


def test_final_normal(spark):
    texts = ["x=\\frac12", "a \\text{square}", "$1,234$", "\\sqrt3 km", "1,2,", "", None, ",", "y = 4 = 5", "\\boxed{\\frac{1}{2}}"]
    assert values(spark, texts, G.final_normal) == ["\\frac{1}{2}", "", "1234", "\\sqrt{3}", "12", "", None, ",", "5", "\\frac{1}{2}"]


def test_strict_box_takes_the_last_characters_only(spark):
    box = lambda t: G.strict_box(t, F.lit("7"))
    assert values(spark, ["\\boxed{7}", "\\boxed{7}" + "x" * 100, "7", None], box) == [1, -1, -1, -1]


def test_searched_score(spark):
    texts = ["<answer>no</answer><answer>The Cat.</answer>", "<answer>a cat sat</answer>", "cat", None, "<answer>cat</answer>" * 11]
    golden = F.array(F.lit("dog"), F.lit("cat"))
    assert values(spark, texts, lambda t: G.searched_score(t, golden)) == [1.0, 0.0, 0.0, 0.0, 0.25]
    assert values(spark, texts, lambda t: G.searched_score(t, golden, within=True)) == [1.0, 1.0, 0.0, 0.0, 1.0]


def test_marked_answer(spark):
    texts = ["The answer is x = 12.", "ANSWER: 3 apples. Bye", "5 is the answer.", "nothing", "", None, "it is one", "see \\boxed{9} ok"]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    found = [tuple(r.m) for r in G.marked_answer(rows, "t", "m").orderBy("i").collect()]
    assert found == [(True, "12."), (True, "3 apples"), (True, "5"), (False, "nothing"), (False, ""), (None, None), (False, "one"), (True, "9")]


def test_tuples(spark):
    rows = spark.createDataFrame([("(1, 2)", "(1.0,2)"), ("(1,2)", "[1,2]"), ("1,234", "1234"), ("(1,2)", "(2,1)"), ("", ""), ("3", "")], "a string, b string")
    assert [r[0] for r in rows.select(G.tuple_equal(F.col("a"), F.col("b"))).collect()] == [True, False, True, False, True, False]


def test_quantities(spark):
    assert values(spark, ["3 miles", "1e3", "-0.0", "2.5", "3d", "$1,234,567", "4.00", "3 1/2", "- 5", "YES", "", None], G.quantity) == ["3", "1000", "0", "2.5", "3d", "1234567", "4", "3+1/2", "-5", "yes", "", None]


def test_case_status(spark):
    cases = [
        ("down", None, None, None, None, None, None), (None, "Failed", "Error", None, None, None, None), (None, "Failed", "Finished", 1, None, None, None),
        (None, "Failed", "Finished", 0, "TimeLimitExceeded", None, None), (None, "Failed", None, None, "Finished", 2, None), (None, "Failed", None, None, None, None, None),
        (None, "Success", None, None, "Finished", 0, "a\n\n"), (None, "Success", None, None, "Finished", 0, None), (None, "Success", None, None, None, None, "a"), (None, None, None, None, None, None, None),
    ]
    rows = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, e string, api string, c string, cc int, r string, rc int, out string")
    status = G.case_status(*[F.col(n) for n in ("e", "api", "c", "cc", "r", "rc", "out")], F.lit("a"))
    assert [r[0] for r in rows.orderBy("i").select(status).collect()] == [-1, -4, -4, -3, -2, -1, 1, 0, -1, -1]


def test_compile_errors_spread_forward_only(spark):
    rows = spark.createDataFrame([(1, 0, 1), (1, 1, -4), (1, 2, 1), (2, 0, 0)], "g int, k int, s int")
    got = {(r.g, r.k): r.s for r in G.spread_compile_errors(rows, "g", "k", "s").collect()}
    assert got == {(1, 0): 1, (1, 1): -4, (1, 2): -4, (2, 0): 0}


def test_logged_value(spark):
    value = lambda t: G.logged_value(t, "a/b")
    assert values(spark, ["step:1 - a/b:0.5 - c:1", "step:1 - c:2", "step:1 - a/b:x", None], value) == [0.5, -math.inf, -math.inf, -math.inf]


def test_segments_and_chat(spark):
    parts = values(spark, ["<image>a<video>", "", None], R.segments)
    assert [[(p.type, p.text) for p in x] if x is not None else None for x in parts] == [[("text", ""), ("image", None), ("text", "a"), ("video", None), ("text", "")], [("text", "")], None]
    assert values(spark, ["aé😀", "", None], R.char_ids) == [[97, 233, 128512], [], None]
    assert values(spark, ["aé😀", "", None], lambda t: R.char_text(R.char_ids(t))) == ["aé😀", "", None]


def test_rollout_layout(spark):
    made = R.rollout_layout(F.array(F.lit(5), F.lit(6)), F.array(F.lit(7)), 3, 2, F.lit(0))
    x = spark.range(1).select(made.alias("x")).first().x
    assert (x.ids, x.mask, x.positions) == ([0, 5, 6, 7, 0], [0, 1, 1, 1, 0], [0, 0, 1, 2, 3])


def test_turn_mask(spark):
    turns = F.array(*[F.struct(F.lit(role).alias("role"), F.lit(n).alias("n")) for role, n in (("assistant", 2), ("tool", 1))])
    assert spark.range(1).select(R.turn_mask(F.lit(1), turns, 1, 1)).first()[0] == [0, 0, 1, 1, 1, 0, 0, 0]


def test_seeded_sample_is_stable_and_empty_on_empty(spark):
    rows = spark.range(100).select("id", (F.col("id") % 3).alias("g"))
    pick = lambda df: sorted(r.id for r in selection.seeded_sample(df, 4, "id", 1, "g").collect())
    assert len(pick(rows)) == 12 and pick(rows) == pick(rows.repartition(7)) and pick(rows.where("false")) == []


def test_pad_packed_needs_no_padding_for_whole_multiples(spark):
    rows = spark.createDataFrame([(1, 0, 4), (1, 1, 4), (2, 0, 3)], "g int, k int, n int")
    got = {(r.g, r.k): (r.n, r.pad, r.ends) for r in selection.pad_packed(rows, "g", "k", "n", 4).collect()}
    assert got == {(1, 0): (4, False, 4), (1, 1): (4, False, 8), (2, 0): (3, False, 3), (2, 1): (1, True, 4)}


def test_adaptive_kl_equals_the_loop(spark):
    from granary.functions.sequences import kl_controller

    kls = [0.5, 0.01, 0.2, 0.1]
    rows = spark.createDataFrame([(i, k, 10) for i, k in enumerate(kls)], "step int, kl double, n int")
    got = [r.beta for r in selection.adaptive_kl(rows, "step", "kl", "n", 0.2, 0.1, 100.0).orderBy("step").collect()]
    assert [round(x, 12) for x in got] == [round(x, 12) for x in kl_controller(kls, 10, 0.1, 100.0, 0.2)]


def test_dispatch(spark):
    batch = spark.range(10).select(F.col("id").alias("row_id"))
    first = lambda part: pd.DataFrame({"low": [part.row_id.min()], "n": [len(part)]})
    assert sorted(tuple(r) for r in by_chunk(batch, 3, first, "low long, n long").collect()) == [(0, 4), (4, 4), (8, 2)]
    assert sum(r.n for r in by_piece(batch, lambda part: pd.DataFrame({"n": [len(part)]}), "n long").collect()) == 10


def test_dense_topk_is_alike_in_blocks_of_queries(spark):
    rows = spark.range(60).select("id", F.array(*[F.sin(F.col("id") * k) for k in (1, 2, 3)]).alias("v"))
    find = lambda **bound: retrieval.dense_topk(rows.where("id % 5 = 0"), rows, 3, "id", "id", "v", **bound)
    got = [sorted(tuple(r) for r in find(**bound).collect()) for bound in ({}, {"most": 7})]  # all at once, and in six blocks
    assert got[0] == got[1] and len(got[0]) == 36
    assert find().where("false").count() == retrieval.dense_topk(rows.where("false"), rows, 3, "id", "id", "v").count() == 0


def test_bootstrap_skips_nulls_and_single_values(spark):
    from granary.operators.evaluation import bootstrap

    rows = spark.createDataFrame([("s", 1, 0, 1.0), ("s", 1, 1, None), ("s", 2, 0, 2.0), ("s", 2, 1, 2.0), (None, 3, 0, 1.0), (None, 3, 1, 1.0)], "s string, p int, k int, v double")
    assert sorted((r.s or "", r.n, r.best, r.worst_std) for r in bootstrap(rows, "s", "p", "v", "k", rounds=10).collect()) == [("", 2, 1.0, 0.0), ("s", 2, 2.0, 0.0)]
    assert bootstrap(rows.where("false"), "s", "p", "v", "k", rounds=10).count() == 0


def test_unit_vectors_returns_every_component(spark):
    import numpy as np

    from granary.plans.registry import QUERIES
    from granary.session import table

    rows = {r.vec_id: np.array(r.embedding, np.float64) for r in table(spark, "/root/testdata/sf0.001", "embeddings").where("embedding is not null").collect()}
    got = {r.vec_id: r["head"] for r in QUERIES["unit_vectors"](spark, "/root/testdata/sf0.001").collect()}
    assert got.keys() == rows.keys()
    for i, v in rows.items():
        assert len(got[i]) == len(v) == 64 and np.allclose(got[i], v / np.linalg.norm(v), atol=1e-6)


def test_notations_in_their_order(spark):
    """What the replacements do depends on their order; a bare percent sign stays."""
    cases = {r"\\!": "\\", "50%": "50%", r"50\%": "50", r"2\text{ cm}": "2", r"5\%\text{ of it}": "5", "k = 3": "3", "a=b=c": "a=b=c", "x=": "", ".5": r"\frac{1}{2}", "1/2": r"\frac{1}{2}", "01/2": "01/2", r"\tfrac12": r"\frac{1}{2}", r"\sqrt3": r"\sqrt{3}", r"\left(\frac{.1}2\right)": r"(\frac{0.1}2)", "90^\\circ": "90", r"\frac1{72}": r"\frac{1}{72}"}
    from granary.functions import math_text

    assert values(spark, list(cases), math_text.notation) == list(cases.values())


def test_scans_are_linear_and_equal_loops(spark):
    import numpy as np

    from granary.functions import scans, tokens
    from granary.operators import advantages

    rng = np.random.default_rng(3)
    rows = [(k, rng.normal(size=n).tolist(), rng.integers(0, 2, n).astype(float).tolist()) for k, n in enumerate([0, 1, 5, 8192, 8192, 300])] + [(9, None, None)]
    frame = spark.createDataFrame(rows, "k int, x array<double>, m array<double>")
    got = {r.k: r for r in frame.select("k", scans.reverse_scan(F.col("x"), 0.9).alias("a"), scans.reverse_scan(F.col("x"), 0.9, F.col("m")).alias("b"), scans.running_sum(F.col("x")).alias("c"), tokens.position_ids(F.col("m")).alias("p")).collect()}
    for k, x, m in rows:
        if x is None:
            assert got[k].a is got[k].b is got[k].c is None
            continue
        a, b = list(x), list(x)
        for t in range(len(x) - 2, -1, -1):
            a[t] += 0.9 * a[t + 1]
            b[t] += 0.9 * m[t + 1] * b[t + 1]
        assert np.allclose(got[k].a, a) and np.allclose(got[k].b, b) and np.allclose(got[k].c, np.cumsum(x))
        assert got[k].p == np.maximum(np.cumsum(m) - 1, 0).astype(int).tolist()
    tokens_ = spark.createDataFrame([(1, [1e8 + 1, 1e8 + 2, 5.0], [1.0, 1.0, 0.0]), (2, [1e8 + 3, 1e8 + 4, 7.0], [1.0, 1.0, 0.0])], "k int, x array<double>, m array<double>")
    white = [v for r in advantages.whiten_arrays(tokens_, "x", "m").orderBy("k").collect() for v in r.x[:2]]
    x = 1e8 + np.array([1.0, 2, 3, 4])
    mean = x.sum() / (4 + 1e-8)
    assert np.allclose(white, (x - mean) / np.sqrt(((x - mean) ** 2).sum() / (4 + 1e-8) * 4 / 3 + 1e-8), atol=1e-6)
    for mask in ([0.0, 0.0, 0.0], [1.0, 0.0, 0.0]):
        with pytest.raises(Exception, match="whitening"):
            advantages.whiten_arrays(spark.createDataFrame([(1, [1.0, 2.0, 3.0], mask)], "k int, x array<double>, m array<double>"), "x", "m").collect()


def test_end_tokens_of_several_kinds(spark):
    from granary.functions import tokens

    rows = spark.createDataFrame([([20, 10, 34, 1, 0, 0, 0],), ([78, 0, 76, 2, 1, 0, 0],), ([23, 98, 1, 0, 0, 0, 0],), ([33, 3, 98, 45, 1, 0, 0],), ([5, 6],)], "ids array<int>")
    assert [sum(r[0]) for r in rows.select(tokens.mask_to_eos(F.col("ids"), F.lit(1))).collect()] == [4, 5, 3, 5, 2]
    assert [sum(r[0]) for r in rows.select(tokens.mask_to_eos(F.col("ids"), [1, 2])).collect()] == [4, 4, 3, 5, 2]
    assert [r[0] for r in rows.select(tokens.remove_pad(F.col("ids"), F.transform("ids", lambda x: x % 2))).collect()][3:] == [[33, 3, 45, 1], [5]]


def test_small_operators_at_their_edges(spark):
    from granary.functions import grading, records, tokens
    from granary.operators import balance, selection

    calls = spark.createDataFrame([('{"a": 1, "b": "x"}',), ("[1]",), ("{",), (None,), ("{}",)], "c string")
    assert [(r.c.arguments, r.c.failed) for r in calls.select(records.tool_call(F.col("c")).alias("c")).collect()] == [({"a": "1", "b": "x"}, False), ({}, True), ({}, True), ({}, True), ({}, False)]
    docs = spark.createDataFrame([(["T\nline\nmore", "only"],), ([],)], "d array<string>")
    assert [r[0] for r in docs.select(records.passages(F.col("d"))).collect()] == ["Doc 1 (Title: T)\nline\nmore\n\nDoc 2 (Title: only)", ""]
    rates = spark.createDataFrame([([1, 1, -1, -2],), ([],), (None,)], "s array<int>")
    assert [tuple(r) for r in rates.select(grading.pass_rate(F.col("s")), grading.pass_rate(F.col("s"), 2)).collect()] == [(0.5, 1.0), (None, None), (None, None)]
    logs = spark.createDataFrame([([None, -1.0], None, None, None), (None, [{"x": -2.0, "y": -1.0}, {"y": -3.0}], ["x", "z"], None), (None, [], None, [-4.0, None]), ([], None, None, None)], "l array<double>, s array<map<string,double>>, t array<string>, z array<double>")
    got = [r[0] for r in logs.select(tokens.chosen_logps(*[F.col(c) for c in "lstz"])).collect()]
    assert got == [[-1.0], [-2.0, -3.0], [-4.0], []]
    uneven = spark.createDataFrame([(1, [1], [2]), (2, [1], [2, 3]), (3, None, [1]), (4, [], [])], "k int, a array<int>, b array<int>")
    assert [r.k for r in selection.drop_uneven(uneven, "a", "b").orderBy("k").collect()] == [1, 4]
    assert [sum((5, 5, 4, 4)[i] for i in p) for p in balance.balanced([5, 5, 4, 4], 2)] == [9, 9]
    for wrong in (([1], 2, False), ([1, 2, 3], 2, True)):
        with pytest.raises(ValueError):
            balance.balanced(*wrong)
    assert spark.range(1).select(tokens.clip(F.lit(5), F.lit(1), F.lit(3)), tokens.clip(F.lit(0), F.lit(1), F.lit(3))).first()[:] == (3, 1)


def brute_partition(lengths, parts):
    """The smallest possible largest sum."""
    best = [sum(lengths)]

    def place(at, loads):
        if max(loads) >= best[0]:
            return
        if at == len(lengths):
            best[0] = max(loads)
            return
        for p in range(parts):
            place(at + 1, [x + lengths[at] * (q == p) for q, x in enumerate(loads)])

    place(0, [0] * parts)
    return best[0]


def test_partitions_against_brute_force():
    """Differencing and the least loaded are near the best possible, and keep every item once."""
    import random

    from granary.operators import balance

    rng = random.Random(2)
    for _ in range(40):
        lengths = [rng.randrange(1, 60) for _ in range(rng.randrange(4, 9))]
        parts = rng.randrange(2, 4)
        best = brute_partition(lengths, parts)
        largest = lambda found: max(sum(lengths[i] for i in p) for p in found)
        assert best <= largest(balance.balanced(lengths, parts)) <= best * 4 / 3 + 1
        greedy = balance.least_loaded(lengths, parts)
        assert sorted(i for p in greedy for i in p) == list(range(len(lengths))) and best <= largest(greedy) <= 2 * best
        small = balance.micro_batches(lengths, 60)
        assert sorted(i for p in small for i in p) == list(range(len(lengths)))
    assert balance.least_loaded([3, 3, 3, 1], 2) == [[0, 2], [1, 3]]  # ties go to the partition of the smaller number


def test_batches_that_do_not_fit_are_errors(spark):
    from granary.functions import tokens
    from granary.operators import batch
    from granary.streaming.state import accumulate

    rows = spark.range(12).withColumnRenamed("id", "row_id")
    for wrong in (lambda: batch.concat([rows, rows.withColumn("more", F.lit(1))]), lambda: batch.chunk(rows, 5, even=True)):
        with pytest.raises((KeyError, ValueError)):
            wrong()
    with pytest.raises(Exception, match="more than 2 tokens"):
        spark.range(1).select(tokens.truncate(F.array(F.lit(1), F.lit(2), F.lit(3)), 2, "error")).collect()
    dealt = batch.minibatches(rows, 4, epochs=2, seed=3).collect()
    for epoch in range(2):
        assert sorted(r.row_id for r in dealt if r.epoch == epoch) == list(range(12))
        assert sorted(r.batch_id for r in dealt if r.epoch == epoch) == [0] * 4 + [1] * 4 + [2] * 4
    orders = [[r.row_id for r in sorted(dealt, key=lambda r: (r.batch_id, r.row_id)) if r.epoch == e] for e in range(2)]
    assert orders[0] != orders[1] and sorted(map(tuple, dealt)) == sorted(map(tuple, batch.minibatches(rows.repartition(5), 4, epochs=2, seed=3).collect()))
    arrivals = spark.createDataFrame([(k, 10) for k in range(5)], "k int, n int")
    assert [r.full for r in accumulate(arrivals, "n", 30, "k", 4).orderBy("k").collect()] == [False, False, True, False, False]
    with pytest.raises(Exception, match="too few prompts"):
        accumulate(arrivals, "n", 100, "k", 4).collect()


def odd_embeddings(spark, folder, rows):
    """Vectors that begin with the given numbers and end in ones, as a table; None stays None."""
    full = [(k, None if v is None else [*v, *[1.0] * (64 - len(v))], label) for k, (v, label) in enumerate(rows)]
    spark.createDataFrame(full, "vec_id long, embedding array<float>, label int").coalesce(1).write.parquet(f"{folder}/embeddings.parquet")


def equals_statement(spark, folder, name, source):
    """Query and statement by their rows' texts, which tell -0.0 from 0.0 and take NaN for equal."""
    import duckdb

    from granary.plans.registry import ORACLES, QUERIES

    con = duckdb.connect()
    con.execute(f"CREATE VIEW {source} AS SELECT * FROM '{folder}/{source}.parquet/*.parquet'")
    got = QUERIES[name](spark, str(folder))
    found = con.execute(ORACLES[name])
    assert got.columns == [c[0] for c in found.description]
    assert sorted(repr(tuple(r)) for r in got.collect()) == sorted(map(repr, found.fetchall()))


def test_unit_vectors_keeps_signs_of_zero_and_zero_vectors(spark, tmp_path):
    odd = [-1e-9, 1e-9, -0.0, 0.0, -4e-6, 4e-6, -0.0625]
    odd_embeddings(spark, tmp_path, [(odd, 3), ([0.0] * 64, 1), ([-0.0] * 64, 1), (None, 2), ([math.nan], 2), ([-math.inf, 2.0], 2), ([1e30, -1e30], None)])
    equals_statement(spark, tmp_path, "unit_vectors", "embeddings")


def test_rank_slice_keeps_signs_of_zero_and_null_vectors(spark, tmp_path):
    share = [-1e-9, 1e-9, -0.0, 0.0, -4e-6, None, math.nan, -math.inf]
    odd_embeddings(spark, tmp_path, [([1.0] * 22 + share, 1), (None, 2), ([0.0] * 64, None)])
    equals_statement(spark, tmp_path, "rank_slice", "embeddings")


def test_select_tokens_keeps_signs_of_zero_and_missing_tokens(spark, tmp_path):
    odd = [-1e-9, 1e-9, -0.0, 0.0, -4e-6, None, math.nan, -math.inf]
    odd_embeddings(spark, tmp_path, [(odd, label) for label in (-1, 0, 1, 8, 16, 18, None)] + [(None, 2), (None, 0), (None, None)])
    equals_statement(spark, tmp_path, "select_tokens", "embeddings")


def test_log_parse_of_halves_nulls_and_signs_of_zero(spark, tmp_path):
    """515.7185 lies so that 1,000 times it falls below the half, unlike its decimal digits."""
    odd = [515.7185, 4.0295, 1.0005, -0.0004, -0.0, 1e20 / 7, 1.7e308, math.nan, math.inf, -math.inf, None]
    rows = [*((3 * k + 1, v) for k, v in enumerate(odd)), (0, None), (3, 1.0), (-3, 1.0), (None, 2.5), (None, None)]
    spark.createDataFrame(rows, "event_id long, value double").coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    equals_statement(spark, tmp_path, "log_parse", "events")
