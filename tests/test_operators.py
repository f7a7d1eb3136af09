"""Expectations stated as literals, invariants, and brute force where SQL has no statement."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from granary.functions import answers as A
from granary.functions import math_text, preference, sequences
from granary.operators import advantages, balance, batch, evaluation, scoring
from granary.sources import files
from granary.streaming import state


def numbered(spark, values, kind="int"):
    return spark.createDataFrame(list(enumerate(values)), f"row_id long, obs {kind}")


def order(frame, column="obs"):
    return [r[0] for r in frame.orderBy("row_id").select(column).collect()]


def test_repeats_and_padding(spark):
    rows = numbered(spark, [1, 2, 3])
    assert order(batch.repeat(rows, 2)) == [1, 1, 2, 2, 3, 3]
    assert order(batch.repeat(rows, 2, interleave=False)) == [1, 2, 3, 1, 2, 3]
    padded = batch.pad_to_divisor(rows, 7)
    assert order(padded) == [1, 2, 3, 1, 2, 3, 1] and order(batch.unpad(padded)) == [1, 2, 3]
    assert order(batch.pad_with(rows, 2)) == [1, 2, 3, 3, 3] and order(batch.pad_with(rows, 2, first=True)) == [1, 2, 3, 1, 1]
    times = spark.createDataFrame([(0, 1, 3), (1, 2, 1), (2, 3, 2)], "row_id long, obs int, n int")
    assert [r.obs for r in batch.sample_repeat(times, "n").orderBy("row_id", "sample_id").collect()] == [1, 1, 1, 2, 3, 3]
    assert batch.pad_to_divisor(rows.limit(0), 4).count() == 0


@pytest.mark.parametrize("at", [(1, 5, 2), (-4, None, 1), (None, None, -2), (8, 2, -3), (0, 0, 1), (5, 100, 1)])
def test_slices_are_python_slices(spark, at):
    values = list(range(10))
    assert order(batch.take_slice(numbered(spark, values), *at)) == values[slice(*at)]


def test_union_checks_its_sides(spark):
    left, right = numbered(spark, [1, 2]), numbered(spark, [1, 2]).withColumn("more", F.lit(5))
    assert batch.union(left, right).count() == 2
    for wrong in (numbered(spark, [1, 3]), numbered(spark, [1, 2, 3])):
        with pytest.raises(Exception, match="differ"):
            batch.union(left, wrong).collect()
    with pytest.raises(KeyError):
        batch.pop(left, "none")
    with pytest.raises(ValueError):
        batch.minibatches(left, 3)


def test_row_ids_are_dense_over_partitions(spark):
    values = random.Random(1).sample(range(1000), 300)
    frame = batch.with_row_id(spark.createDataFrame([(v,) for v in values], "v int").repartition(7), "v")
    assert [(r.row_id, r.v) for r in frame.orderBy("v").collect()] == list(enumerate(sorted(values)))


def test_groups_of_one_and_equal_scores(spark):
    rows = spark.createDataFrame([(1, 0, 5.0), (2, 0, 3.0), (2, 1, 3.0)], "uid int, sample_id int, score double")
    got = {(r.uid, r.sample_id): r.advantage for r in advantages.grpo(rows).collect()}
    assert got[1, 0] == pytest.approx(5 / (1 + 1e-6)) and got[2, 0] == got[2, 1] == 0
    assert [r.uid for r in advantages.filter_variance(rows).collect()] == [1]
    with pytest.raises(Exception, match="two samples"):
        advantages.passk(rows, "sample_id").collect()


def test_gae_against_a_loop(spark):
    r, v = [0.5, -1.0, 2.0], [0.1, 0.2, 0.3]
    carry, want = 0.0, []
    for t in (2, 1, 0):
        delta = r[t] + 0.9 * (v[t + 1] if t < 2 else 0) - v[t]
        carry = delta + 0.9 * 0.7 * carry
        want.insert(0, carry)
    frame = spark.createDataFrame([(r, v)], "r array<double>, v array<double>")
    assert frame.select(advantages.gae(F.col("r"), F.col("v"), 0.9, 0.7)).first()[0] == pytest.approx(want)


def test_partitions_cover_and_balance():
    rng = random.Random(2)
    for _ in range(50):
        parts = rng.randrange(1, 6)
        lengths = [rng.randrange(1, 100) for _ in range(parts * rng.randrange(1, 9))]
        spread = lambda p: max(sum(lengths[i] for i in x) for x in p) - min(sum(lengths[i] for i in x) for x in p)
        for equal in (False, True):
            made = balance.differencing(lengths, parts, equal)
            assert sorted(i for p in made for i in p) == list(range(len(lengths)))
            assert not equal or len({len(p) for p in made}) == 1
        assert spread(balance.differencing(lengths, parts)) <= max(spread(balance.least_loaded(lengths, parts)), max(lengths))
        for p in balance.micro_batches(lengths, 150):
            assert p


def test_bootstrap_against_numpy(spark):
    rng = random.Random(5)
    rows = [("s", f"p{p}", i, rng.choice("ab"), rng.random()) for p, n in enumerate((2, 5, 8)) for i in range(n)]
    frame = spark.createDataFrame(rows, "source string, prompt string, pos int, pred string, value double")
    got = {r.n: r for r in evaluation.bootstrap(frame, "source", "prompt", "value", "pos", "pred", rounds=100).collect()}
    want = {}
    for p in range(3):
        own = [r for r in rows if r[1] == f"p{p}"]
        for n in evaluation.sizes_below(len(own)):
            np.random.seed(42)
            best, worst, maj = [], [], []
            for _ in range(100):
                drawn = [own[i] for i in np.random.choice(len(own), n, replace=True)]
                best.append(max(r[4] for r in drawn))
                worst.append(min(r[4] for r in drawn))
                names = [r[3] for r in drawn]
                top = max(names, key=lambda x: (names.count(x), -names.index(x)))
                maj.append(drawn[names.index(top)][4])
            want.setdefault(n, []).append([f(x) for x in (best, worst, maj) for f in (np.mean, np.std)])
    assert set(got) == set(want)
    for n, found in want.items():
        r = got[n]
        assert [r.best, r.best_std, r.worst, r.worst_std, r.maj, r.maj_std] == pytest.approx(np.mean(found, axis=0).tolist())


def test_answers(spark):
    texts = {
        '<answer>```json\n{"answer": [1, "1,000", "A b!", true]}\n```</answer>': [(1.0, None), (1000.0, None), (None, "ab"), (1.0, None)],
        '{"answer": "x"}': [(None, "x")],
        '{"answer": [[1]]}': [],
        "```json\n{\"answer\": [}\n```": None,
        "": None,
        '{"answer": ["é"]}': [(None, "")],
    }
    frame = spark.createDataFrame([(t,) for t in texts], "text string")
    got = {r.text: r.made for r in A.with_answers(frame, "text", "made").collect()}
    for text, want in texts.items():
        assert (got[text] if got[text] is None else [tuple(x) for x in got[text]]) == want, text


def test_files_and_metrics(spark, tmp_path):
    for k in range(3):
        spark.createDataFrame([(10 * k + i,) for i in range(4)], "v int").coalesce(1).write.parquet(str(tmp_path / f"p{k}"))
    whole = files.parquet_in_order(spark, *(str(tmp_path / f"p{k}") for k in (2, 0, 1)))
    assert order(whole, "v") == [20, 21, 22, 23, 0, 1, 2, 3, 10, 11, 12, 13]
    assert order(files.percent_slice(whole, None, 75), "v") == [20, 21, 22, 23, 0, 1, 2, 3, 10]
    assert order(files.percent_slice(whole, -25, None), "v") == [11, 12, 13]
    files.write_steps(spark.createDataFrame([(1, "a"), (2, "b")], "step int, output string"), str(tmp_path / "steps"))
    assert files.jsonl(spark, str(tmp_path / "steps" / "step=2"), "output string").collect()[0].output == "b"
    nested = spark.createDataFrame([((1, (2,)),)], "a struct<b:int,c:struct<d:int>>")
    assert files.flattened(nested).columns == ["a/b", "a/c/d"]


def test_blocklist_stream(spark, tmp_path):
    schema = "uid int, sample_id int, score double"
    steps = [[(1, 0, 1.0), (1, 1, 1.0), (2, 0, 0.5), (2, 1, 0.2)], [(1, 0, 0.3), (1, 1, 0.4), (3, 0, 0.9), (3, 1, 0.85)]]
    step = state.blocklist_step(str(tmp_path / "blocked"), str(tmp_path / "out"), 0.99, 0.8, 0.0)
    for k, rows in enumerate(steps):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = state.read_stream(spark, str(tmp_path / "in"), schema).writeStream.foreachBatch(step).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        stream.awaitTermination()
    kept = {(r.batch, r.uid) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert kept == {(0, 2)}  # 1 persists and stays blocked although its later mean is low, 3 is above the upper bound
    assert {r.uid for r in spark.read.parquet(str(tmp_path / "blocked")).collect()} == {1}


def test_mathematical_answers(spark):
    boxes = {"a \\boxed{1} \\boxed{\\frac{a}{b^{2}}} z": "\\frac{a}{b^{2}}", "\\fbox{}": "", "\\boxed{open": None, "none": None, "\\boxed 5": None}
    frame = spark.createDataFrame([(t,) for t in boxes], "t string")
    assert {r.t: r.b for r in frame.select("t", math_text.boxed(F.col("t")).alias("b")).collect()} == boxes
    pairs = [("0.5", "\\frac12", True), ("x=7", "7", True), ("\\sqrt3", "\\sqrt{3}", True), ("\\dfrac{1}{2}", "1/2", True), ("50\\%", "50", True), ("1,000", "1000", True), ("0.07", "7", True), ("8", "7", False), ("a", "b", False), (".5", "0.5", True)]
    frame = spark.createDataFrame(pairs, "a string, b string, want boolean")
    assert all(r.got == r.want for r in frame.select("want", math_text.equal(F.col("a"), F.col("b")).alias("got")).collect())


def test_scorers(spark):
    scorers = scoring.Scorers()
    scorers.register("math", "aime*")(lambda a, t: (a == t).cast("double"))
    rows = spark.createDataFrame([("math", "1", "1"), ("aime24", "2", "1")], "source string, a string, t string")
    assert sorted(r.score for r in scoring.apply(rows, scorers, "source", "a", "t").collect()) == [0.0, 1.0]
    given = rows.withColumn("rm_scores", F.lit(0.25))
    assert {r.score for r in scoring.apply(given, scorers, "source", "a", "t").collect()} == {0.25}
    with pytest.raises(Exception, match="no scorer"):
        scoring.apply(rows.withColumn("source", F.lit("other")), scorers, "source", "a", "t").collect()
    divide = scoring.guarded(lambda a, t: int(a) / (int(t) - 1))
    assert {r[0] for r in rows.select(divide("a", "t")).collect()} == {0.0}
    wide = scoring.expand(rows.withColumn("r", F.struct(F.lit(1.0).alias("score"), F.lit(2).alias("len"))), "r", ["score", "len"])
    assert wide.columns == ["source", "a", "t", "score", "len"]


def test_losses_are_stable_and_checked(spark):
    frame = spark.createDataFrame([(-1000.0, 1000.0)], "a double, b double")
    row = frame.select(preference.dpo_loss(F.col("a"), F.col("b"), 1.0), preference.dpo_loss(F.col("b"), F.col("a"), 1.0)).first()
    assert row[0] == pytest.approx(2000) and row[1] == pytest.approx(0)
    with pytest.raises(ValueError):
        preference.dpo_loss(F.col("a"), F.col("b"), 1.0, "other")
    assert sequences.kl_controller([0.2, 0.0], 100, 0.1, 1000, 1.0) == pytest.approx([1.02, 1.02 * 0.98])


def test_val_bootstrap_has_the_reference_resamples(spark):
    """The registered query, against 1,000 resamples drawn with seed 42."""
    from granary.plans.catalog import votes
    from granary.plans.registry import QUERIES

    groups = {}
    for r in votes(spark, "/root/testdata/sf0.001").where("value is not null").collect():
        groups.setdefault((r.prompt, r.day), []).append((r.pos, r.value))
    met = {}
    for rows in groups.values():
        values = np.array([v for _, v in sorted(rows)])
        for n in evaluation.sizes_below(len(values)) if len(values) > 1 else []:
            np.random.seed(42)
            met.setdefault(n, []).append(np.mean([values[np.random.choice(len(values), n, replace=True)].max() for _ in range(1000)]))
    got = {r.n: r.best for r in QUERIES["val_bootstrap"](spark, "/root/testdata/sf0.001").collect()}
    assert got.keys() == met.keys()
    assert all(got[n] == pytest.approx(np.mean(found), rel=1e-9) for n, found in met.items())


@pytest.mark.parametrize("name", ["kk_equal_size", "balanced_reorder"])
def test_even_partitions_take_every_rollout(spark, name):
    """All rows of every batch, four partitions whatever its size, and sizes that differ by at most one."""
    from granary.plans.catalog import rollouts
    from granary.plans.registry import QUERIES

    rows = {r.uid * 100 + r.sample_id: (r.uid // 100, r.length) for r in rollouts(spark, "/root/testdata/sf0.001").collect()}
    found = QUERIES[name](spark, "/root/testdata/sf0.001").collect()
    assert sorted(r["item"] for r in found) == sorted(rows)
    held = {}
    for r in found:
        assert rows[r["item"]][0] == r.batch
        held.setdefault(r.batch, [[], [], [], []])[r.part].append(rows[r["item"]][1])
    for parts in held.values():
        sizes, sums = [len(p) for p in parts], [sum(p) for p in parts]
        assert max(sizes) - min(sizes) <= 1 and max(sums) - min(sums) <= max(map(max, parts))


def test_even_partitions_of_any_number():
    rng = random.Random(4)
    for n in range(30):
        made = balance.differencing_even([rng.randrange(0, 3) for _ in range(n)], 4)
        assert sorted(i for p in made for i in p) == list(range(n)) and max(map(len, made)) - min(map(len, made)) <= 1


def test_dense_topk_searches_all_rows(spark):
    """The registered query, against every inner product of the table."""
    from granary.plans.registry import QUERIES
    from granary.session import table

    rows = sorted((r.vec_id, r.embedding) for r in table(spark, "/root/testdata/sf0.001", "embeddings").where("embedding is not null").collect())
    ids, vectors = [i for i, _ in rows], np.array([v for _, v in rows], np.float64)
    want = {}
    for i, v in zip(ids, vectors, strict=True):
        if i % 50 == 0:
            want[i] = sorted(zip((-(vectors @ v)).tolist(), ids, strict=True))[:3]
    got = {}
    for r in sorted(QUERIES["dense_topk"](spark, "/root/testdata/sf0.001").collect(), key=lambda r: r["rank"]):
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert {q: [i for i, _ in found] for q, found in got.items()} == {q: [i for _, i in found] for q, found in want.items()}
    assert all(s == pytest.approx(-w, abs=1e-6) for q in got for (_, s), (w, _) in zip(got[q], want[q], strict=True))
