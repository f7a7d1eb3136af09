import hashlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from test_dedup import brute_fingerprint, components
from test_text import brute_targets
from tokenizers import Tokenizer

import corpus_pipeline
from granary.llm import toxicity

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark, tmp_path_factory):
    """Each stage's input and output on the whole smallest table."""
    folder, docs, out = tmp_path_factory.mktemp("steps"), spark.read.parquet(f"{SF}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        made = stage(spark, docs, SF)
        if name != "bpe":
            assert made.columns == docs.columns
        made.write.parquet(str(folder / name))
        made = spark.read.parquet(str(folder / name))
        out[name] = docs.collect(), made.collect()
        docs = made
    return out


def same(rows):
    return Counter(map(tuple, rows))


def test_toxic_documents_go(spark, steps):
    before, after = steps["toxicity"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = toxicity.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    scorer = model.scorer()
    assert same(after) == same(r for r in before if scorer.score(r.text or "") < toxicity.THRESHOLD)


def test_one_of_equal_texts_stays(steps):
    before, after = steps["exact_dedup"]
    largest = defaultdict(int)
    for r in before:
        largest[r.text] = max(largest[r.text], r.doc_id)
    assert same(after) == same(r for r in before if largest[r.text] == r.doc_id)


def test_one_of_each_component_stays(steps):
    before, after = steps["near_dedup"]
    fp = {r.doc_id: brute_fingerprint(r.text) for r in before}
    ids = sorted(fp)
    root = components(ids, [(a, b) for a in ids for b in ids if a < b and (fp[a] ^ fp[b]).bit_count() <= 3])
    assert same(after) == same(r for r in before if root[r.doc_id] == r.doc_id)


def test_sources_meet_their_targets(steps):
    before, after = steps["mixing"]
    size = {r.doc_id: len((r.text or "").encode().split()) for r in before}
    sizes, taken, longest = Counter(), Counter(), Counter()
    for r in before:
        sizes[r.source] += size[r.doc_id]
        longest[r.source] = max(longest[r.source], size[r.doc_id])
    for r in after:
        taken[r.source] += size[r.doc_id]
    assert set(map(tuple, after)) <= set(map(tuple, before)) and max(same(after).values()) <= 2
    for source, target in brute_targets(sizes).items():
        assert abs(taken[source] - target) <= longest[source]


def test_the_mix_is_encoded(steps):
    before, after = steps["bpe"]
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = Counter()
    for r in before:
        ids = np.array(tokenizer.encode(r.text or "", add_special_tokens=False).ids, "<u4").tobytes()
        want[r.doc_id, len(ids) // 4, ids, hashlib.sha256(ids).hexdigest()] += 1
    assert Counter((r.doc_id, r.n_tokens, bytes(r.ids), r.ids_sha256) for r in after) == want
    assert all(r.round_trip for r in after)


def test_run_is_the_stages_in_turn(spark, steps):
    assert same(corpus_pipeline.run(spark, SF).drop("ids").collect()) == Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256, r.round_trip) for r in steps["bpe"][1])


def test_odd_rows_pass_all_stages(spark, odd, odd_rows, tmp_path):
    """Nulls in any column, repeated rows, ties and clashing names; each stage as stated."""
    frame = odd.withColumnsRenamed({"shard": "file", "size": "src", "row": "index"})
    frame.repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    labels = spark.createDataFrame([(r[0], int(r[0] % 7 == 0)) for r in odd_rows if r[0] is not None], "doc_id long, toxic int")
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        made = stage(spark, docs, str(tmp_path))
        assert made.columns == docs.columns or k == 4
        made.write.parquet(str(tmp_path / str(k)))
        before, docs = docs, spark.read.parquet(str(tmp_path / str(k)))
        if k == 1:
            texts = Counter(r.text or "" for r in docs.collect())
            assert set(texts) == {r.text or "" for r in before.collect()} and max(texts.values()) == 1
        elif k == 2:
            fp = [brute_fingerprint(r.text) for r in before.collect()]
            root = components(set(fp), [(a, b) for a in set(fp) for b in set(fp) if a < b and (a ^ b).bit_count() <= 3])
            assert docs.count() == len(set(root.values())) and docs.exceptAll(before).count() == 0
        elif k == 3:
            assert set(map(tuple, docs.collect())) <= set(map(tuple, before.collect()))
    assert docs.count() == before.count() > 0
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == docs.count()


def test_empty_tables_pass_all_stages(spark, empty, tmp_path):
    empty.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
