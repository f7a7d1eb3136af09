"""The corpus pipeline: five operators in turn, each over all that its predecessor kept.

1. toxicity      drops the documents whose score reaches the threshold
2. exact_dedup   of equal texts keeps the row with the largest doc_id
3. near_dedup    of each SimHash component keeps the row with the smallest doc_id
4. mixing        repeats or leaves out documents so that each source meets its target
5. bpe           encodes the mix: doc_id, n_tokens, ids and digests, a row per copy

Defined results: a null text is an empty text, which scores the rate of the toxic
class, equals other empty texts, has fingerprint zero and no tokens; a null id is
smaller than any id for stage 2 and larger for stage 3; of rows with equal ids and
texts the hash of all columns decides; a null source is a source; further columns,
whatever their names, pass through all stages but the last; an empty table gives
an empty result, and without labels no document goes in stage 1.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from granary.llm import bpe, exact_dedup, mixing, simhash, toxicity
from granary.session import shared_folder, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.keep_clean(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.keep_rows(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_rows(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.encode_decode(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("toxicity", drop_toxic), ("exact_dedup", drop_copies), ("near_dedup", drop_near_copies), ("mixing", mix_sources), ("bpe", encode)]

#: The first stage's trained model is beyond SQL; tests/llm/test_pipeline.py holds each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; each is written to the shared folder and read again."""
    folder = f"{shared_folder(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}-{name}")
        docs = spark.read.parquet(f"{folder}/{k}-{name}")
        if k:
            _remove(spark, f"{folder}/{k - 1}-{STAGES[k - 1][0]}")
    return docs


def _remove(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
