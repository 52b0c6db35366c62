"""A corpus from raw documents to token ids, in stages that each write what they keep.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; `run` writes it as Parquet in
the shared folder and hands what it reads back to the next stage. All stages but the last
return the columns that they were given. Documents that fail the quality rules go; of near
duplicates (five-word shingles, Jaccard similarity 0.8 or more) the one with the smallest id
stays; documents with a benchmark passage go; sources
are mixed to their targets, where a document may come twice; the rest is encoded into a
content-addressed store, of which one row for each document is returned.
"""

from __future__ import annotations

from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from sonde.functions.staging import Steps
from sonde.llm import decontaminate, mixing, quality_rules, scratch, simhash, token_store


#: Workers that ran other stages before have less room for words than a store of its own.
KNOWN_WORDS = 150_000
_STEPS = Steps()


def _step(function):
    """The stage, which first removes what the stage before kept for itself on disk."""

    @wraps(function)
    def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        return _STEPS.run(function, spark, docs, sf_dir)

    return stage


@_step
def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.keep_good(docs)


@_step
def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_one_of_similar(docs)


@_step
def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text")
    return decontaminate.keep_clean(docs, items)


@_step
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed(docs)


@_step
def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return token_store.tokenized(docs, token_store.word_bpe(), known_words=KNOWN_WORDS)


STAGES = [
    ("quality_rules", quality),
    ("simhash_near_dedup", near_dedup),
    ("benchmark_decontamination", decontamination),
    ("source_mixing", mix_sources),
    ("token_store", encode),
]
#: The fingerprints, the sampling and the tokenizer have no counterpart in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        docs = scratch.save(stage(spark, docs, sf_dir), name)
        if last is not None:
            scratch.drop(last)
        last = docs
    return docs
