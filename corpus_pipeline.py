"""The corpus pipeline: from documents to token ids, each stage an operator of patchloom.llm."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from patchloom.llm import bpe, mixing, quality_rules, simhash, substrings
from patchloom.llm.common import read, table
from patchloom.llm.queries import vocabulary_path


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules, judged against the trusted ones among them."""
    model = quality_rules.fit(docs, quality_rules.trusted_ids(read(spark, sf_dir, "labels")))
    # whole rows travel as one column, so that no column of theirs clashes with the rules' own
    return quality_rules.judge(docs.select(F.struct("*").alias("_doc"), "doc_id", "text"), model).where("kept").select("_doc.*")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash component."""
    return simhash.keep_one(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that earlier documents have."""
    return substrings.remove(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as many times as the mix takes them."""
    return mixing.apply(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, the digests of ids and decoded text, and the ids, joined by spaces."""
    return bpe.encode(docs, vocabulary_path(), add=("ids",))


STAGES = [
    ("quality rules", quality),
    ("near-duplicates", near_dedup),
    ("substring dedup", substring_dedup),
    ("source mixing", mix),
    ("BPE encoding", encode),
]
#: SQL expresses neither chaining nor dependent rounding; tests/llm/test_pipeline.py holds run() against a plain Python version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = table(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
