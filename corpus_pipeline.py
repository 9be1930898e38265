"""The corpus pipeline: quality rules, near-dedup, mixing of sources, BPE encoding.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and
read again as the next stage's docs.  All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from weftline.llm import bpe_automaton, mixing, quality_rules, shingle_sets
from weftline.llm.common import discard, read_table, saved, scratch_path, scratch_scope


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base checks or the learned rules go."""
    return quality_rules.stage(spark, docs, sf_dir)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (operator 9 over five-word shingles, a similarity of 0.8 by
    their sets) the document with the smallest doc_id stays."""
    return shingle_sets.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeat or go so that sources come near their target weights."""
    return mixing.mix(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token identifiers of every document, with digests of them and of the decoded text."""
    return bpe_automaton.encode(docs, keep=["doc_id", "source"])


STAGES = [
    ("quality_rules", quality),
    ("simhash_near_dedup", near_dedup),
    ("source_mixing", mix_sources),
    ("bpe_encoding", encode),
]

#: Learned rules, near duplicates and balanced draws are beyond SQL; tests use plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other; what a stage wrote goes once the next has been written."""
    docs, before = read_table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        path = scratch_path(spark, f"stage-{name}")
        with scratch_scope(spark):
            docs = saved(stage(spark, docs, sf_dir), name, path)
        if before:
            discard(spark, before)
        before = path
    return docs
