"""Corpus pipeline: five training-data operators applied one after another.

Each stage takes (spark, docs, sf_dir) and returns the documents that it keeps, with
the columns of documents; the last one returns them with their shards. run() writes
each stage's rows as Parquet to the shared folder and reads them back for the next.

Null ids, texts and sources, repeated rows, empty tables and extra columns pass
through as the stages' operators define; a document without an id is told apart by
its text.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession

from lodestone.llm import decontaminate, mixing, near_dedup, sharding, toxicity
from lodestone.llm.common import collected, drop_paths, new_path, release, remove, saved, table

#: Scratch tables of the stage before, dropped when the next one starts: its rows are
#: written by then.
_scratch: list[str] = []


def _stage(function):
    @functools.wraps(function)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        drop_paths(spark, _scratch)
        release(spark)
        with collected(_scratch):
            return function(spark, docs, sf_dir)

    return run_stage


@_stage
def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that nearest labelled examples score at 0.5 or more go."""
    return toxicity.without_toxic(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


@_stage
def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    return near_dedup.without_near_copies(docs)


@_stage
def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that overlap a benchmark item go."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


@_stage
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of its source takes it."""
    return mixing.mixed(docs)


@_stage
def write_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents in compacted shards, read back with the shard of each row."""
    return sharding.shard(docs, new_path(spark, "shards"))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_copies),
    ("decontaminate", drop_leaks),
    ("mix", mix_sources),
    ("shards", write_shards),
]

#: The stages learn from labels, hash and iterate: SQL cannot express them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs, last = saved(stage(spark, docs, sf_dir), f"stage-{name}"), docs
        remove(last)  # nothing for the table that the run starts from
    drop_paths(spark, _scratch)
    return docs
