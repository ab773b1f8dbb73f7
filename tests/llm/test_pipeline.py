"""The corpus pipeline on small tables."""

import gc
import random
import weakref

import pytest

import corpus_pipeline

from .test_operators import AWKWARD, docs, sentence


@pytest.fixture()
def tables(spark, tmp_path):
    def write(rows, name):
        base = f"{tmp_path}/{name}"
        docs(spark, rows).select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{base}/documents.parquet")
        r = random.Random(4)
        spark.createDataFrame([(0, sentence(r, 30))], "item_id long, text string").write.parquet(f"{base}/benchmark.parquet")
        labels = [(i, 0, int(i % 5 == 0)) for i, *_ in rows if i is not None and i < 300]
        spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{base}/labels.parquet")
        return base

    return write


def test_pipeline(spark, tables):
    r, rows = random.Random(7), []
    for i in range(300):
        words = sentence(r, 40).split()
        if i % 5 == 0:
            words[3] = words[20] = "wretch"
        rows.append((i, " ".join(words), "en", f"s{i % 3}"))
    leak = sentence(random.Random(4), 30)
    rows += [(400, rows[1][1] + " tail", "en", "s1"), (401, f"{sentence(r, 10)} {leak}", "en", "s1")]
    base = tables(rows + [(i and i + 1000, *rest) for i, *rest in AWKWARD], "full")
    frame = spark.read.parquet(f"{base}/documents.parquet")
    cols, seen = frame.columns, {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        frame = corpus_pipeline.saved(stage(spark, frame, base), name)
        seen[name] = {x["doc_id"] for x in frame.select("doc_id").collect()}
        assert k == len(corpus_pipeline.STAGES) - 1 or frame.columns == cols
    clean = {i for i in range(300) if i % 5}
    assert not {i for i in range(0, 300, 5)} & seen["toxicity"] and clean <= seen["toxicity"]
    assert 400 not in seen["near_dedup"] and clean <= seen["near_dedup"]
    assert 401 not in seen["decontaminate"] and clean <= seen["decontaminate"]
    assert seen["shards"] == seen["mix"] and len(seen["mix"]) > 150
    assert frame.where("shard is null").count() == 0


def test_stages_start_without_what_the_last_one_left(spark):
    class Node:
        pass

    left = []

    @corpus_pipeline._stage
    def one(spark, docs, sf_dir):
        node = Node()
        node.self = node  # a cycle, as data frames and their sessions make
        left.append(weakref.ref(node))
        return docs

    @corpus_pipeline._stage
    def two(spark, docs, sf_dir):
        assert left[0]() is None
        return docs

    gc.disable()
    try:
        two(spark, one(spark, None, ""), "")
    finally:
        gc.enable()


def test_pipeline_on_empty_tables(spark, tables):
    assert corpus_pipeline.run(spark, tables([], "none")).count() == 0
