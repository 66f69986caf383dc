"""The pipeline's stages, each on what the one before kept."""

import hashlib
import os
import types

import pytest

import corpus_pipeline
from tidemark.llm import decontaminate, quality, shared, toxicity

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")


def test_stages_follow_each_other(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    bench = spark.read.parquet(f"{DATA}/benchmark.parquet")
    columns, kept = docs.columns, docs
    lexicon, machine = toxicity.train(docs, labels), None
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = kept
        kept = spark.createDataFrame(stage(spark, before, DATA).collect(), docs.schema)
        assert kept.columns == columns
        ids = {r.doc_id for r in kept.select("doc_id").collect()}
        all_ = {r.doc_id for r in before.select("doc_id").collect()}
        assert ids <= all_
        if name == "toxicity":
            assert all_ - ids == {r.doc_id for r in toxicity.score(before, lexicon).where("predicted = 1").collect()}
        if name == "quality":
            machine = quality.train(before, labels)
            assert all_ - ids == {r.doc_id for r in quality.score(before, machine).where("predicted = 0").collect()}
        if name == "leaks":
            assert all_ - ids == {r.doc_id for r in decontaminate.contaminated(before, bench).collect()}
    last = corpus_pipeline.STAGES[-1][1](spark, kept, DATA)
    assert {r.doc_id for r in last.collect()} == {r.doc_id for r in kept.collect()}
    assert {r.doc_id: r.ids for r in corpus_pipeline.run(spark, DATA).collect()} == {r.doc_id: r.ids for r in last.collect()}


def test_odd_tables_pass(spark, odd, none):
    stages = dict(corpus_pipeline.STAGES)
    assert all(stage(spark, none, DATA).count() == 0 for stage in stages.values())
    ids = lambda df: sorted((r.doc_id for r in df.collect()), key=str)
    every = ids(odd)
    assert ids(stages["near duplicates"](spark, odd, DATA)) == sorted([1, 2, 3, 4, 6, 6, None, 8, 8], key=str)
    assert ids(stages["leaks"](spark, odd, DATA)) == every
    told = stages["token ids"](spark, odd, DATA).collect()
    digests = sorted(hashlib.sha256((r.text or "").encode()).hexdigest() for r in odd.collect())
    assert sorted(r.decoded_sha256 for r in told) == digests and ids(stages["token ids"](spark, odd, DATA)) == every
    for name in ("toxicity", "quality"):
        assert set(ids(stages[name](spark, odd, DATA))) <= set(every)


def test_the_named_checkpoint_folder_is_used():
    def session(named, on_context, master):
        conf = types.SimpleNamespace(get=lambda key, default: named)
        return types.SimpleNamespace(conf=conf, sparkContext=types.SimpleNamespace(getCheckpointDir=lambda: on_context, master=master))

    assert shared.checkpoint_dir(session("file:///a/", "b", "local[2]")) == "file:///a"
    assert shared.checkpoint_dir(session(None, "hdfs:/b", "yarn")) == "hdfs:/b"
    assert shared.checkpoint_dir(session(None, None, "local[2]")) == shared.LOCAL_CHECKPOINTS
    with pytest.raises(ValueError):
        shared.checkpoint_dir(session(None, None, "spark://host:7077"))
