"""A corpus through five stages: toxicity, quality, near duplicates, benchmark leaks, and token ids.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it kept, as reread from Parquet; sf_dir has
the tables that are not the corpus (labels, benchmark). The filters return the columns of ``documents`` as they are.
Models are fitted on labelled rows of what reaches their stage. Rows with null or empty texts go through the filters
like others: they hold no toxic word, get the quality score of a text without words, are near duplicates of nothing and
leak nothing. An empty table stays empty. Of rows that repeat an id all share one fate in the near-duplicate stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import byte_bpe, decontaminate, near_dedup, quality, toxicity
from tidemark.llm.shared import Workspace


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score below 0.3."""
    return toxicity.keep_clean(docs, toxicity.train(docs, _table(spark, sf_dir, "labels")))


def drop_poor(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a quality score of 0.3 or more."""
    return quality.keep_good(docs, quality.train(docs, _table(spark, sf_dir, "labels")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the least id, of each group alike in 0.8 of their 5-word shingles."""
    groups = near_dedup.near_duplicates(docs)
    gone = groups.where(~F.col("kept")).select(F.col("doc_id").alias("_gone")).distinct()
    return docs.join(gone, docs["doc_id"] == gone["_gone"], "left_anti")


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no test item."""
    return decontaminate.keep_uncontaminated(docs, _table(spark, sf_dir, "benchmark"))


def to_token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, the byte-level BPE ids of each text, and the SHA-256 of the bytes that they decode to."""
    return byte_bpe.encode_and_decode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("toxicity", drop_toxic),
    ("quality", drop_poor),
    ("near duplicates", drop_near_duplicates),
    ("leaks", drop_leaks),
    ("token ids", to_token_ids),
]

#: Learnt scores and LSH can't be put in SQL. Tests hold near duplicates, leaks and token ids against brute force or the
#: library, and the two classifiers' decisions against plain versions of their scores.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written to the shared folder and reread. The stages' tables are removed at the end; the results of
    operators within stages (folders named tidemark-...-result) stay until the checkpoint folder is cleared."""
    docs = _table(spark, sf_dir, "documents")
    work = Workspace(spark, "pipeline")
    for name, stage in STAGES[:-1]:
        docs = work.save(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return work.finish(STAGES[-1][1](spark, docs, sf_dir))
