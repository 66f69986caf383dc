"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op3_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of documents whose sets of 3-word shingles have a likeness of 0.85 or more."""
    from .near_dedup import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"), shingle=3, num=85, den=100)


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text encoded by byte-level BPE and decoded again."""
    from .byte_bpe import digests

    return digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op9_token_sstable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every text, written to sorted-string-table shards and listed from them."""
    from .sstable import roundtrip

    return roundtrip(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=1)


def op1_imatch_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every text and of the text with its last third replaced from the next document."""
    from .imatch import edited_fingerprints

    return edited_fingerprints(table(spark, sf_dir, "documents"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The test items that documents hold."""
    from .decontaminate import contaminated

    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shards of at most 1 MiB of text by extendible hashing."""
    from .sharding import assign

    return assign(table(spark, sf_dir, "documents"), byte_limit=1 << 20)


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licences of whole texts, and of their lines."""
    from .licences import scan

    return scan(table(spark, sf_dir, "documents"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity scores of every text, learnt from labels that aren't held out."""
    from . import toxicity

    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels"), modulus=4, held_out=2), modulus=4, held_out=2)


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page by way of ARC to WARC files and back."""
    from .archives import archive

    return archive(table(spark, sf_dir, "pages"), min_bytes=0)


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality scores of every text, learnt from labels that aren't held out."""
    from . import quality

    docs = table(spark, sf_dir, "documents")
    return quality.score(docs, quality.train(docs, table(spark, sf_dir, "labels"), modulus=5, held_out=0), modulus=5, held_out=0)


def op11_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of all documents in windows of 2048 tokens."""
    from .packing import digests

    return digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end_id=1)


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each of five filters does in all their orders, for each source."""
    from .filter_audit import audit

    return audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tenth of the documents drawn towards the benchmark's words."""
    from .resampling import resample

    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_ALL = (
    op1_imatch_fingerprints,
    op2_decontamination,
    op3_minhash_near_dedup,
    op4_sharding,
    op5_license_scan,
    op6_toxicity,
    op7_warc,
    op8_byte_bpe,
    op9_token_sstable,
    op10_quality,
    op11_packing,
    op12_filter_audit,
    op13_importance_resampling,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in _ALL}


def oracle_sql() -> dict[str, str]:
    from . import archives, filter_audit, licences, near_dedup, resampling, sharding

    return {
        "op3_minhash_near_dedup": near_dedup.ORACLE,
        "op4_sharding": sharding.ORACLE,
        "op5_license_scan": licences.oracle(),
        "op7_warc": archives.ORACLE,
        "op12_filter_audit": filter_audit.ORACLE,
        "op13_importance_resampling": resampling.ORACLE,
    }
