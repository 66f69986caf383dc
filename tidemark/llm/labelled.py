"""Bounded samples of labelled rows, and which rows are held out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def remainder(id_col: str, modulus: int) -> Column:
    """crc32 of an id as text, modulo; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), F.lit(modulus))


def sample(labels: DataFrame, label: str, *, modulus: int, held_out: int, at_most: int, id_col: str = "doc_id") -> DataFrame:
    """``id``, ``label`` of labelled rows that aren't held out: all of them up to about ``at_most``, else a share.

    The share is the same for every id range and depends on the id alone, so a retried task draws the same rows. A row
    with a null id or label is no example. Of rows that repeat an id the largest label counts.
    """
    rows = labels.where(F.col(id_col).isNotNull() & F.col(label).isNotNull() & (remainder(id_col, modulus) != held_out))
    n = rows.count()
    share = min(1.0, at_most / n) if n else 1.0
    drawn = rows.where(F.pmod(F.xxhash64(F.col(id_col).cast("string")), F.lit(1 << 20)) < int(share * (1 << 20)))
    return drawn.groupBy(F.col(id_col).alias("id")).agg(F.max(F.col(label).cast("int")).alias("label"))


def with_texts(drawn: DataFrame, docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``label``, ``text`` of the drawn rows, a text once. The drawn rows are few by their bound, so they are broadcast."""
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    joined = texts.join(F.broadcast(drawn), "id")
    return joined.groupBy("text").agg(F.max("label").alias("label"))
