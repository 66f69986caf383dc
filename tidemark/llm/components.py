"""Connected components of a link table, by alternating large-star and small-star steps on DataFrames."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Workspace, join_by_key

ROWS_A_FILE = 200_000


def _least_neighbour(edges: DataFrame, work: Workspace, files: int) -> DataFrame:
    """Edges u, v with ``m``, the least of u and its neighbours; the hub of a star is dealt out over tasks."""
    least = edges.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"), F.count(F.lit(1)).alias("n"))
    return join_by_key(edges, work.save(least.coalesce(files), "least"), ["u"], "v")


def components(links: DataFrame, work: Workspace) -> DataFrame:
    """(id, comp) of each id in the links a, b, where comp is the least id of its component.

    Each round writes its edges to the shared folder and rereads them. The edges turn into stars around least ids in
    O(log^2 n) rounds; they end once every edge leads to the centre of a star. Ids that are in no link, and least ids,
    have no row.
    """
    edges = work.save(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    while True:
        n, sources = edges.agg(F.count(F.lit(1)), F.count_distinct("u")).first()
        few = math.ceil(n / ROWS_A_FILE) or 1  # small tables aren't scattered over many files
        inner = edges.select("u").join(edges.select(F.col("v").alias("u")), "u", "left_semi")
        if n == sources and inner.isEmpty():
            break
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _least_neighbour(both, work, few).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = work.save(large.coalesce(few), "large")
        small = _least_neighbour(large, work, few)
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(small.select("u", F.col("m").alias("v"))).distinct()
        edges = work.save(small.coalesce(few), "small")
    return edges.select(F.col("u").alias("id"), F.col("v").alias("comp"))
