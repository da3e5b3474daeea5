"""Connected components by alternating stars, as joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.llm.common import stored


def _mark(edges: DataFrame) -> tuple:
    r = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
    return r[0], r[1]


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for every node of the undirected ``edges`` (a, b); the label is the least node of its component.

    Each round links the larger neighbours of a node to its least neighbour, then the smaller ones. The edges become
    stars after a number of rounds that grows with the logarithm of the longest path. Every round is a written table, so
    the lineage stays short and nothing is collected but a count and a checksum. A node with many neighbours costs rows
    in proportion to them; nothing is gathered in one row.
    """
    edges = stored(edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    before = _mark(edges)
    while before[0]:
        both = edges.union(edges.select("b", "a"))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.join(least, "a").where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("e"))
        edges = stored(small.select("e.a", "e.b").where(F.col("a") != F.col("b")).distinct(), "edges")
        now = _mark(edges)
        if now == before:
            break
        before = now
    stars = edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("label"))
    return stars.union(edges.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct())
