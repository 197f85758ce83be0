"""Connected components by alternating stars over written tables; no label reaches the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shiftlens.functions.durable import packed

PAIR_BYTES = 48


def _large(pairs: DataFrame) -> DataFrame:
    """Each node's larger neighbours point to the smallest of its neighbourhood."""
    both = pairs.union(pairs.select("v", "u")).toDF("u", "v")
    low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()


def _small(pairs: DataFrame) -> DataFrame:
    """Each node and its smaller neighbours point to the smallest of them. Pairs have u > v."""
    low = pairs.groupBy("u").agg(F.min("v").alias("m"))
    rest = pairs.join(low, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return rest.union(low.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame, rows: int | None = None) -> DataFrame:
    """``node``, ``root`` (smallest node) for every node of the links ``u``, ``v``, of which there are ``rows`` at most (none: not known).

    Alternating large and small stars end when every node has one smaller neighbour, itself a root. A star
    is joined on a hub only with one row, so hubs of any size are split by the join. Stars are never more than the links.
    """
    pairs, seen = packed(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct(), "links", None if rows is None else rows * PAIR_BYTES)
    while True:
        pairs, seen = packed(_small(_large(pairs)), "stars", seen["rows"] * PAIR_BYTES)
        twice = pairs.groupBy("u").agg(F.count("*").alias("n")).filter("n > 1").select("u")
        inner = pairs.join(pairs.select(F.col("u").alias("v")).distinct(), "v", "left_semi").select("u")
        if twice.union(inner).isEmpty():
            break
    return pairs.select(F.col("u").alias("node"), F.col("v").alias("root")).union(pairs.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


