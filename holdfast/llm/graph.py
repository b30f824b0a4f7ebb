"""Connected components of links between numbered nodes, as rounds of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from holdfast.llm.scratch import Scratch


def connected(links: DataFrame, scratch: Scratch) -> DataFrame:
    """``node`` and ``component``, the least node that it reaches, of every node in links ``a``, ``b``.

    Alternates large and small stars: every node hands its neighbours its least neighbour, first the greater ones,
    then the smaller ones, until all links lead to the least node of their component. The rounds grow with the
    logarithm of the longest path. Each round is written to the shared folder, so that a lost executor costs a
    part of one round, and no node's links are gathered.
    """

    def stored(edges: DataFrame) -> tuple[DataFrame, tuple]:
        edges = scratch.store(edges, "links")
        return edges, tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())

    edges, state = stored(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        rest = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges, after = stored(least.select("u", F.col("m").alias("v")).union(rest).distinct())
        if after == state:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(edges.select("v", "v").distinct())
        state = after
