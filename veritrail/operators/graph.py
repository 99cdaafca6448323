"""Connected components by alternating stars: every round is two joins on node ids, and its edges are a written table, in place of the last round's."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veritrail.sources.catalog import remove, written


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", rounds: int = 60) -> DataFrame:
    """(node, component) for each node of an edge between two different nodes; component is the smallest node that links reach.

    Rows with a null end and edges from a node to itself count for nothing. Each round first ties the larger neighbours of every node to the
    smallest of its neighbourhood, then the smaller ones; the number of rounds grows with the logarithm of the longest path.
    Minima are taken before rows move, and joins on a hub's id are inner equi-joins that adaptive execution splits.
    """
    a, b = F.col(src), F.col(dst)
    spark = edges.sparkSession
    e, at = written(edges.where(a != b).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "edges")
    before = _mark(e)
    for _ in range(rounds):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where(F.col("v") > F.col("u")).join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        smallest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(smallest, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        e, fresh = written(small.distinct(), "edges")
        after = _mark(e)
        remove(spark, at)
        at = fresh
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
