"""Connected components of an undirected graph by alternating star contractions.

Each round links every node's neighbours to the smallest one nearby; a graph of diameter d is a set of
stars after about log(d) rounds.  A node with very many neighbours is never gathered: only the minimum of
its neighbours is, which Spark sums up before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scoutline.llm.common import forget, written


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """edges: u > v."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame, u: str = "u", v: str = "v", rounds: int = 60) -> DataFrame:
    """(node, component): the smallest node that each node of an edge reaches."""
    ends = (F.col(u).cast("long"), F.col(v).cast("long"))
    now = written(edges.select(F.greatest(*ends).alias("u"), F.least(*ends).alias("v")).where("u > v").distinct(), "edges")
    before, state = None, _state(now)
    while state != before and state[0]:
        if not rounds:
            raise RuntimeError("components did not settle")
        last, now = now, written(_small_star(_large_star(now)), "edges")
        forget(last)
        before, state, rounds = state, _state(now), rounds - 1
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
