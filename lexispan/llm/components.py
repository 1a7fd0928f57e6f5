"""Connected components of an edge table, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexispan.llm.common import checkpointed

SALTS = 16  # tasks that the rows of one vertex are dealt to


def _unsettled(edges: DataFrame) -> int:
    """How many vertices keep the edges from being stars that point to their least vertex:
    those with several smaller neighbours, or with smaller and larger ones."""
    down, up = edges.select(F.col("u").alias("vertex"), F.lit(1).alias("down"), F.lit(0).alias("up")), edges.select(F.col("v").alias("vertex"), F.lit(0).alias("down"), F.lit(1).alias("up"))
    ends = down.unionByName(up).groupBy("vertex").agg(F.sum("down").alias("down"), F.max("up").alias("up"))
    return int(ends.agg(F.count_if(F.col("down") + F.col("up") > 1)).first()[0])


def _least(rows: DataFrame, with_own: bool) -> DataFrame:
    """``u, m``: the least neighbour of every u (and itself, if wanted); partial
    aggregation keeps hubs small."""
    least = F.least(F.col("u"), F.min("v")) if with_own else F.min("v")
    return rows.groupBy("u").agg(least.alias("m"))


def _meet(rows: DataFrame, least: DataFrame) -> DataFrame:
    """``rows`` with the ``m`` of their u. Every u meets its rows in SALTS places, so a hub's
    rows are dealt to as many tasks; the adaptive skew join splits what is still large."""
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("v"), F.lit(SALTS)).cast("int"))
    places = least.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return salted.join(places, ["u", "salt"])


def components(edges: DataFrame) -> DataFrame:
    """``u, v`` (longs, u <> v, any order) -> ``vertex, component`` (least vertex).

    Large-star links every larger neighbour to a vertex's least neighbour, small-star
    the smaller ones; stars with the least vertex at the centre remain after about
    log(n) rounds. Edges stay distributed, every round is checkpointed, and the rows
    of hubs are dealt to several tasks. Edges that are such stars already need no round:
    every stage costs the driver a buffer of 4 MB, so none runs only to see no change.
    """
    edges = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    edges = checkpointed(edges)
    while _unsettled(edges):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _meet(both.where("v > u"), _least(both, True))
        large = large.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        down = _least(large, False)
        small = _meet(large, down).select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.unionByName(down.select("u", F.col("m").alias("v"))).where("u <> v")
        edges = checkpointed(small.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    leaves = edges.groupBy("u").agg(F.min("v").alias("component")).withColumnRenamed("u", "vertex")
    centres = edges.select(F.col("v").alias("vertex"), F.col("v").alias("component")).distinct()
    return leaves.unionByName(centres)
