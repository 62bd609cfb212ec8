"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vistaspark.sources.workspace import Workspace


def connected_components(edges: DataFrame, left: str = "i", right: str = "j", max_rounds: int = 64) -> DataFrame:
    """(node, component): the least node reachable, for every node that has an edge.

    Large-star / small-star: both steps replace edges by edges to a node's least
    neighbour, so a star of any size is one grouped minimum and a join, and a
    chain of n nodes takes about log n rounds.  Every round's edges are written to
    the shared folder.  Nulls join nothing; loops only name their node.  Raises if
    ``max_rounds`` do not suffice rather than give a partial answer.
    """
    work = Workspace(edges.sparkSession, "components")
    named = edges.select(F.col(left).alias("u"), F.col(right).alias("v")).where(F.col("u").isNotNull() & F.col("v").isNotNull())
    current = work.put(named.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "e0")

    def star(e: DataFrame, large: bool) -> DataFrame:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else e
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        joined = both.join(least, "u")
        if large:
            return joined.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        moved = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        return moved.where(F.col("u") != F.col("v")).distinct()

    def state(e: DataFrame) -> tuple:
        row = e.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")).alias("s")).first()
        return row["n"], row["s"]

    before = None
    for k in range(1, max_rounds + 1):
        after = work.put(star(star(current.where("u != v"), True), False), f"e{k}")
        now = state(after)
        if now == before or now[0] == 0:
            nodes = named.select("u").unionByName(named.select(F.col("v").alias("u"))).distinct()
            out = nodes.join(after.withColumnRenamed("v", "m"), "u", "left")
            return out.select(F.col("u").alias("node"), F.coalesce("m", "u").alias("component"))
        before = now
        if k > 1:
            work.drop(f"e{k - 1}")
        current = after
    raise RuntimeError(f"connected components did not settle in {max_rounds} rounds")
