"""Blocks of images that are scored with each other, so that features travel little."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vistaspark.operators.order import with_ordinal
from vistaspark.sources.workspace import Workspace

#: Images of a block; pairs of blocks are scored together.
BLOCK_IMAGES = 8
#: Images with more partners than this say nothing about which of them belong together.
HUB = 64


def image_blocks(pairs: DataFrame, size: int = BLOCK_IMAGES, rounds: int = 3) -> DataFrame:
    """(index, block) of every image in pairs (i, j): communities of the pair table, cut into blocks of ``size``.

    A link weighs one more than its two images have partners in common.  Images
    take the label of greatest weight around them, their own counting as much as
    their heaviest link (ties: the least label), for some rounds; then all are
    range-sorted by label and dealt in that order.  So a community of any size
    is cut without a group in one task, and small ones share a block.  Blocks
    decide what travels together and no result.  Loops, repeated and reversed
    pairs count once; nulls take no part; no pairs give no blocks.
    """
    work = Workspace(pairs.sparkSession, "locality")
    once = pairs.where("i <> j").select(F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j")).distinct()
    links = work.put(once.select(F.explode(F.array(F.struct(F.col("i").alias("u"), F.col("j").alias("v")), F.struct(F.col("j").alias("u"), F.col("i").alias("v")))).alias("e")).select("e.*"), "links")
    telling = links.groupBy("u").count().where(F.col("count") <= HUB).select("u")
    through = links.join(telling, "u")
    wedges = through.select("u", F.col("v").alias("a")).join(through.select("u", F.col("v").alias("b")), "u").where("a < b").groupBy("a", "b").agg(F.count("*").alias("shared"))
    common = wedges.select(F.explode(F.array(F.struct(F.col("a").alias("u"), F.col("b").alias("v")), F.struct(F.col("b").alias("u"), F.col("a").alias("v")))).alias("e"), "shared").select("e.*", "shared")
    weighed = work.put(links.join(common, ["u", "v"], "left").select("u", "v", (1 + F.coalesce("shared", F.lit(0))).alias("w")), "weighed")
    own = weighed.groupBy("u").agg(F.max("w").alias("w")).select("u", F.col("u").alias("v"), "w")
    weighed = work.put(weighed.unionByName(own), "votes")
    labels = weighed.where("u = v").select(F.col("u").alias("v"), F.col("v").alias("label"))
    for _ in range(rounds):
        votes = weighed.join(labels, "v").groupBy("u", "label").agg(F.sum("w").alias("w"))
        labels = votes.groupBy(F.col("u").alias("v")).agg(F.max_by("label", F.struct("w", -F.col("label"))).alias("label"))
    placed = with_ordinal(labels.select(F.col("v").alias("index"), "label"), ["label", "index"], "place")
    return placed.select("index", F.floor(F.col("place") / size).cast("long").alias("block"))
