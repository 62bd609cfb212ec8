"""Plans' building blocks for large sets: compact components, bridges between them, splitting of large ones."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vistaspark.functions.decisions import aspect_delta
from vistaspark.operators import knn
from vistaspark.operators.cluster import components
from vistaspark.operators.order import with_ordinal
from vistaspark.sources.workspace import Workspace


def gate(images: DataFrame, pairs: DataFrame, max_aspect_delta: float) -> DataFrame:
    """Pairs whose images' aspect ratios agree."""
    side = lambda i, p: images.select(F.col("index").alias(i), F.col("width").cast("double").alias(f"{p}w"), F.col("height").cast("double").alias(f"{p}h"))
    delta = aspect_delta(F.col("aw"), F.col("ah"), F.col("bw"), F.col("bh"))
    return pairs.join(side("i", "a"), "i").join(side("j", "b"), "j").where(delta <= max_aspect_delta).select(*pairs.columns)


def similar_forest(images: DataFrame, levels: list[float], max_aspect_delta: float) -> DataFrame:
    """Pairs (i, j, sim) that serve in place of all pairs of like aspect for the components at each level."""
    aspect = F.col("width").cast("double") / F.greatest(F.lit(1.0), F.col("height").cast("double"))
    return knn.similar_forest(images.withColumn("aspect", aspect), levels, "aspect", max_aspect_delta)


def number_by_name(rows: DataFrame) -> DataFrame:
    """(index, filename, component) to group numbers from 0 in order of the groups' least filenames."""
    least = rows.groupBy("component").agg(F.min("filename").alias("least_name"))
    numbered = with_ordinal(least, ["least_name", "component"], "group_id").drop("least_name")
    return rows.join(numbered, "component").select("index", "filename", "group_id", "component")


def compact_components(images: DataFrame, pairs: DataFrame, min_similarity: float, max_aspect_delta: float) -> DataFrame:
    """(index, filename, group_id, component): components of pairs similar enough and of like aspect."""
    edges = gate(images, pairs.where(F.col("sim") >= min_similarity), max_aspect_delta)
    found = components(images, edges)
    return number_by_name(found.join(images.select("index", "filename"), "index"))


def bridge_candidates(images: DataFrame, groups: DataFrame, pairs: DataFrame, low: float, high: float, max_aspect_delta: float, per_pair: int, most: int) -> DataFrame:
    """Borderline pairs (low <= sim < high) between different groups: the best ``per_pair`` of each two groups (0: all),
    then the ``most`` most similar: (i, j, sim, group_i, group_j)."""
    side = lambda i, g: groups.select(F.col("index").alias(i), F.col("group_id").alias(g))
    near = pairs.where((F.col("sim") >= low) & (F.col("sim") < high)).join(side("i", "group_i"), "i").join(side("j", "group_j"), "j").where("group_i <> group_j")
    near = gate(images, near, max_aspect_delta)
    if per_pair > 0:
        order = Window.partitionBy(F.least("group_i", "group_j"), F.greatest("group_i", "group_j")).orderBy(F.col("sim").desc(), "i", "j")
        near = near.withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= per_pair).drop("rn")
    return near.orderBy(F.col("sim").desc(), "i", "j").limit(most).select("i", "j", "sim", "group_i", "group_j")


def bounded_components(images: DataFrame, pairs: DataFrame, min_similarity: float, max_size: int, max_aspect_delta: float, ladder: list[float]) -> DataFrame:
    """(index, component, n): components; each one over ``max_size`` is split at the first threshold of the ladder at
    which all its parts fit, and stays whole if none does.  All oversized components climb together."""
    work = Workspace(images.sparkSession, "bounded")
    size = lambda df: df.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("component")))
    done = work.put(size(compact_components(images, pairs, min_similarity, max_aspect_delta).select("index", "component")), "start")
    out = [done.where(F.col("n") <= max_size)]
    large = done.where(F.col("n") > max_size)
    for k, threshold in enumerate(ladder):
        large = work.put(large, f"large{k}")
        if large.isEmpty():
            break
        of = large.select("index", F.col("component").alias("whole"))
        inner = pairs.join(of.select(F.col("index").alias("i"), F.col("whole").alias("wi")), "i").join(of.select(F.col("index").alias("j"), F.col("whole").alias("wj")), "j").where("wi = wj").select("i", "j", "sim")
        subset = images.join(of.select("index"), "index", "left_semi")
        parts = size(compact_components(subset, inner, threshold, max_aspect_delta).select("index", "component")).join(of, "index")
        fits = F.max("n").over(Window.partitionBy("whole")) <= max_size
        parts = work.put(parts.withColumn("fits", fits), f"parts{k}")
        out.append(parts.where("fits").select("index", "component", "n"))
        large = large.join(parts.where(~F.col("fits")).select("index"), "index", "left_semi")
    result = out[0]
    for more in [*out[1:], large]:
        result = result.unionByName(more.select("index", "component", "n"))
    return result
