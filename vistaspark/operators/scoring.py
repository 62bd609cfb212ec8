"""Geometric scores of pairs of images.

Images that share pairs lie in blocks; a block pair that holds wanted pairs gets
the features of its images once, whatever the number of pairs.  Keypoints are
tried on every direction, small motion only where they were not accepted, and
that pass gets no keypoints.  Kernels give metrics per direction and attempt;
decisions, rounding and the choice between attempts and directions are Columns.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vistaspark.config import Thresholds
from vistaspark.functions import decisions as D
from vistaspark.kernels import geometry as G
from vistaspark.operators.features import undump
from vistaspark.operators.locality import image_blocks
from vistaspark.schemas import PAIR_METRICS, PAIR_SCORE
from vistaspark.sources.workspace import Workspace

_NAMES = [c.strip().split()[0] for c in PAIR_METRICS.split(",")]


def _metrics(a: dict, b: dict, h, good: int, mask_sum: int, error: float, method: str) -> dict:
    avg, most, avg_px, most_px = G.corner_shift(a, b, h)
    edge, gradient = G.structural_alignment(a, b, h)
    return {
        "good_matches": good, "ransac_inliers": mask_sum, "inlier_ratio": mask_sum / max(1.0, float(good)), "median_reprojection_error": error,
        "avg_corner_shift_ratio": avg, "max_corner_shift_ratio": most, "avg_corner_shift_pixels": avg_px, "max_corner_shift_pixels": most_px,
        "edge_score": edge, "gradient_score": gradient, "method": method,
    }


def _rejected(method: str, good: int) -> dict:
    return {
        "good_matches": good, "ransac_inliers": 0, "inlier_ratio": 0.0, "median_reprojection_error": G.INF, "avg_corner_shift_ratio": G.INF,
        "max_corner_shift_ratio": G.INF, "avg_corner_shift_pixels": G.INF, "max_corner_shift_pixels": G.INF, "edge_score": 0.0, "gradient_score": 0.0, "method": method,
    }


def by_keypoints(a: dict, b: dict, t: Thresholds, seed: int) -> dict:
    """Metrics of the homography that matched keypoints give; attempt "none" without one."""
    m = G.match(a["desc"], b["desc"], t.descriptor_ratio)
    h, mask, error = G.estimate_homography(a["xy"][m[:, 0]], b["xy"][m[:, 1]], seed) if len(m) else (None, (), G.INF)
    if h is None:
        return {"attempt": "none"} | _rejected("none", len(m))
    return {"attempt": "keypoints"} | _metrics(a, b, h, len(m), int(mask.sum()), error, "sift_homography")


def by_motion(a: dict, b: dict, good: int) -> dict:
    """Metrics of small motion of the gradients; attempt "failed" where it finds none, with the cause as method."""
    h, method = G.small_motion(a, b)
    if h is None:
        return {"attempt": "failed"} | _rejected(method, good)
    return {"attempt": "motion"} | _metrics(a, b, h, good, 0, G.INF, method)


def _attempts(work: Workspace, name: str, asked: DataFrame, features: DataFrame, parts: list[str], blocks: DataFrame, attempt) -> DataFrame:
    """``attempt`` on every row of asked (i, j, ...), each pair of blocks with the features of its images in one group."""
    at = lambda c: blocks.select(F.col("index").alias(c), F.col("block").alias("b" + c))
    tagged = work.put(asked.join(at("i"), "i").join(at("j"), "j").select(*asked.columns, F.least("bi", "bj").alias("b1"), F.greatest("bi", "bj").alias("b2")), f"{name}_asked")
    need = tagged.select(F.col("b1").alias("s1"), F.col("b2").alias("s2"), F.explode(F.array("i", "j")).alias("index")).distinct()
    sent = features.join(need, "index").select("s1", "s2", F.col("index").alias("idx"), *parts, "width", "height", "original_width", "original_height")

    def run(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        f = {r.idx: undump(r) for r in right.itertuples(index=False)}
        out = [{"a": r.a, "b": r.b, "i": r.i, "j": r.j, "is_forward": r.is_forward} | attempt(f[r.i], f[r.j], r) for r in left.itertuples(index=False)]
        return pd.DataFrame(out, columns=_NAMES)

    return work.put(tagged.groupBy("b1", "b2").cogroup(sent.groupBy("s1", "s2")).applyInPandas(run, PAIR_METRICS), name)


def pair_metrics(pairs: DataFrame, features: DataFrame, t: Thresholds) -> DataFrame:
    """Attempts of both directions of each pair (i, j): keypoints, and small motion where they are not accepted."""
    work = Workspace(pairs.sparkSession, "metrics")
    pairs = work.put(unordered(pairs).select(F.col("i").alias("a"), F.col("j").alias("b")), "pairs")
    blocks = work.put(image_blocks(pairs.select(F.col("a").alias("i"), F.col("b").alias("j"))), "blocks")
    way = lambda i, j, forward: F.struct(F.col(i).alias("i"), F.col(j).alias("j"), F.lit(forward).alias("is_forward"))
    ways = pairs.select("a", "b", F.explode(F.array(way("a", "b", 1), way("b", "a", 0))).alias("w")).select("a", "b", "w.*")
    seed = lambda r: (int(r.a) * 1_000_003 + int(r.b)) * 2 + int(r.is_forward)
    first = _attempts(work, "keypoints", ways, features, ["keypoints", "maps"], blocks, lambda a, b, r: by_keypoints(a, b, t, seed(r)))
    still_open = first.where(~D.decision(t).isin("verified", "tentative")).select("a", "b", "i", "j", "is_forward", "good_matches")
    second = _attempts(work, "motion", still_open, features, ["maps"], blocks, lambda a, b, r: by_motion(a, b, int(r.good_matches)))
    return first.unionByName(second)


def decide(metrics: DataFrame, images: DataFrame, t: Thresholds) -> DataFrame:
    """One PAIR_SCORE row a pair: the best attempt of each direction, then the better direction, forward if equal.

    An accepted keypoint attempt wins; else an accepted motion attempt; else the
    rejected keypoint attempt; else none, with what motion came to as its reason.
    """
    rounded = ["inlier_ratio", "median_reprojection_error", "avg_corner_shift_ratio", "max_corner_shift_ratio", "avg_corner_shift_pixels", "max_corner_shift_pixels", "edge_score", "gradient_score"]
    motion = F.max(F.when(F.col("attempt").isin("motion", "failed"), F.col("method"))).over(Window.partitionBy("a", "b", "is_forward"))
    nothing = F.concat_ws(",", F.lit("no_homography"), F.col("motion_method"))
    scored = metrics.withColumn("motion_method", motion).withColumn("decision", D.decision(t))
    scored = scored.withColumn("reason", F.when(F.col("attempt") == "none", nothing).otherwise(D.reason(t)))
    scored = scored.withColumn("confidence", F.when(F.col("attempt") == "none", 0.0).otherwise(D.confidence(t)))
    scored = scored.withColumns({c: F.when(F.col(c) == D.INF, F.col(c)).otherwise(F.round(c, 4)) for c in rounded})
    turn = F.when((F.col("attempt") == "keypoints") & D.accepted(), 0).when((F.col("attempt") == "motion") & (F.col("decision") == "tentative"), 1).when(F.col("attempt") == "keypoints", 2).when(F.col("attempt") == "none", 3)
    best = scored.withColumn("turn", turn).where("turn is not null").withColumn(
        "rn", F.row_number().over(Window.partitionBy("a", "b", "is_forward").orderBy("turn"))).where("rn = 1")
    kept = best.withColumn("rank", D.direction_rank()).withColumn(
        "rn", F.row_number().over(Window.partitionBy("a", "b").orderBy(F.col("rank").desc(), F.col("is_forward").desc()))).where("rn = 1")
    names = lambda i, f: images.select(F.col("index").alias(i), F.col("filename").alias(f))
    return kept.join(names("i", "filename_a"), "i").join(names("j", "filename_b"), "j").select(*[c.strip().split()[0] for c in PAIR_SCORE.split(",")])


def unordered(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j")).distinct()


def missing_pairs(pairs: DataFrame, have: DataFrame) -> DataFrame:
    """Wanted pairs (i < j, once each) that ``have`` holds in neither orientation."""
    return unordered(pairs).join(unordered(have), ["i", "j"], "left_anti")


def score_pairs(pairs: DataFrame, features: DataFrame, images: DataFrame, t: Thresholds, cache=None) -> DataFrame:
    """Scores of all pairs; those in the cache are not computed, the others are appended to it."""
    if cache is None:
        return decide(pair_metrics(pairs, features, t), images, t)
    work = Workspace(pairs.sparkSession, "cached")
    have = work.put(cache.load(pairs, images), "have")
    fresh = work.put(decide(pair_metrics(missing_pairs(pairs, have), features, t), images, t), "fresh")
    cache.append(fresh)
    return have.unionByName(fresh)
