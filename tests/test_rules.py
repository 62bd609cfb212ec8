"""Decision rules at their boundaries, and the scorer's documented scenarios."""


import pytest
from pyspark.sql import functions as F

from vistaspark.functions import decisions as D
from vistaspark.operators.evaluate import exact_set_score

BASE = dict(good_matches=45, ransac_inliers=25, inlier_ratio=0.30, median_reprojection_error=5.0, avg_corner_shift_ratio=0.08, max_corner_shift_ratio=0.16, edge_score=0.50, method="sift_homography", confidence=0.5)


def rows(spark, changes):
    data = [BASE | c for c in changes]
    return spark.createDataFrame([tuple(r[k] for k in BASE) for r in data], "good_matches int, ransac_inliers int, inlier_ratio double, median_reprojection_error double, avg_corner_shift_ratio double, max_corner_shift_ratio double, edge_score double, method string, confidence double")


def test_decision_boundaries(spark):
    cases = [
        ({}, "verified", "feature_homography_verified"),
        ({"good_matches": 44}, "reject", "weak_features"),
        ({"ransac_inliers": 24}, "reject", "weak_features"),
        ({"inlier_ratio": 0.2999}, "reject", "weak_features"),
        ({"avg_corner_shift_ratio": 0.0801}, "reject", "motion_too_large"),
        ({"max_corner_shift_ratio": 0.1601}, "reject", "motion_too_large"),
        ({"median_reprojection_error": 5.01}, "reject", "reprojection_error"),
        ({"edge_score": 0.4999}, "reject", "weak_structure"),
        ({"edge_score": 0.1, "ransac_inliers": 45, "inlier_ratio": 0.375, "median_reprojection_error": 3.75}, "verified", "feature_homography_verified"),
        ({"edge_score": 0.1, "ransac_inliers": 44, "inlier_ratio": 0.375, "median_reprojection_error": 3.75}, "reject", "weak_structure"),
        ({"edge_score": 0.1, "ransac_inliers": 45, "inlier_ratio": 0.374, "median_reprojection_error": 3.75}, "reject", "weak_structure"),
        ({"edge_score": 0.1, "ransac_inliers": 45, "inlier_ratio": 0.375, "median_reprojection_error": 3.76}, "reject", "weak_structure"),
        ({"good_matches": 9, "ransac_inliers": 8, "edge_score": 0.62}, "tentative", "structural_alignment_tentative"),
        ({"good_matches": 9, "ransac_inliers": 7, "edge_score": 0.62}, "reject", "weak_features"),
        ({"good_matches": 9, "ransac_inliers": 8, "edge_score": 0.61}, "reject", "weak_features"),
        ({"ransac_inliers": 0, "edge_score": 0.62, "method": "ecc_euclidean", "median_reprojection_error": float("inf")}, "tentative", "structural_alignment_tentative"),
        ({"good_matches": 1, "avg_corner_shift_ratio": 1.0, "median_reprojection_error": 9.0, "edge_score": 0.0}, "reject", "weak_features,motion_too_large,reprojection_error,weak_structure"),
    ]
    got = rows(spark, [c for c, _, _ in cases]).select(D.decision().alias("d"), D.reason().alias("r")).collect()
    assert [(r.d, r.r) for r in got] == [(d, r) for _, d, r in cases]


def test_supports_are_null_beyond_guards(spark):
    good = dict(good_matches=50, ransac_inliers=40, inlier_ratio=0.95, median_reprojection_error=0.3, avg_corner_shift_ratio=0.1, max_corner_shift_ratio=0.2, edge_score=0.4, confidence=0.7)
    outside = [{}, {"good_matches": 39}, {"ransac_inliers": 19}, {"inlier_ratio": 0.27}, {"median_reprojection_error": float("inf")}, {"edge_score": 0.13}, {"confidence": 0.44}, {"method": "none"}]
    got = rows(spark, [good | c for c in outside]).select(D.relaxed_support().alias("s")).collect()
    assert got[0].s == pytest.approx(0.28 * 40 / 60 + 0.18 * 0.5 + 0.18 + 0.16 * 0.9 + 0.1 * 0.9 + 0.1)
    assert [r.s for r in got[1:]] == [None] * 7
    tiny = rows(spark, [good | {"good_matches": 7, "ransac_inliers": 7}, good | {"good_matches": 6}, good | {"max_corner_shift_ratio": 0.23}]).select(D.tiny_motion_support().alias("s")).collect()
    assert tiny[0].s == pytest.approx(0.45 * 0.7 + 0.35 * 0.95 + 0.2 * 0.4) and tiny[1].s is None and tiny[2].s is None


TRUTH = {"living_room": 3, "kitchen_wide": 2, "kitchen_close": 1, "master_bed": 3, "master_bed_window": 2, "bathroom": 2, "backyard": 1, "exterior_front": 2}


def table(spark, groups):
    return spark.createDataFrame([(str(g), f) for g, fs in groups for f in fs] or [], "group_id string, filename string")


def test_documented_scenarios(spark):
    truth = [(g, [f"{g}_{k}" for k in range(n)]) for g, n in TRUTH.items()]
    names = dict(truth)
    single = [(f, [f]) for _, fs in truth for f in fs]
    merged = [(g, fs + (names["kitchen_close"] if g == "kitchen_wide" else [])) for g, fs in truth if g != "kitchen_close"]
    split = [x for x in truth if x[0] != "living_room"] + [("a", names["living_room"][:1]), ("b", names["living_room"][1:])]
    t = table(spark, truth)
    score = lambda p: exact_set_score(table(spark, p), t).first().score
    assert score(truth) == 1.0 and score(single) == 0.25 and score(merged) == 0.75 and score(split) == 0.875
    assert score([(k, list(reversed(fs))) for k, (_, fs) in enumerate(reversed(truth))]) == 1.0
    assert score([(g, [f.upper() if g == "backyard" else f for f in fs]) for g, fs in truth]) == 0.875
    assert exact_set_score(t, table(spark, [])).first().score == 0.0


def test_direction_pick_prefers_forward_when_equal(spark):
    equal = rows(spark, [{}, {}]).withColumn("decision", F.lit("verified")).withColumn("is_forward", F.monotonically_increasing_id() % 2)
    got = equal.agg(F.max_by("is_forward", F.struct(D.direction_rank().alias("r"), F.col("is_forward")))).first()[0]
    assert got == max(r.is_forward for r in equal.collect())
