"""Rules over a pair's metrics, as Columns: confidence, decision, reason, supports, bridge acceptance.

All take rows with the columns of ``schemas.PAIR_SCORE``; NULL support means none.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from vistaspark.config import Thresholds

INF = float("inf")


def _c(name: str) -> Column:
    return F.col(name)


def _clamp(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def confidence(t: Thresholds = Thresholds(), rounded: bool = True) -> Column:
    """Weighted evidence of inliers, their share, error, motion and structure, in 0 to 1."""
    inliers = F.least(F.lit(1.0), _c("ransac_inliers") / F.lit(2.5 * t.min_inliers))
    share = F.least(F.lit(1.0), _c("inlier_ratio") / F.lit(2.0 * t.min_inlier_ratio))
    error = F.when(_c("median_reprojection_error") == INF, 0.0).otherwise(
        F.greatest(F.lit(0.0), 1.0 - _c("median_reprojection_error") / F.lit(2.0 * t.max_reprojection_error)))
    motion = F.greatest(F.lit(0.0), 1.0 - _c("avg_corner_shift_ratio") / F.lit(max(0.01, t.max_corner_shift)))
    structure = F.least(F.lit(1.0), _c("edge_score") / F.lit(t.min_edge_score))
    value = _clamp(0.25 * inliers + 0.20 * share + 0.20 * error + 0.20 * motion + 0.15 * structure)
    return F.round(value, 4) if rounded else value


def _conditions(t: Thresholds) -> dict[str, Column]:
    good, inl, ratio = _c("good_matches"), _c("ransac_inliers"), _c("inlier_ratio")
    err, avg, most, edge = _c("median_reprojection_error"), _c("avg_corner_shift_ratio"), _c("max_corner_shift_ratio"), _c("edge_score")
    enough = (good >= t.min_good_matches) & (inl >= t.min_inliers) & (ratio >= t.min_inlier_ratio)
    motion = (avg <= t.max_avg_corner_shift) & (most <= t.max_corner_shift)
    reprojection = err <= t.max_reprojection_error
    structure = edge >= t.min_edge_score
    strong = (inl >= int(t.min_inliers * 1.8)) & (ratio >= t.min_inlier_ratio * 1.25) & (err <= t.max_reprojection_error * 0.75)
    tentative = (
        motion & (avg <= t.tentative_avg_corner_shift) & (edge >= t.tentative_edge_score)
        & ((inl >= 8) | _c("method").startswith("ecc"))
    )
    verified = enough & motion & reprojection & (structure | strong)
    return {"enough": enough, "motion": motion, "reprojection": reprojection, "structure": structure | strong, "verified": verified, "tentative": tentative}


def decision(t: Thresholds = Thresholds()) -> Column:
    c = _conditions(t)
    return F.when(_c("method") == "none", "reject").when(c["verified"], "verified").when(c["tentative"], "tentative").otherwise("reject")


def reason(t: Thresholds = Thresholds()) -> Column:
    c = _conditions(t)
    failed = F.concat_ws(
        ",", F.when(~c["enough"], "weak_features"), F.when(~c["motion"], "motion_too_large"),
        F.when(~c["reprojection"], "reprojection_error"), F.when(~c["structure"], "weak_structure"))
    return (
        F.when(c["verified"], "feature_homography_verified").when(c["tentative"], "structural_alignment_tentative")
        .when(failed == "", "thresholds_not_met").otherwise(failed)
    )


def accepted(column: str = "decision") -> Column:
    return _c(column).isin("verified", "tentative")


def direction_rank() -> Column:
    """Sort key of the two directions of one pair; larger is better."""
    return F.struct(
        accepted().cast("int"), (_c("decision") == "verified").cast("int"), _c("confidence"), _c("ransac_inliers"),
        _c("inlier_ratio"), -_c("median_reprojection_error"))


def _support(guard: Column, value: Column) -> Column:
    return F.when(guard, value)


def relaxed_support() -> Column:
    guard = (
        (_c("method") != "none") & (_c("median_reprojection_error") != INF) & (_c("avg_corner_shift_ratio") != INF)
        & (_c("good_matches") >= 40) & (_c("ransac_inliers") >= 20) & (_c("inlier_ratio") >= 0.28) & (_c("median_reprojection_error") <= 3.0)
        & (_c("avg_corner_shift_ratio") <= 1.0) & (_c("max_corner_shift_ratio") <= 1.8) & (_c("edge_score") >= 0.14) & (_c("confidence") >= 0.45)
    )
    one = F.lit(1.0)
    return _support(guard, (
        0.28 * F.least(one, _c("ransac_inliers") / F.lit(60.0)) + 0.18 * F.least(one, _c("good_matches") / F.lit(100.0))
        + 0.18 * F.least(one, _c("inlier_ratio") / F.lit(0.60)) + 0.16 * F.greatest(F.lit(0.0), 1.0 - _c("median_reprojection_error") / F.lit(3.0))
        + 0.10 * F.greatest(F.lit(0.0), 1.0 - _c("avg_corner_shift_ratio")) + 0.10 * F.least(one, _c("edge_score") / F.lit(0.30))))


def singleton_support() -> Column:
    guard = (
        (_c("method") != "none") & (_c("good_matches") >= 14) & (_c("ransac_inliers") >= 10) & (_c("inlier_ratio") >= 0.75)
        & (_c("median_reprojection_error") <= 0.35) & (_c("avg_corner_shift_ratio") <= 0.60) & (_c("max_corner_shift_ratio") <= 0.90)
        & (_c("edge_score") >= 0.30) & (_c("confidence") >= 0.52)
    )
    return _support(guard, 0.45 * _c("confidence") + 0.30 * _c("edge_score") + 0.25 * _c("inlier_ratio"))


def tiny_motion_support() -> Column:
    guard = (
        (_c("method") != "none") & (_c("good_matches") >= 7) & (_c("ransac_inliers") >= 7) & (_c("inlier_ratio") >= 0.90)
        & (_c("median_reprojection_error") <= 0.45) & (_c("avg_corner_shift_ratio") <= 0.12) & (_c("max_corner_shift_ratio") <= 0.22)
        & (_c("edge_score") >= 0.30) & (_c("confidence") >= 0.60)
    )
    return _support(guard, 0.45 * _c("confidence") + 0.35 * _c("inlier_ratio") + 0.20 * _c("edge_score"))


def member_support() -> Column:
    return F.coalesce(relaxed_support(), tiny_motion_support())


def bridge_accepts(strong_reject: bool = False) -> Column:
    """Whether a borderline pair joins two components; with the flag also a rejected pair with strong geometry."""
    verified = _c("decision") == "verified"
    if not strong_reject:
        return verified
    return verified | (
        (_c("ransac_inliers") >= 18) & (_c("inlier_ratio") >= 0.45) & (_c("median_reprojection_error") <= 3.0) & (_c("avg_corner_shift_ratio") <= 0.12)
    )


def aspect_delta(left_w: Column, left_h: Column, right_w: Column, right_h: Column) -> Column:
    one = F.lit(1.0)
    return F.abs(left_w / F.greatest(one, left_h) - right_w / F.greatest(one, right_h))
