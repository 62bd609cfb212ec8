"""Schemas of tables that leave or enter the engine."""

from __future__ import annotations

#: Metrics of a scored pair; i may exceed j when the reverse direction won.  Doubles may be infinite.
PAIR_SCORE = (
    "i long, j long, filename_a string, filename_b string, decision string, confidence double, good_matches int, ransac_inliers int, "
    "inlier_ratio double, median_reprojection_error double, avg_corner_shift_ratio double, max_corner_shift_ratio double, "
    "avg_corner_shift_pixels double, max_corner_shift_pixels double, edge_score double, gradient_score double, method string, reason string"
)
#: Raw output of the pair kernels, one row a direction and attempt: metrics before decision and rounding.
PAIR_METRICS = (
    "a long, b long, i long, j long, is_forward int, attempt string, good_matches int, ransac_inliers int, inlier_ratio double, "
    "median_reprojection_error double, avg_corner_shift_ratio double, max_corner_shift_ratio double, avg_corner_shift_pixels double, "
    "max_corner_shift_pixels double, edge_score double, gradient_score double, method string"
)
FEATURES = "index long, keypoints binary, maps binary, width int, height int, original_width int, original_height int, clipped_ratio double, descriptor array<float>"
COMPACT = "index long, filename string, width int, height int, descriptor array<float>"
#: Columns of files, in file order.
REPORT = ["angle_id", "filename", "representative_filename", "group_size", "confidence", "status"]
PREDICTIONS = ["filename", "group_id"]
