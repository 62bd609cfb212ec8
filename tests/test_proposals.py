"""Merge proposals and repair from hand-made groups, and numbers over a whole table."""

from vistaspark.operators import repair
from vistaspark.operators.order import with_ordinal

#: Group of each image; scenes are far apart, images of one scene alike.
GROUP = {0: 0, 1: 0, 2: 0, 3: 3, 4: 4, 5: 5, 6: 6, 7: 6, 8: 8, 9: 8, 10: 8, 11: 8, 12: 12, 13: 12, 14: 12, 15: 15, 16: 15, 17: 15, 18: 18}
SCENE = {**dict.fromkeys(range(4), 0), 4: 1, 5: 1, **dict.fromkeys(range(6, 12), 2), **dict.fromkeys(range(12, 18), 3), 18: 4}
#: A lone image with a group, two lone images, a pair of which one image is supported, two groups of three.
PAIRS = [(0, 3), (1, 3), (2, 3), (4, 5), (6, 7), (6, 8), (12, 15), (13, 16), (14, 17)]


def tables(spark, pairs=PAIRS):
    images = spark.createDataFrame(
        [(i, f"img_{i:03d}.jpg", [1.0 if d == s else 0.0 for d in range(5)]) for i, s in SCENE.items()], "index long, filename string, descriptor array<float>")
    scores = spark.createDataFrame(
        [(i, j, "verified", 0.95, 100, 60, 0.9, 0.0, 0.0, 0.0, 0.9, "sift_homography") for i, j in pairs],
        "i long, j long, decision string, confidence double, good_matches int, ransac_inliers int, inlier_ratio double, median_reprojection_error double,"
        "avg_corner_shift_ratio double, max_corner_shift_ratio double, edge_score double, method string")
    return images, spark.createDataFrame(list(GROUP.items()), "index long, group_id long"), scores


def test_proposals_of_every_phase(spark):
    images, assigned, scores = tables(spark)
    members = repair.group_members(images, assigned).cache()
    found = repair.proposals(members, scores, repair.targets(members))
    got = {(r.src, r.dst, r.phase): round(r.score, 6) for r in found.collect()}
    lone = 0.45 * 0.95 + 0.30 * 0.9 + 0.25 * 0.9
    assert got == {
        (3, 0, 1): 1.0, (4, 5, 1): round(lone, 6), (5, 4, 1): round(lone, 6), (4, 5, 2): round(lone, 6), (5, 4, 2): round(lone, 6),
        (6, 8, 3): 0.85, (12, 15, 4): 0.97, (15, 12, 4): 0.97, (12, 15, 5): 1.0,
    }


def test_repair_merges_what_is_supported_and_nothing_else(spark):
    images, assigned, scores = tables(spark)
    groups = {}
    for r in repair.repair(images, assigned, scores).collect():
        groups.setdefault(r.group_id, set()).add(r["index"])
    assert groups == {0: {0, 1, 2, 3}, 1: {4, 5}, 2: set(range(6, 12)), 3: set(range(12, 18)), 4: {18}}


def test_repair_keeps_groups_without_support(spark):
    images, assigned, scores = tables(spark, [(6, 7), (12, 15)])
    got = {r["index"]: r.group_id for r in repair.repair(images, assigned, scores).collect()}
    firsts = sorted(set(GROUP.values()))
    assert got == {i: firsts.index(g) for i, g in GROUP.items()}


def test_rankings_of_tails_and_medium_groups(spark):
    images, assigned, _ = tables(spark)
    ranked = repair.targets(repair.group_members(images, assigned).cache())
    pairs = {k: {(r.src, r.dst, r.rank) for r in df.collect()} for k, df in ranked.items()}
    assert pairs["tail"] == {(6, 8, 1)} and pairs["medium"] == {(12, 15, 1), (15, 12, 1)}
    assert {s for s, *_ in pairs["single"]} == {3, 4, 5, 18} and (3, 0, 1) in pairs["single"] and (4, 5, 1) in pairs["single"]


def test_near_singles(spark):
    images, assigned, _ = tables(spark)
    near = repair.singles_near(repair.group_members(images, assigned).cache())
    assert [(r.src, r.dst, r.left, r.right) for r in near.collect()] == [(4, 5, 4, 5)]


def test_ordinals_follow_the_keys(spark):
    rows = spark.range(1000).selectExpr("id", "nullif(id % 7, 6) AS k").repartition(9)
    got = with_ordinal(rows, ["k", "id"], "number", start=5).orderBy("number").collect()
    want = sorted(range(1000), key=lambda i: (i % 7 != 6, i % 7, i))
    assert [r.id for r in got] == want and [r.number for r in got] == list(range(5, 1005))
    assert with_ordinal(rows.where("id < 0"), ["id"], "number").count() == 0
