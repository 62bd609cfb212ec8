"""Sampling of homographies against one sample at a time, and blocks of images."""

import random

import numpy as np

from vistaspark.config import Thresholds
from vistaspark.kernels import geometry as G
from vistaspark.operators import scoring
from vistaspark.operators.locality import image_blocks


def one_by_one(src, dst, seed, threshold, most, batch=64):
    """The same samples, each fitted by itself through a decomposition."""
    n, rng = len(src), np.random.default_rng(seed)
    best, need, tries = np.zeros(n, bool), most, 0
    while tries < min(need, most):
        for some in G.four_of(rng, n, batch):
            if tries >= min(need, most):
                break
            tries += 1
            h = G.fit_homography(src[some], dst[some])
            hit = np.linalg.norm(G.project(h, src) - dst, axis=1) <= threshold if h is not None else np.zeros(n, bool)
            if hit.sum() > best.sum():
                best, good = hit, hit.mean() ** 4
                need = 1 if good >= 1 else np.log(0.005) / np.log(1 - max(good, 1e-12))
    return best


def moved(rng, n, outliers):
    src = rng.uniform(0, 400, (n, 2))
    h = np.array([[1.02, 0.03, 5], [-0.02, 0.98, -7], [2e-5, -1e-5, 1]])
    dst = G.project(h, src) + rng.normal(0, 0.7, (n, 2))
    dst[: int(n * outliers)] = rng.uniform(0, 400, (int(n * outliers), 2))
    return src, dst


def test_batches_find_the_inliers_of_single_samples():
    rng = np.random.default_rng(3)
    for seed, (n, outliers) in enumerate([(8, 0.0), (30, 0.3), (60, 0.6), (200, 0.5), (300, 0.2), (5, 0.0), (4, 0.0)]):
        src, dst = moved(rng, n, outliers)
        a, b = G.most_agreed(src, dst, seed, 5.0, 400), one_by_one(src, dst, seed, 5.0, 400)
        assert (a == b).all(), (n, outliers)
        assert (G.most_agreed(src, dst, seed, 5.0, 400, batch=64) == a).all()


def test_samples_are_distinct_and_degenerate_ones_agree_with_nothing():
    for n in (4, 5, 9):
        some = G.four_of(np.random.default_rng(n), n, 500)
        assert all(len(set(r)) == 4 for r in some.tolist()) and some.min() == 0 and some.max() == n - 1
    line = np.stack([np.arange(12.0), 2 * np.arange(12.0)], 1)
    assert G.estimate_homography(line, line, 1)[0] is None
    same = np.ones((9, 2))
    assert G.estimate_homography(same, same, 1)[0] is None


def copies(blocks, pairs):
    """Block pairs that get an image's features, on average over images."""
    sent = {}
    for i, j in pairs:
        key = tuple(sorted((blocks[i], blocks[j])))
        sent.setdefault(i, set()).add(key)
        sent.setdefault(j, set()).add(key)
    return sum(map(len, sent.values())) / len(sent)


def test_blocks_follow_the_pairs(spark):
    r = random.Random(5)
    ids = list(range(0, 1200, 2))
    r.shuffle(ids)
    brackets = [ids[k : k + 5] for k in range(0, 600, 5)]
    inner = [(x, y) for b in brackets for x in b for y in b if x < y]
    stray = [(b[0], r.choice(ids)) for b in brackets[::4]]
    pairs = inner + [p for p in stray if p[0] != p[1]]
    rows = pairs + [(y, x) for x, y in pairs[:50]] + [(7, 7), (None, 3)]
    got = {x["index"]: x["block"] for x in image_blocks(spark.createDataFrame(rows, "i long, j long")).collect()}
    assert set(got) == set(ids)
    assert max(np.bincount(list(got.values()))) <= 8
    assert copies(got, inner) < 2 < copies({i: i // 16 for i in ids}, inner)
    assert image_blocks(spark.createDataFrame([], "i long, j long")).count() == 0


def test_a_star_is_cut_into_blocks(spark):
    got = image_blocks(spark.createDataFrame([(0, k) for k in range(1, 300)], "i long, j long")).collect()
    assert len(got) == 300 and max(np.bincount([x.block for x in got])) <= 8


def test_motion_is_tried_where_keypoints_are_not_accepted(spark, monkeypatch):
    """Rows of both passes: one attempt by keypoints a direction, motion only for those left open; the reason names its outcome."""
    from vistaspark.operators.features import dump

    flat = {"edges": np.zeros((40, 50), np.uint8), "gradient": np.zeros((40, 50), np.float32), "xy": np.zeros((0, 2), np.float32), "desc": None}
    rng = np.random.default_rng(1)
    xy, desc = rng.uniform(0, 200, (80, 2)), np.eye(128, dtype=np.float32)[:80]
    drawn = {"edges": (rng.random((200, 220)) > 0.8).astype(np.uint8), "gradient": rng.random((200, 220)).astype(np.float32), "xy": xy, "desc": desc}
    rows = [(k, *dump(f), f["edges"].shape[1], f["edges"].shape[0]) for k, f in enumerate([drawn, drawn, flat])]
    features = spark.createDataFrame([(k, *p, w, h, w, h) for k, *p, w, h in rows], "index long, keypoints binary, maps binary, width int, height int, original_width int, original_height int")
    pairs = spark.createDataFrame([(0, 1), (0, 2), (2, 0)], "i long, j long")
    metrics = scoring.pair_metrics(pairs, features, Thresholds())
    tried = sorted((x.i, x.j, x.attempt) for x in metrics.collect())
    assert tried == [(0, 1, "keypoints"), (0, 2, "failed"), (0, 2, "none"), (1, 0, "keypoints"), (2, 0, "failed"), (2, 0, "none")]
    images = spark.createDataFrame([(k, f"{k}.jpg") for k in range(3)], "index long, filename string")
    scored = {(x.i, x.j): x for x in scoring.decide(metrics, images, Thresholds()).collect()}
    assert scored[0, 1].decision == "verified" and scored[0, 1].ransac_inliers == 80
    assert scored[0, 2].decision == "reject" and scored[0, 2].reason == "no_homography,ecc_failed:flat" and scored[0, 2].method == "none"
