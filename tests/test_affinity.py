"""Affinities between groups against brute force: cells, bounds, split groups."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.test_knn import clustered
from vistaspark.operators import repair
from vistaspark.operators.affinity import centroids, group_affinity


def plain(x, group):
    ids = np.unique(group)
    mean = {g: x[group == g].mean(0) for g in ids}
    mean = {g: m / np.linalg.norm(m) if np.linalg.norm(m) > 1e-8 else m for g, m in mean.items()}
    return {(a, b): 0.55 * max((x[group == a] @ x[group == b].T).max(), -1) + 0.45 * mean[a] @ mean[b] for a in ids for b in ids if a != b}


def members(spark, x, group):
    n = {g: int((group == g).sum()) for g in group}
    return spark.createDataFrame([(int(g), i, f"f{i:04d}", [float(c) for c in v], n[g]) for i, (g, v) in enumerate(zip(group, x))], "group_id long, index long, filename string, descriptor array<double>, n long").repartition(4).cache()


def data(n=420, seed=1):
    x = clustered(n, 12, 20, 0.2, seed)
    rng = np.random.default_rng(seed)
    return x, np.where(np.arange(n) < n // 3, 7, np.where(rng.random(n) < 0.4, 10_000 + np.arange(n), rng.integers(100, 160, n)))


@pytest.mark.parametrize("block_rows", [25, 4000])
def test_best_targets_of_each_source(spark, block_rows):
    """A third of all rows are one group, which is split over blocks."""
    x, group = data()
    want, n = plain(x, group), {g: int((group == g).sum()) for g in group}
    report = {}
    got = repair.rank_targets(group_affinity(members(spark, x, group), F.col("n") == 1, F.lit(True), k=5, block_rows=block_rows, report=report), 5).collect()
    ranks = {}
    for r in got:
        assert abs(r.affinity - want[r.src, r.dst]) < 1e-9 and (r.src_n, r.dst_n) == (n[r.src], n[r.dst])
        ranks[r.src, r.rank] = r.dst
    for s in {g for g in n if n[g] == 1}:
        best = sorted((-v, -d, d) for (a, d), v in want.items() if a == s)[:5]
        assert [ranks[s, k + 1] for k in range(5)] == [d for *_, d in best]
    assert block_rows > 420 or report["share"] < 0.95


@pytest.mark.parametrize("block_rows", [25, 4000])
def test_pairs_of_least_affinity_and_like_size(spark, block_rows):
    x, group = data(seed=3)
    want, n = plain(x, group), {g: int((group == g).sum()) for g in group}
    report = {}
    got = group_affinity(members(spark, x, group), F.col("n") >= 2, F.col("n") >= 3, least=0.8, ratio=4.0, block_rows=block_rows, report=report).collect()
    assert {(r.src, r.dst) for r in got} == {(a, b) for (a, b), v in want.items() if v >= 0.8 and n[a] >= 2 and n[b] >= 3 and max(n[a], n[b]) <= 4 * min(n[a], n[b])}
    assert len(got) == len({(r.src, r.dst) for r in got}) and all(abs(r.affinity - want[r.src, r.dst]) < 1e-9 for r in got)
    assert group_affinity(members(spark, x, group), F.col("n") > 10_000, F.lit(True), k=3, block_rows=block_rows).count() == 0


def test_share_falls_with_size_on_clusters(spark):
    shares = []
    for n in (300, 1200):
        x, report = np.repeat(clustered(n // 2, 12, n // 20), 2, axis=0), {}
        x += 0.01 * np.random.default_rng(0).normal(size=x.shape)
        group_affinity(members(spark, x, np.arange(n) // 2), F.lit(True), F.lit(True), least=0.9, block_rows=25, report=report).count()
        shares.append(report["share"])
    assert shares[1] < shares[0] / 1.4 and shares[1] < 0.2


def test_centroids(spark):
    x, group = data(60)
    x[group == group[-1]] = 0
    got = {r.group_id: np.array(r.centroid) for r in centroids(members(spark, x, group)).collect()}
    for g in np.unique(group):
        m = x[group == g].mean(0)
        assert np.allclose(got[g], m / np.linalg.norm(m) if np.linalg.norm(m) > 1e-8 else m)
    assert centroids(members(spark, x, group).limit(0)).count() == 0
