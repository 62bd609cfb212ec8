"""Similarity joins against brute force: pivot cells, equal vectors, the kd-forest's recall and work."""

import numpy as np
import pytest

from vistaspark.operators import kdforest, knn


def clustered(n, dim=16, centres=24, spread=0.05, seed=2):
    """Unit rows around a few directions."""
    rng = np.random.default_rng(seed)
    mid = rng.normal(size=(centres, dim))
    x = mid[rng.integers(0, centres, n)] + spread * np.linalg.norm(mid[0]) * rng.normal(size=(n, dim)) / np.sqrt(dim)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def frame(spark, x, ids=None):
    ids = range(len(x)) if ids is None else ids
    return spark.createDataFrame([(int(i), [float(c) for c in v]) for i, v in zip(ids, x)], "index long, descriptor array<double>").repartition(5)


def plain_top_k(x, k):
    s = np.round(x @ x.T, 6) + 0.0
    np.fill_diagonal(s, -np.inf)
    out = set()
    for i in range(len(x)):
        best = np.lexsort((np.arange(len(x)), -s[i]))[: min(k, len(x) - 1)]
        out |= {(i, int(j), round(float(s[i, j]), 6), r + 1) for r, j in enumerate(best)}
    return out


def same(got, want):
    """Equal but for the last digit of rounded similarities (sums taken in another order), and what that changes among ties."""
    got = {(r.i, r.rank): (r.j, r.sim) for r in got}
    want = {(i, rank): (j, sim) for i, j, sim, rank in want}
    assert got.keys() == want.keys()
    assert all(abs(got[key][1] - want[key][1]) < 2.1e-6 for key in want)
    assert sum(got[key][0] != want[key][0] for key in want) <= 0.01 * len(want)


@pytest.mark.parametrize("block_rows", [40, 5000])
def test_top_k_over_cells(spark, block_rows):
    x = clustered(500)
    report = {}
    same(knn.top_k(frame(spark, x), 4, block_rows=block_rows, report=report).collect(), plain_top_k(x, 4))
    assert block_rows > 500 or report["share"] < 0.5


def test_top_k_without_structure_and_of_unequal_lengths(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(150, 6)) * rng.choice([0, 0.1, 1, 3], size=(150, 1))
    same(knn.top_k(frame(spark, x), 3, block_rows=20).collect(), plain_top_k(x, 3))
    same(knn.top_k(frame(spark, x[:3]), 5).collect(), plain_top_k(x[:3], 5))
    assert knn.top_k(frame(spark, x[:1]), 5).count() == 0 and knn.top_k(frame(spark, x).limit(0), 5).count() == 0


def test_share_of_pairs_met_falls_with_size_on_clusters(spark):
    shares = []
    for n in (400, 1600):
        report = {}
        knn.top_k(frame(spark, clustered(n, centres=n // 25)), 3, block_rows=25, report=report).count()
        shares.append(report["share"])
    # Four times the rows: less than a third of the share, so work grows below four times the power 1.25.
    assert shares[1] < shares[0] / 2.5 and shares[1] < 0.1


def test_copies_of_one_vector_in_top_k(spark):
    x = np.concatenate([clustered(60), np.repeat(clustered(3, seed=5), [90, 2, 1], axis=0)])
    x = x[np.random.default_rng(0).permutation(len(x))]
    same(knn.top_k(frame(spark, x), 4, block_rows=16).collect(), plain_top_k(x, 4))
    copies = np.repeat(clustered(1), 50, axis=0)
    same(knn.top_k(frame(spark, copies), 3).collect(), plain_top_k(copies, 3))
    same(knn.approximate_top_k(frame(spark, copies), 3).collect(), plain_top_k(copies, 3))


@pytest.mark.parametrize("least", [0.9, -0.2, None])
def test_similar_pairs_over_cells(spark, least):
    x = clustered(220, centres=10)
    report = {}
    got = {(r.i, r.j): r.sim for r in knn.similar_pairs(frame(spark, x), least, block_rows=25, report=report).collect()}
    s = np.round(x @ x.T, 6)
    want = {(i, j): s[i, j] for i in range(220) for j in range(i + 1, 220) if least is None or s[i, j] >= least}
    assert got.keys() == want.keys() and all(abs(got[p] - want[p]) < 2e-6 for p in want)
    assert least != 0.9 or report["share"] < 0.7


def recall(x, got, k):
    want = {(i, j) for i, j, _, _ in plain_top_k(x, k)}
    return len(want & {(r.i, r.j) for r in got}) / len(want)


def test_forest_recall_and_work(spark):
    loose = np.random.default_rng(3).normal(size=(900, 24))
    loose /= np.linalg.norm(loose, axis=1, keepdims=True)
    for x, most in ((clustered(1500, 32, 60), 0.25), (clustered(900, 8, 5, 0.6), 0.5), (loose, 1.0)):
        report = {}
        got = knn.approximate_top_k(frame(spark, x), 5, report=report, leaf_rows=16).collect()
        assert recall(x, got, 5) >= 0.9 and report["share"] <= most, report
        s = x @ x.T
        assert all(abs(r.sim - s[r.i, r.j]) < 2e-6 for r in got) and (most < 1 or min(r.sim for r in got) < 0.45)
        assert all(r.rank <= 5 for r in got)


def test_tree_bounds_order_leaves_as_best_bin_first():
    """A queue that always opens the nearest branch gives leaves in the order of their bounds."""
    import heapq

    rng = np.random.default_rng(4)
    x = rng.normal(size=(400, 6))
    tree = kdforest.Tree.fit(x, 5, rng)
    q = rng.normal(size=(7, 6))
    order, bounds = kdforest.leaf_order([tree], q), tree.bounds(q)
    for row in range(7):
        queue, popped = [(0.0, 0)], []
        while queue:
            cost, node = heapq.heappop(queue)
            if node >= len(tree.dims):
                popped.append(cost)
                continue
            gap = q[row, tree.dims[node]] - tree.cuts[node]
            heapq.heappush(queue, (cost + max(gap, 0) ** 2, 2 * node + 1))
            heapq.heappush(queue, (cost + max(-gap, 0) ** 2, 2 * node + 2))
        assert np.allclose(popped, bounds[row][order[row]])
    assert (bounds[np.arange(7), tree.leaf(q)] == 0).all() and set(tree.leaf(x)) <= set(range(32))


def test_forest_of_few_rows(spark):
    x = clustered(30)
    assert recall(x, knn.approximate_top_k(frame(spark, x), 4).collect(), 4) == 1.0
    assert knn.approximate_top_k(frame(spark, x).limit(0), 4).count() == 0
    assert knn.approximate_top_k(frame(spark, x[:1]), 4).count() == 0
