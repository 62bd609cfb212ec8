"""Joins of vectors without structure: every two blocks meet once; forests in place of all pairs."""

import numpy as np
import pytest

from tests.conftest import SF
from tests.test_knn import frame, plain_top_k, same
from vistaspark.operators import knn
from vistaspark.operators.grid import connecting
from vistaspark.plans import registry


def loose(n, dim=24, seed=3):
    x = np.random.default_rng(seed).normal(size=(n, dim))
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def test_every_two_blocks_meet_once(spark):
    x, report = loose(400), {}
    same(knn.top_k(frame(spark, x), 4, block_rows=30, report=report).collect(), plain_top_k(x, 4))
    assert report["share"] < 0.6
    s = np.round(x @ x.T, 6)
    got = {(r.i, r.j): r.sim for r in knn.similar_pairs(frame(spark, x), 0.1, block_rows=30, report=report).collect()}
    assert got.keys() == {(i, j) for i, j in zip(*np.nonzero(np.triu(s >= 0.1, 1)))} and all(abs(v - s[p]) < 2e-6 for p, v in got.items())


def test_single_precision_only_screens(spark):
    """Ties and lengths far from one: results are those of double precision."""
    x = np.round(loose(300, 6), 1) * np.random.default_rng(0).choice([0.01, 1, 1000], size=(300, 1))
    x = np.unique(x.astype(np.float32).astype(float), axis=0)
    given = frame(spark, x).selectExpr("index", "CAST(descriptor AS array<float>) AS descriptor")
    same(knn.top_k(given, 3, block_rows=10).collect(), plain_top_k(x, 3))


def components(n, pairs):
    label = np.arange(n)
    u, v = (np.array([p[c] for p in pairs], int) for c in (0, 1))
    return connecting(label, u, v)[0]


@pytest.mark.parametrize("block_rows", [15, 4096])
def test_forest_has_the_components_of_all_pairs(spark, block_rows):
    x = loose(260, 8)
    like, levels, s = np.arange(260) % 3 * 0.02, [0.5, 0.7, 0.85], np.round(x @ x.T, 6)
    given = frame(spark, x).selectExpr("*", "index % 3 * 0.02D AS like")
    got = knn.similar_forest(given, levels, "like", 0.03, block_rows=block_rows).collect()
    near = np.abs(like[:, None] - like) <= 0.03
    for level in levels:
        plain = [(i, j) for i, j in zip(*np.nonzero(np.triu((s >= level) & near, 1)))]
        assert (components(260, plain) == components(260, [(r.i, r.j) for r in got if r.sim >= level])).all()
    assert 1 < len(set(components(260, plain))) < 260
    assert all(near[r.i, r.j] and abs(r.sim - s[r.i, r.j]) < 2e-6 and r.i < r.j for r in got)
    assert len(got) < np.triu((s >= 0.5) & near, 1).sum() * (1 if block_rows < 100 else 0.5)


def test_cached_pairs_are_searched_once(spark, monkeypatch):
    calls, plain = [], knn.top_k
    monkeypatch.setattr(knn, "top_k", lambda *a, **kw: calls.append(1) or plain(*a, **kw))
    assert registry.QUERIES["missing_pairs"](spark, SF).count() > 0 and len(calls) == 1


def test_only_the_ranking_asked_for_is_made(spark, monkeypatch):
    asked = []
    monkeypatch.setattr(registry.repair, "group_affinity", lambda members, *a, **kw: asked.append(kw["k"]) or spark.createDataFrame([], "src long, dst long, affinity double"))
    registry.QUERIES["group_affinity_tail"](spark, SF).count()
    assert asked == [16]
