"""A time budget of the hybrid plan refines the largest components first."""

import itertools

import pytest
from pyspark.sql import functions as F

from vistaspark.config import EngineConfig
from vistaspark.plans import grouping
from vistaspark.sources.workspace import Workspace

SIZES = [9, 7, 7, 5, 4, 2, 2, 1, 1, 14]


@pytest.fixture(scope="module")
def tables(spark):
    rows, pairs, at = [], [], 0
    for size in SIZES:
        rows += [(at + k, f"{at + k:03d}.png", 640, 480) for k in range(size)]
        pairs += [(at, at + k, 0.99) for k in range(1, size)]
        at += size
    return spark.createDataFrame(rows, "index long, filename string, width int, height int"), spark.createDataFrame(pairs, "i long, j long, sim double")


def run(monkeypatch, spark, tables, budget, batch_images=10):
    """Groups' sizes, with components that are refined cut into single images; every look at the clock takes a second."""
    images, pairs = tables
    clock = itertools.count()
    monkeypatch.setattr(grouping.time, "monotonic", lambda: float(next(clock)))
    monkeypatch.setattr(grouping, "_compact", lambda images, cfg: (images, pairs, Workspace(spark, "budget")))
    alone = lambda images, fine, cfg, work, tag: fine.select("index").join(images.select("index", "filename"), "index").withColumn("component", F.col("index"))
    monkeypatch.setattr(grouping, "_refine", alone)
    cfg = EngineConfig(large_super_min_similarity=0.9, large_max_component_size=12, large_hybrid_time_budget=budget, large_hybrid_batch_images=batch_images)
    out = grouping.group_hybrid(images, cfg).collect()
    assert len(out) == sum(SIZES) and len({r["index"] for r in out}) == len(out)
    return {r["index"]: r["group_id"] for r in out}


def kept_whole(groups):
    sizes = {}
    for g in groups.values():
        sizes[g] = sizes.get(g, 0) + 1
    return sorted(n for n in sizes.values() if n > 1)


def test_what_is_refined_is_a_prefix_by_size(monkeypatch, spark, tables):
    # Places 0, 9 | 16 | 23 | 28 | 32, 34: batches 0, 1, 2, 3; the component of 14 is too large.
    assert kept_whole(run(monkeypatch, spark, tables, 100.0)) == [14]
    two = run(monkeypatch, spark, tables, 2.5)
    assert kept_whole(two) == [2, 2, 4, 5, 14] and run(monkeypatch, spark, tables, 2.5) == two
    assert kept_whole(run(monkeypatch, spark, tables, 0.0)) == [2, 2, 4, 5, 7, 7, 9, 14]
