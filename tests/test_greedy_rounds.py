"""Parallel rounds give what one sequence gives: many small random graphs at once, stars and chains."""

import random

import pytest
from pyspark.sql import functions as F

from tests.test_graph_and_greedy import parts_of
from vistaspark.operators import greedy
from vistaspark.operators.cluster import attach_in_order, tentative_attach
from vistaspark.operators.repair import apply_in_order, apply_proposals
from vistaspark.sources.workspace import Workspace


def proposal_graphs(count=60, seed=1):
    r = random.Random(seed)
    sizes, ordered = {}, []
    for g in range(count):
        nodes = [100 * g + k for k in range(r.randint(2, 12))]
        sizes |= {x: r.choice([1, 1, 2, 3, 5, 13]) for x in nodes}
        ordered += [tuple(r.sample(nodes, 2)) for _ in range(r.randint(1, 30))]
    r.shuffle(ordered)
    return sizes, ordered


def tables(spark, sizes, ordered):
    found = spark.createDataFrame([(a, b, 1.0 - k // 3 / len(ordered), 1 + k % 3, k) for k, (a, b) in enumerate(ordered)], "src long, dst long, score double, phase int, seq int")
    return found.repartition(4), spark.createDataFrame(list(sizes.items()), "group_id long, n long")


@pytest.mark.parametrize("serial, rounds", [(0, 40), (0, 2)])
def test_proposals_in_rounds(spark, serial, rounds):
    sizes, ordered = proposal_graphs()
    want = apply_in_order(sizes, ordered)
    got = {r.group_id: r.root for r in apply_proposals(*tables(spark, sizes, ordered), serial_edges=serial, max_rounds=rounds).collect()}
    assert got == want and any(g != r for g, r in got.items())


def test_stars_and_pair_chains_take_few_rounds(spark):
    """Many singles at one group, a chain of pairs of 10^5 edges: no round is spent on each."""
    n = 100_000
    edges = spark.range(n).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"), F.lit(2).alias("src_n"), F.lit(2).alias("dst_n"), F.col("id").alias("turn"))
    star = spark.range(2000).select((F.col("id") + 10**6).alias("src"), F.lit(10**7).alias("dst"), F.lit(1).alias("src_n"), F.lit(40).alias("dst_n"), (F.col("id") + n).alias("turn"))
    roots, used, left = greedy.merge_rounds(edges.unionByName(star), Workspace(spark, "test-rounds"), serial_edges=0, max_rounds=3)
    assert left.count() == 0 and used.count() == n + 2000
    ends = roots.groupBy("root").count().collect()
    assert sorted(r["count"] for r in ends) == [2001, n + 1]


def attach_graphs(count=60, seed=2):
    r = random.Random(seed)
    scores, images = {}, []
    for g in range(count):
        nodes = [100 * g + k for k in range(r.randint(2, 12))]
        images += nodes
        for _ in range(r.randint(1, 28)):
            a, b = sorted(r.sample(nodes, 2))
            scores[a, b] = ("verified" if r.random() < 0.2 else "tentative", r.randint(0, 20) / 20)
    return images, scores


@pytest.mark.parametrize("serial, rounds", [(0, 40), (0, 2)])
def test_attachments_in_rounds(spark, serial, rounds):
    images, scores = attach_graphs()
    at = {x: k for k, x in enumerate(images)}
    root = parts_of(len(images), [(at[a], at[b]) for (a, b), (d, _) in scores.items() if d == "verified"])
    group = {x: images[root[k]] for x, k in at.items()}
    want = attach_in_order(group, [(a, b, c) for (a, b), (d, c) in scores.items() if d == "tentative"])
    assigned = spark.createDataFrame([(x, g, "s", 1.0, g) for x, g in group.items()], "index long, group_id long, status string, confidence double, home long")
    frame = spark.createDataFrame([(a, b, d, c) for (a, b), (d, c) in scores.items()], "i long, j long, decision string, confidence double").repartition(3)
    out = tentative_attach(assigned, frame, serial_edges=serial, max_rounds=rounds).collect()
    assert {r["index"]: (r.group_id, r.confidence) for r in out if r.status == "tentative"} == want and len(want) > 20
    assert all(r.group_id == group[r["index"]] for r in out if r.status == "s") and len(out) == len(images)
