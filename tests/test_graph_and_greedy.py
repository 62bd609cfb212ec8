"""Components and the greedy steps against whole-graph models."""

import random

from hypothesis import given, settings
from hypothesis import strategies as st

from vistaspark.operators.cluster import attach_in_order
from vistaspark.operators.graph import connected_components
from vistaspark.operators.repair import apply_in_order


def parts_of(n, edges):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(x) for x in range(n)]


def test_components_equal_union_find(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(300 + k, 301 + k) for k in range(60)] + [(400, 400 + k) for k in range(80)]
    want = parts_of(500, edges)
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "i long, j long")).collect()}
    touched = {x for e in edges for x in e}
    assert got == {x: want[x] for x in touched}
    assert connected_components(spark.createDataFrame([], "i long, j long")).count() == 0


graphs = st.lists(st.tuples(st.integers(0, 11), st.integers(0, 11), st.booleans(), st.integers(0, 20)), max_size=30)


@settings(max_examples=150, deadline=None)
@given(graphs)
def test_attachment_decomposes_by_component(edges):
    edges = list({(min(a, b), max(a, b)): (min(a, b), max(a, b), v, c / 20) for a, b, v, c in edges if a != b}.values())
    group = dict(enumerate(parts_of(12, [(a, b) for a, b, v, _ in edges if v])))
    tentative = [(a, b, c) for a, b, v, c in edges if not v]
    whole = attach_in_order(group, tentative)
    closed = parts_of(12, [(a, b) for a, b, *_ in edges])
    apart = {}
    for p in set(closed):
        apart |= attach_in_order({x: g for x, g in group.items() if closed[x] == p}, [e for e in tentative if closed[e[0]] == p])
    assert whole == apart
    assert all(list(group.values()).count(group[x]) == 1 for x in whole)


def test_attachment_rules():
    group = {0: 0, 1: 0, 2: 2, 3: 3, 4: 3}
    assert attach_in_order(group, [(1, 2, 0.8)]) == {2: (0, 0.8)}
    assert attach_in_order(group, [(1, 2, 0.8), (2, 3, 0.76)]) == {}
    assert attach_in_order(group, [(1, 2, 0.8), (2, 3, 0.74)]) == {2: (0, 0.8)}
    assert attach_in_order({0: 0, 1: 1}, [(0, 1, 0.9)]) == {}
    assert attach_in_order({0: 0, 1: 0, 2: 2, 3: 2}, [(0, 2, 0.9)]) == {}


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 9), st.integers(0, 9)), max_size=25), st.lists(st.sampled_from([1, 1, 2, 3, 5, 13]), min_size=10, max_size=10))
def test_proposals_decompose_by_component(ordered, sizes):
    ordered = [(a, b) for a, b in ordered if a != b]
    sizes = dict(enumerate(sizes))
    whole = apply_in_order(sizes, ordered)
    closed = parts_of(10, ordered)
    apart = {}
    for p in set(closed):
        apart |= apply_in_order({g: n for g, n in sizes.items() if closed[g] == p}, [e for e in ordered if closed[e[0]] == p])
    assert whole == apart


def test_proposal_rules():
    assert apply_in_order({0: 1, 1: 4, 2: 4}, [(0, 1), (0, 2)]) == {0: 0, 1: 0, 2: 2}
    assert apply_in_order({0: 1, 1: 1, 2: 1}, [(0, 1), (2, 1)]) == {0: 0, 1: 0, 2: 2}
    assert apply_in_order({0: 2, 1: 4, 2: 4}, [(0, 1), (0, 2)]) == {0: 0, 1: 0, 2: 2}
    assert apply_in_order({0: 13, 1: 4}, [(0, 1)]) == {0: 0, 1: 1}
    assert apply_in_order({0: 3, 1: 4, 2: 5}, [(0, 1), (0, 2)]) == {0: 0, 1: 0, 2: 0}


def test_greedy_query_covers_every_group(spark):
    from tests.conftest import SF
    from vistaspark.plans import registry

    of = {r["index"]: r.group_id for r in registry._partition(spark, SF, registry.LINK).collect()}
    sizes = {g: list(of.values()).count(g) for g in of.values()}
    best = {}
    for r in registry.pair_scores(spark, SF).withColumn("support", registry.D.member_support()).where("support is not null").collect():
        for a, b in ((r.i, r.j), (r.j, r.i)):
            if of[a] != of[b]:
                best.setdefault((of[a], of[b]), {}).setdefault(a, []).append(r.support)
    averages = {e: sum(map(max, m.values())) / len(m) for e, m in best.items()}
    ordered = sorted((-int(10 * v + 0.5), e) for e, v in averages.items() if v >= 0.6)
    want = apply_in_order(sizes, [e for _, e in ordered])
    got = {r.group_id: r.root for r in registry.QUERIES["greedy_proposals"](spark, SF).collect()}
    assert len(sizes) > 40 and got == want and any(g != root for g, root in got.items())


def test_bridge_query_asks_for_the_default_number_of_pairs(spark, monkeypatch):
    from tests.conftest import SF
    from vistaspark.config import EngineConfig
    from vistaspark.plans import registry

    asked, plain = [], registry.large.bridge_candidates
    monkeypatch.setattr(registry.large, "bridge_candidates", lambda *a: asked.append(a[-1]) or plain(*a))
    assert registry.QUERIES["bridge_candidates"](spark, SF).count() > 0 and asked == [EngineConfig().bridge_max_pairs]


def test_medium_matches_are_asked_of_the_partition(spark, monkeypatch):
    """Groups are those of the partition by similarity, not sets of index numbers."""
    from tests.conftest import SF
    from vistaspark.plans import registry

    of = {r["index"]: r.component for r in registry._partition(spark, SF, registry.LINK).collect()}
    asked, plain = [], registry.repair.medium_matches
    monkeypatch.setattr(registry.repair, "medium_matches", lambda found: asked.append(found) or plain(found))
    registry.QUERIES["group_match_medium"](spark, SF)
    rows = asked[0].select("src", "dst", "member", "target").collect()
    assert rows and all((of[r.member], of[r.target]) == (r.src, r.dst) for r in rows)
