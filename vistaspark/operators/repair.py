"""Repair of an over-segmented grouping: merge singles, pairs and medium fragments into groups that support them.

Tables: ``members`` (group_id, index, filename, descriptor, n); ``scores`` with
metrics per pair.  A *support* is how well a pair speaks for a merge (NULL: not).
Groups are ranked by affinity of their descriptors, pairs to score are requested
for the best of them, supports are folded into matches between groups, matches
become proposals, and proposals are applied in order of score.
"""

from __future__ import annotations

from collections.abc import Callable, Collection

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vistaspark.functions import decisions as D
from vistaspark.operators.affinity import group_affinity
from vistaspark.operators.graph import connected_components
from vistaspark.operators.greedy import merge_rounds
from vistaspark.operators.order import with_ordinal
from vistaspark.sources.workspace import Workspace


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def group_members(images: DataFrame, assigned: DataFrame) -> DataFrame:
    """(group_id, index, filename, descriptor, n)."""
    sizes = assigned.groupBy("group_id").agg(F.count(F.lit(1)).alias("n"))
    sized = assigned.select("index", "group_id").join(sizes, "group_id")
    return sized.join(images.select("index", "filename", "descriptor"), "index").select("group_id", "index", "filename", "descriptor", "n")


def rank_targets(affinity: DataFrame, k: int) -> DataFrame:
    """The k targets of highest affinity of each source, larger group numbers first among equals; adds ``rank``."""
    order = Window.partitionBy("src").orderBy(F.col("affinity").desc(), F.col("dst").desc())
    return affinity.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def size_ratio() -> Column:
    return F.greatest("src_n", "dst_n") / F.least("src_n", "dst_n")


def medium_source() -> Column:
    return F.col("n").between(3, 12)


def medium_target() -> Column:
    return F.col("n").between(3, 16)


def targets(members: DataFrame, tail: float = 0.52, medium: float = 0.60, kinds: Collection[str] = ("single", "tail", "medium")) -> dict[str, DataFrame]:
    """Ranked targets of singles, tails (pairs) and medium groups; ``tail`` and ``medium`` are their least affinities."""
    ranked = {
        "single": lambda: rank_targets(group_affinity(members, F.col("n") == 1, F.lit(True), k=24), 24),
        "tail": lambda: rank_targets(group_affinity(members, F.col("n") == 2, F.col("n") >= 4, least=tail, k=16), 16),
        "medium": lambda: rank_targets(group_affinity(members, medium_source(), medium_target(), least=medium, ratio=4.0, k=8), 8),
    }
    return {kind: ranked[kind]() for kind in kinds}


def member_candidates(ranked: DataFrame, members: DataFrame, k: int = 8) -> DataFrame:
    """(src, dst, src_n, dst_n, rank, member, target, member_rank): each source member's k most similar target members."""
    side = lambda p, i: members.select(F.col("group_id").alias(p), F.col("index").alias(i), F.col("filename").alias(f"{i}_name"), F.col("descriptor").alias(f"{i}_d"))
    order = Window.partitionBy("src", "dst", "member").orderBy(F.col("sim").desc(), "target_name")
    return (
        ranked.join(side("src", "member"), "src").join(side("dst", "target"), "dst")
        .withColumn("sim", F.round(dot(F.col("member_d"), F.col("target_d")), 6)).withColumn("member_rank", F.row_number().over(order)).where(F.col("member_rank") <= k)
        .select("src", "dst", "src_n", "dst_n", "rank", "member", "target", "member_rank")
    )


def pair_requests(members: DataFrame, scores: DataFrame, ranked: dict[str, DataFrame]) -> DataFrame:
    """(i, j), i < j: pairs the repair needs and ``scores`` lacks."""
    asked = [member_candidates(r, members).select("member", "target") for r in ranked.values()]
    asked.append(singles_near(members).select(F.col("left").alias("member"), F.col("right").alias("target")))
    pair = members.where("n = 2").groupBy("group_id").agg(F.min("index").alias("member"), F.max("index").alias("target"))
    asked.append(pair.select("member", "target"))
    union = asked[0]
    for more in asked[1:]:
        union = union.unionByName(more)
    have = scores.select(F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j"))
    return union.select(F.least("member", "target").alias("i"), F.greatest("member", "target").alias("j")).distinct().join(have, ["i", "j"], "left_anti")


def singles_near(members: DataFrame, least: float = 0.60) -> DataFrame:
    """Pairs of single groups of enough affinity: (src, dst, left, right), src < dst."""
    single = members.where("n = 1")
    near = group_affinity(members, F.col("n") == 1, F.col("n") == 1, least=least).where(F.col("src") < F.col("dst"))
    return near.select("src", "dst").join(single.select(F.col("group_id").alias("src"), F.col("index").alias("left")), "src").join(single.select(F.col("group_id").alias("dst"), F.col("index").alias("right")), "dst")


_METRICS = ["decision", "confidence", "good_matches", "ransac_inliers", "inlier_ratio", "median_reprojection_error", "avg_corner_shift_ratio", "max_corner_shift_ratio", "edge_score", "method"]


def _scored(pairs: DataFrame, scores: DataFrame, left: str, right: str) -> DataFrame:
    keyed = scores.select(F.least("i", "j").alias("__i"), F.greatest("i", "j").alias("__j"), *_METRICS)
    return pairs.join(keyed, (F.least(left, right) == F.col("__i")) & (F.greatest(left, right) == F.col("__j"))).drop("__i", "__j")


def supports(candidates: DataFrame, scores: DataFrame) -> DataFrame:
    """candidates with their pair's metrics, ``support`` (non-null) and ``place`` (1: the member's best in that target group)."""
    order = Window.partitionBy("src", "dst", "member").orderBy(F.col("support").desc(), "member_rank")
    return (
        _scored(candidates, scores, "member", "target").withColumn("support", D.member_support()).where("support is not null")
        .withColumn("tiny", D.tiny_motion_support()).withColumn("place", F.row_number().over(order))
    )


def folded(found: DataFrame) -> DataFrame:
    """Supports of ``supports()`` folded into one row for each two groups: over members their best, over targets those that corroborate."""
    best = F.col("place") == 1
    only = lambda c: F.when(best, F.col(c))
    return found.groupBy("src", "dst", "src_n", "dst_n", "rank").agg(
        F.avg(only("support")).alias("average"), F.min(only("support")).alias("least"), F.count(only("support")).alias("supported"),
        F.count(F.when(best & (F.col("support") >= 0.60), 1)).alias("covered"),
        F.count_distinct(F.when(best & (F.col("support") >= 0.60), F.col("target"))).alias("covered_targets"),
        F.count_distinct(F.when(F.col("support") >= 0.58, F.col("target"))).alias("corroborating"),
        F.max(only("support")).alias("top"), F.max(only("confidence")).alias("top_confidence"), F.max(only("avg_corner_shift_ratio")).alias("top_shift"),
        F.max(only("edge_score")).alias("top_edge"), F.max(only("tiny")).alias("top_tiny"))


def relaxed_matches(found: DataFrame) -> DataFrame:
    """(src, dst, rank, average): every source member supported; one against many needs corroboration or a very strong pair."""
    strong = (F.col("top") >= 0.80) & (F.col("top_confidence") >= 0.80) & (F.col("top_shift") <= 0.05) & (F.col("top_edge") >= 0.25)
    tiny = (F.col("top") >= 0.72) & F.col("top_tiny").isNotNull()
    lone = (F.col("src_n") == 1) & (F.col("dst_n") > 1)
    return folded(found).where(
        (F.col("supported") == F.col("src_n")) & (F.col("average") >= 0.60) & (F.col("least") >= 0.52)
        & (~lone | (F.col("corroborating") >= 2) | strong | tiny)).select("src", "dst", "rank", "average")


def medium_matches(found: DataFrame) -> DataFrame:
    return folded(found).where(
        F.col("src_n").between(3, 12) & F.col("dst_n").between(3, 16) & (size_ratio() <= 4.0) & (F.col("supported") == F.col("src_n"))
        & (F.col("average") >= 0.66) & (F.col("least") >= 0.58) & (F.col("covered") >= F.greatest(F.lit(3), F.ceil(0.75 * F.col("src_n"))))
        & (F.col("covered_targets") >= F.least(F.lit(3), F.col("dst_n")))).select("src", "dst", "rank", "average")


def tail_matches(found: DataFrame, members: DataFrame, scores: DataFrame) -> DataFrame:
    """Pairs of which one image is supported directly and the other through it."""
    pair = members.where("n = 2").groupBy("group_id").agg(F.min("index").alias("one"), F.max("index").alias("two"))
    inner = _scored(pair, scores, "one", "two").where(
        D.accepted() & (F.col("confidence") >= 0.90) & (F.col("ransac_inliers") >= 50) & (F.col("avg_corner_shift_ratio") <= 0.05) & (F.col("max_corner_shift_ratio") <= 0.10)
    ).select(F.col("group_id").alias("src"), F.least(F.lit(0.70), 0.85 * F.col("confidence")).alias("indirect"))
    direct = found.where((F.col("place") == 1) & (F.col("support") >= 0.70)).groupBy("src", "dst", "rank").agg(F.count(F.lit(1)).alias("k"), F.max("support").alias("direct")).where("k = 1")
    return direct.join(inner, "src").withColumn("average", (F.col("direct") + F.col("indirect")) / 2).where("average >= 0.72").select("src", "dst", "rank", "average")


def best_with_margin(matches: DataFrame) -> DataFrame:
    """Each source's best match and the runner-up's average (0 if none)."""
    tie = "rank" if "rank" in matches.columns else "dst"
    order = Window.partitionBy("src").orderBy(F.col("average").desc(), tie)
    return (
        matches.withColumn("second", F.coalesce(F.lead("average").over(order), F.lit(0.0))).withColumn("rn", F.row_number().over(order))
        .where("rn = 1").drop("rn")
    )


def mutual_best(best: DataFrame) -> DataFrame:
    """Sources that are each other's best, once a pair: (src, dst, average), src < dst, the smaller average."""
    back = best.select(F.col("src").alias("__s"), F.col("dst").alias("__d"), F.col("average").alias("__a"))
    return best.join(back, (F.col("dst") == F.col("__s")) & (F.col("src") == F.col("__d"))).where("src < dst").select("src", "dst", F.least("average", "__a").alias("average"))


def _proposal(df: DataFrame, phase: int, score: Column, order: list[Column]) -> DataFrame:
    return df.select("src", "dst", score.alias("score"), F.lit(phase).alias("phase"), F.struct(*[o.cast("double").alias(f"o{k}") for k, o in enumerate(order + [F.lit(0)] * (3 - len(order)))]).alias("seq"))


def proposals(members: DataFrame, scores: DataFrame, ranked: dict[str, DataFrame]) -> DataFrame:
    """(src, dst, score, phase, seq): merges to try; phase and seq give the order among equal scores."""
    single = ranked["single"]
    to_many = relaxed_matches(supports(member_candidates(single.where("dst_n > 1"), members), scores))
    alone = members.where("n = 1").select("group_id", "index")
    to_one = _scored(
        single.where("dst_n = 1").join(alone.select(F.col("group_id").alias("src"), F.col("index").alias("a")), "src").join(alone.select(F.col("group_id").alias("dst"), F.col("index").alias("b")), "dst"),
        scores, "a", "b").select("src", "dst", "rank", D.singleton_support().alias("average")).where("average is not null")
    kinds = to_many.withColumn("need", F.lit(0.62)).unionByName(to_one.withColumn("need", F.lit(0.52)))
    from_single = best_with_margin(kinds).where((F.col("average") >= F.col("need")) & (F.col("average") >= F.col("second") + 0.05))

    near = _scored(singles_near(members), scores, "left", "right").select("src", "dst", D.singleton_support().alias("average")).where("average >= 0.52")
    both = near.select("src", "dst", "average", F.struct(F.col("src").alias("l"), F.col("dst").alias("r"), F.lit(0).alias("s")).alias("met")).unionByName(
        near.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "average", F.struct(F.col("src").alias("l"), F.col("dst").alias("r"), F.lit(1).alias("s")).alias("met")))
    met = F.min("met").over(Window.partitionBy("src"))
    chosen = best_with_margin(both.withColumn("met", met))
    back = chosen.select(F.col("src").alias("__s"), F.col("dst").alias("__d"), F.col("second").alias("__second"))
    mutual = chosen.join(back, (F.col("dst") == F.col("__s")) & (F.col("src") == F.col("__d"))).where(
        (F.col("average") >= F.col("second") + 0.05) & (F.col("average") >= F.col("__second") + 0.05))

    tails = best_with_margin(tail_matches(supports(member_candidates(ranked["tail"], members), scores), members, scores)).where(
        (F.col("average") >= 0.72) & (F.col("average") >= F.col("second") + 0.06))

    medium = medium_matches(supports(member_candidates(ranked["medium"], members), scores))
    best = best_with_margin(medium).where((F.col("average") >= 0.66) & (F.col("average") >= F.col("second") + 0.04))
    each = medium.join(best.select("src"), "src", "left_semi").where("average >= 0.72")
    pairs = mutual_best(best)
    in_pair = pairs.select("src").unionByName(pairs.select(F.col("dst").alias("src")))
    rest = best.join(in_pair, "src", "left_anti").where("average >= 0.72")
    a = F.col("average")
    return (
        _proposal(from_single, 1, a, [F.col("src")])
        .unionByName(_proposal(mutual, 2, a, [F.col("met.l"), F.col("met.r"), F.col("met.s")]))
        .unionByName(_proposal(tails, 3, a, [F.col("src")]))
        .unionByName(_proposal(each, 4, a - 0.03, [F.col("src"), -a, F.col("rank")]))
        .unionByName(_proposal(pairs, 5, a, [F.col("src")]))
        .unionByName(_proposal(rest, 6, a - 0.02, [F.col("src")]))
    )


def apply_in_order(sizes: dict[int, int], ordered: list[tuple[int, int]], used: set[int] = frozenset(), at: dict[int, int] | None = None) -> dict[int, int]:
    """Group to root after greedy merging of one closed set of proposals, best first.

    A single merges once, as source or as a single's target; a pair is a source
    once; sources of 3 to 12 merge freely; larger sources do not.  ``used`` and
    ``at`` (group to the node it is part of) say what went before.
    """
    at = at or {g: g for g in sizes}
    root = {g: g for g in at.values()}

    def find(g: int) -> int:
        while root[g] != g:
            root[g] = root[root[g]]
            g = root[g]
        return g

    used = set(used)
    for src, dst in ordered:
        n = sizes[src]
        if n > 12 or n <= 2 and src in used or n == 1 and sizes[dst] == 1 and dst in used:
            continue
        a, b = find(at[src]), find(at[dst])
        if a == b:
            continue
        root[max(a, b)] = min(a, b)
        if n <= 2:
            used.add(src)
        if n == 1 and sizes[dst] == 1:
            used.add(dst)
    return {g: find(at[g]) for g in sizes}


def apply_proposals(found: DataFrame, sizes: DataFrame, serial_edges: int = 100_000, max_rounds: int = 24) -> DataFrame:
    """(group_id, root) for all groups: proposals applied by falling score, ties by phase and seq (then by src and dst).

    While more than ``serial_edges`` proposals are open, rounds decide all that
    nothing undecided can change; the rest is applied in order, by connected
    components of what is left.
    """
    work = Workspace(found.sparkSession, "proposals")
    n = lambda key: sizes.select(F.col("group_id").alias(key), F.col("n").cast("long").alias(f"{key}_n"))
    known = work.put(found.join(n("src"), "src").join(n("dst"), "dst").withColumn("__worst", -F.col("score")), "found")
    turns = work.put(with_ordinal(known, ["__worst", "phase", "seq", "src", "dst"], "turn").select("src", "dst", "src_n", "dst_n", "turn"), "turns")
    roots, used, left = merge_rounds(turns, work, serial_edges, max_rounds)

    # What is left, by components of merged nodes.
    parts = work.put(connected_components(left, "a", "b"), "parts")
    edges = left.join(parts.select(F.col("node").alias("a"), F.col("component").alias("part")), "a").select("part", "src", "dst", "src_n", "dst_n", "a", "b", "turn")
    spent = used.select(F.col("group").alias("src"), F.lit(True).alias("src_used")), used.select(F.col("group").alias("dst"), F.lit(True).alias("dst_used"))
    edges = work.put(edges.join(spent[0], "src", "left").join(spent[1], "dst", "left"), "edges")

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("turn")
        size = dict(zip(frame["src"], frame["src_n"])) | dict(zip(frame["dst"], frame["dst_n"]))
        at = dict(zip(frame["src"], frame["a"])) | dict(zip(frame["dst"], frame["b"]))
        gone = set(frame["src"][frame["src_used"].notna()]) | set(frame["dst"][frame["dst_used"].notna()])
        to = apply_in_order(size, list(zip(frame["src"], frame["dst"])), gone, at)
        moved = {at[g]: r for g, r in to.items()}
        return pd.DataFrame({"moved": list(moved), "to_root": list(moved.values())})

    merged = work.put(edges.groupBy("part").applyInPandas(run, "moved long, to_root long"), "merged")
    at = sizes.select("group_id").join(roots, sizes["group_id"] == roots["group"], "left").select("group_id", F.coalesce("root", "group_id").alias("node"))
    return at.join(merged, at["node"] == merged["moved"], "left").select("group_id", F.coalesce("to_root", "node").alias("root"))


def repair(images: DataFrame, assigned: DataFrame, scores: DataFrame, score: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """(index, filename, group_id): the grouping after merges; group numbers from 0 by least filename.

    ``score`` gives metrics for pairs (i, j) that ``scores`` lacks; None: such pairs have no support.
    """
    work = Workspace(images.sparkSession, "repair")
    members = work.put(group_members(images, assigned), "members")
    ranked = {k: work.put(r, f"ranked-{k}") for k, r in targets(members).items()}

    def completed(asked: DataFrame, have: DataFrame, name: str) -> DataFrame:
        return have if score is None else work.put(have.unionByName(score(asked), allowMissingColumns=True), name)

    known = completed(pair_requests(members, scores, ranked), scores, "scores")
    sizes = members.select("group_id", "n").distinct()
    roots = work.put(apply_proposals(proposals(members, known, ranked), sizes), "roots")
    merged = work.put(group_members(images, assigned.join(roots, "group_id").select("index", F.col("root").alias("group_id"))), "merged")

    # Follow-up: medium groups as merged.
    later = work.put(rank_targets(group_affinity(merged, medium_target(), medium_target(), least=0.60, ratio=4.0, k=6), 6), "later")
    asked = member_candidates(later, merged).select(F.least("member", "target").alias("i"), F.greatest("member", "target").alias("j")).distinct()
    known = completed(asked.join(known.select(F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j")), ["i", "j"], "left_anti"), known, "scores-later")
    again = medium_matches(supports(member_candidates(later, merged), known)).where("average >= 0.70")
    joined = connected_components(again, "src", "dst")
    final = merged.join(joined, merged["group_id"] == joined["node"], "left").select("index", "filename", F.coalesce("component", "group_id").alias("root"))
    least = final.groupBy("root").agg(F.min("filename").alias("least_name"))
    numbered = with_ordinal(least, ["least_name", "root"], "number")
    return final.join(numbered, "root").select("index", "filename", F.col("number").alias("group_id"))
