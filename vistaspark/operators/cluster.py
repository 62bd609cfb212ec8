"""Clustering of scored pairs: verified components, tentative attachment, representatives, confidences, numbering.

``images`` has (index, filename); ``scores`` has a row per pair with (i, j,
decision, confidence), either orientation.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vistaspark.operators.graph import connected_components
from vistaspark.operators.greedy import attach_rounds
from vistaspark.operators.order import with_ordinal
from vistaspark.sources.workspace import Workspace


def canonical(scores: DataFrame) -> DataFrame:
    """Accepted pairs as (a, b, decision, confidence) with a < b."""
    return scores.where(F.col("decision").isin("verified", "tentative")).select(
        F.least("i", "j").alias("a"), F.greatest("i", "j").alias("b"), "decision", "confidence")


def components(images: DataFrame, edges: DataFrame) -> DataFrame:
    """(index, component) over edges (i, j), images without an edge included; the component is its least index."""
    found = connected_components(edges.select("i", "j"))
    return images.join(found, images["index"] == found["node"], "left").select(images["index"], F.coalesce("component", "index").alias("component"))


def verified_components(images: DataFrame, scores: DataFrame) -> DataFrame:
    """(index, group_id, status, confidence, home): components of verified pairs; home is where the image started."""
    edges = scores.where(F.col("decision") == "verified").select("i", "j")
    size = F.count(F.lit(1)).over(Window.partitionBy("component"))
    return components(images, edges).withColumn("n", size).select(
        "index", F.col("component").alias("group_id"), F.when(F.col("n") > 1, "verified").otherwise("singleton").alias("status"),
        F.lit(1.0).alias("confidence"), F.col("component").alias("home"))


MARGIN = 0.05


def attach_in_order(
    members: dict[int, int], edges: list[tuple[int, int, float]], margin: float = MARGIN, alone: set[int] | None = None, skip: list[bool] | None = None,
) -> dict[int, tuple[int, float]]:
    """Attachments (image: group, confidence) within one closed set of images and tentative edges.

    Edges go by falling confidence.  One that joins an image alone in its group
    to a group of several moves it there, unless the image's best tentative edge
    into yet another group comes within ``margin``.  Moves change what follows.
    """
    group = dict(members)
    if alone is None:
        size = pd.Series(list(group.values())).value_counts()
        alone = {x for x, g in group.items() if size[g] == 1}
    lone = set(alone)
    order = sorted(range(len(edges)), key=lambda k: (-edges[k][2], edges[k][0], edges[k][1]))
    by_image: dict[int, list[tuple[int, float]]] = {}
    for a, b, c in (edges[k] for k in order):
        by_image.setdefault(a, []).append((b, c))
        by_image.setdefault(b, []).append((a, c))
    moved = {}
    for k in order:
        a, b, c = edges[k]
        if (a in lone) == (b in lone) or skip is not None and skip[k]:
            continue
        one, other = (a, b) if a in lone else (b, a)
        target = group[other]
        rival = next((x for n, x in by_image[one] if group[n] != target), None)
        if rival is not None and rival > c - margin:
            continue
        lone.discard(one)
        group[one] = target
        moved[one] = (target, c)
    return moved


def tentative_attach(assigned: DataFrame, scores: DataFrame, serial_edges: int = 100_000, max_rounds: int = 24) -> DataFrame:
    """``assigned`` with single images attached by tentative pairs.

    While more than ``serial_edges`` tentative pairs are open, rounds decide all that
    nothing undecided can change.  No attachment looks beyond a connected component
    of the pairs that are left and the groups they lead to, so the rest is decided
    by components, in order.
    """
    work = Workspace(assigned.sparkSession, "attach")
    pairs = canonical(scores)
    n = F.count(F.lit(1)).over(Window.partitionBy("group_id"))
    images = assigned.select("index", "group_id", (n == 1).alias("alone"))
    tentative = pairs.where(F.col("decision") == "tentative").select("a", "b", "confidence")
    turns = work.put(with_ordinal(tentative.withColumn("__worst", -F.col("confidence")), ["__worst", "a", "b"], "turn").select("a", "b", "confidence", "turn"), "turns")
    state, left = attach_rounds(images, turns, work, MARGIN, serial_edges, max_rounds)

    # Decided edges of images that are still alone stay as rivals (they come first and decide nothing again).
    alone = state.where("alone").select("index")
    touched = left.select(F.col("a").alias("index")).unionByName(left.select(F.col("b").alias("index"))).distinct().join(alone, "index")
    near = turns.join(touched.select(F.col("index").alias("a")), "a", "left_semi").unionByName(turns.join(touched.select(F.col("index").alias("b")), "b", "left_semi")).distinct()
    near = near.join(left.select("turn", F.lit(True).alias("open")), "turn", "left")
    where = state.select("index", "group_id", "alone")
    ends = near.join(where.select(F.col("index").alias("a"), F.col("group_id").alias("a_group"), F.col("alone").alias("a_alone")), "a").join(
        where.select(F.col("index").alias("b"), F.col("group_id").alias("b_group"), F.col("alone").alias("b_alone")), "b")
    ends = work.put(ends, "ends")
    # Images in groups do not change, so lone images alone hold components together.
    held = ends.select(F.when(F.col("a_alone"), F.col("a")).otherwise(F.col("b")).alias("i"), F.when(F.col("b_alone"), F.col("b")).otherwise(F.col("a")).alias("j")).where(F.col("i").isNotNull())
    closed = work.put(connected_components(held), "closed")
    rest = ends.withColumn("i", F.when(F.col("a_alone"), F.col("a")).otherwise(F.col("b"))).join(closed, F.col("i") == F.col("node"))

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        group = dict(zip(frame["a"], frame["a_group"])) | dict(zip(frame["b"], frame["b_group"]))
        alone = set(frame["a"][frame["a_alone"]]) | set(frame["b"][frame["b_alone"]])
        edges = frame.sort_values("turn")
        opened = set(edges["turn"][edges["open"].notna()])
        moved = attach_in_order(group, list(zip(edges["a"], edges["b"], edges["confidence"])), alone=alone, skip=[t not in opened for t in edges["turn"]])
        return pd.DataFrame([(i, g, c) for i, (g, c) in moved.items()], columns=["moved", "last_group", "last_confidence"])

    moves = rest.groupBy("component").applyInPandas(run, "moved long, last_group long, last_confidence double")
    decided = state.join(moves, state["index"] == moves["moved"], "left").where(F.col("to_confidence").isNotNull() | F.col("last_group").isNotNull()).select(
        F.col("index").alias("moved"), F.coalesce("last_group", "group_id").alias("to_group"), F.coalesce("last_confidence", "to_confidence").alias("to_confidence"))
    return assigned.join(decided, assigned["index"] == decided["moved"], "left").select(
        "index", F.coalesce("to_group", "group_id").alias("group_id"),
        F.when(F.col("moved").isNotNull(), "tentative").otherwise(F.col("status")).alias("status"),
        F.coalesce("to_confidence", "confidence").alias("confidence"), "home")


def _inside(assigned: DataFrame, scores: DataFrame) -> DataFrame:
    """Accepted pairs within groups, in both directions: (group_id, index, other, confidence)."""
    pairs = canonical(scores)
    both = pairs.select(F.col("a").alias("index"), F.col("b").alias("other"), F.col("confidence").alias("pair")).unionByName(
        pairs.select(F.col("b").alias("index"), F.col("a").alias("other"), F.col("confidence").alias("pair")))
    of = assigned.select("index", "group_id")
    return both.join(of, "index").join(of.select(F.col("index").alias("other"), F.col("group_id").alias("other_group")), "other").where("group_id = other_group").drop("other_group")


def representatives(assigned: DataFrame, scores: DataFrame) -> DataFrame:
    """(group_id, representative): the member with the best mean accepted confidence to the others, the first of equals."""
    mean = _inside(assigned, scores).groupBy("index").agg(F.avg("pair").alias("mean"))
    order = Window.partitionBy("group_id").orderBy(F.coalesce("mean", F.lit(0.0)).desc(), "home", "index")
    return (
        assigned.join(mean, "index", "left").withColumn("rn", F.row_number().over(order)).where("rn = 1")
        .select("group_id", F.col("index").alias("representative"))
    )


def member_confidences(assigned: DataFrame, reps: DataFrame, scores: DataFrame) -> DataFrame:
    """assigned with ``representative`` and the member's confidence: 1, its pair with the representative, its best pair, its own."""
    best = (
        _inside(assigned, scores).join(reps, "group_id")
        .groupBy("index").agg(F.max("pair").alias("best"), F.max(F.when(F.col("other") == F.col("representative"), F.col("pair"))).alias("to_rep"))
    )
    chosen = F.when(F.col("index") == F.col("representative"), F.lit(1.0)).otherwise(F.coalesce("to_rep", "best", "confidence"))
    return assigned.join(reps, "group_id").join(best, "index", "left").select("index", "group_id", "status", chosen.alias("confidence"), "representative")


def renumber(assigned: DataFrame, images: DataFrame) -> DataFrame:
    """Groups numbered from 1 in order of their representatives' filenames."""
    names = images.select(F.col("index").alias("representative"), F.col("filename").alias("representative_filename"))
    groups = assigned.select("group_id", "representative").distinct().join(names, "representative")
    numbered = with_ordinal(groups.drop("representative"), ["representative_filename", "group_id"], "number", start=1)
    return (
        assigned.join(numbered, "group_id").join(images.select("index", "filename"), "index")
        .select("index", "filename", F.col("number").alias("group_id"), "status", "confidence", "representative", "representative_filename")
    )


def cluster(images: DataFrame, scores: DataFrame) -> DataFrame:
    """(index, filename, group_id, status, confidence, representative, representative_filename) for every image."""
    work = Workspace(images.sparkSession, "cluster")
    assigned = work.put(tentative_attach(verified_components(images, scores), scores), "assigned")
    reps = work.put(representatives(assigned, scores), "representatives")
    return renumber(member_confidences(assigned, reps, scores), images)


def groups_report(assigned: DataFrame) -> DataFrame:
    """Report rows in file order: angle_id, filename, representative_filename, group_size, confidence, status."""
    size = F.count(F.lit(1)).over(Window.partitionBy("group_id"))
    return assigned.select(
        F.format_string("angle_%03d", "group_id").alias("angle_id"), "filename", "representative_filename", size.alias("group_size"),
        F.format_string("%.4f", F.when(F.col("index") == F.col("representative"), 1.0).otherwise(F.col("confidence"))).alias("confidence"), "status", "group_id",
    ).orderBy("group_id", "filename").drop("group_id")
