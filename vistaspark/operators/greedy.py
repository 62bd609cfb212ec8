"""Greedy steps in order of score, taken in parallel rounds that give what one sequence gives.

An edge can be decided as soon as nothing undecided before it can change what it
looks at.  A round decides all such edges at once; what they join becomes one node
for the next round.  A step's own rules say what an edge looks at:

* proposals (``merge_rounds``): whether its ends are joined already (no earlier
  edge at one of its two merged ends is undecided) and whether a single or a pair
  has been used (no earlier edge that could use it is undecided);
* attachments (``attach_rounds``): the groups of a lone image's neighbours (no
  earlier edge of the image or of a neighbour that is still alone is undecided).

Rounds are needed while many edges are left.  Few edges (``serial_edges``, a bound
that changes no result) are finished component by component in order, and so is
what long chains of dependent edges leave after ``max_rounds``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vistaspark.operators.graph import connected_components
from vistaspark.sources.workspace import Workspace


def _least_at(edges: DataFrame, ends: list[str], name: str, where: dict[str, object] | None = None) -> DataFrame:
    """(name, first): the first turn among edges at each end; ``where``: a condition for each end."""
    at = None
    for e in ends:
        some = edges.where(where[e]) if where and e in where else edges
        side = some.select(F.col(e).alias(name), "turn")
        at = side if at is None else at.unionByName(side)
    return at.groupBy(name).agg(F.min("turn").alias("first"))


def merge_rounds(edges: DataFrame, work: Workspace, serial_edges: int = 100_000, max_rounds: int = 24) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Decides proposals (src, dst, src_n, dst_n, turn) while more than ``serial_edges`` are open.

    Gives (group, root) of groups that were merged, groups used up (group), and the
    edges still open with their merged ends ``a`` and ``b``.  Turns are distinct;
    proposals of sources of more than 12 are left out.
    """
    spark = edges.sparkSession
    open_edges = work.put(edges.where("src_n <= 12 AND src <> dst").select("src", "dst", "src_n", "dst_n", "turn", F.col("src").alias("a"), F.col("dst").alias("b")), "open0")
    roots = spark.createDataFrame([], "group long, root long")
    used = spark.createDataFrame([], "group long")
    both_single = F.expr("src_n = 1 AND dst_n = 1")
    for k in range(1, max_rounds + 1):
        if open_edges.count() <= serial_edges:
            break
        joins = _least_at(open_edges, ["a", "b"], "node")
        flags = _least_at(open_edges, ["src", "dst"], "group", {"src": F.col("src_n") <= 2, "dst": both_single})
        side = lambda t, key, to, out: t.select(F.col(key).alias(to), F.col("first").alias(out))
        known = (
            open_edges.join(side(joins, "node", "a", "at_a"), "a").join(side(joins, "node", "b", "at_b"), "b")
            .join(side(flags, "group", "src", "use_src"), "src", "left").join(side(flags, "group", "dst", "use_dst"), "dst", "left")
        )
        now = known.where(
            ((F.col("turn") == F.col("at_a")) | (F.col("turn") == F.col("at_b")))
            & ((F.col("src_n") > 2) | (F.col("turn") == F.col("use_src"))) & (~both_single | (F.col("turn") == F.col("use_dst"))))
        now = work.put(now.select("src", "dst", "src_n", "dst_n", "turn", "a", "b"), f"now{k}")
        spent = now.where("src_n <= 2").select(F.col("src").alias("group")).unionByName(now.where(both_single).select(F.col("dst").alias("group")))
        used = work.put(used.unionByName(spent).distinct(), f"used{k}")
        merged = work.put(connected_components(now, "a", "b"), f"merged{k}")
        to = lambda c: merged.select(F.col("node").alias(c), F.col("component").alias(f"{c}_to"))
        grown = roots.join(merged.select(F.col("node").alias("root"), "component"), "root", "left").select("group", F.coalesce("component", "root").alias("root"))
        fresh = merged.join(roots, merged["node"] == roots["group"], "left_anti").select(F.col("node").alias("group"), F.col("component").alias("root"))
        roots = work.put(grown.unionByName(fresh), f"roots{k}")
        left = (
            open_edges.join(now.select("turn"), "turn", "left_anti").join(to("a"), "a", "left").join(to("b"), "b", "left")
            .withColumn("a", F.coalesce("a_to", "a")).withColumn("b", F.coalesce("b_to", "b")).where("a <> b")
        )
        spent_src, spent_dst = used.select(F.col("group").alias("src"), F.lit(True).alias("src_used")), used.select(F.col("group").alias("dst"), F.lit(True).alias("dst_used"))
        left = left.join(spent_src, "src", "left").join(spent_dst, "dst", "left").where(
            ~((F.col("src_n") <= 2) & F.coalesce("src_used", F.lit(False))) & ~(both_single & F.coalesce("dst_used", F.lit(False))))
        open_edges = work.put(left.select("src", "dst", "src_n", "dst_n", "turn", "a", "b"), f"open{k}")
    return roots, used, open_edges


def attach_rounds(images: DataFrame, edges: DataFrame, work: Workspace, margin: float, serial_edges: int = 100_000, max_rounds: int = 24) -> tuple[DataFrame, DataFrame]:
    """Decides attachments of lone images while more than ``serial_edges`` edges are open.

    ``images``: (index, group_id, alone); ``edges``: (a, b, confidence, turn), turns
    distinct and by falling confidence.  Gives (index, group_id, alone, to_confidence)
    of all images, and the open edges.  An edge between two images that are not
    alone decides nothing; one between two lone images is passed over in its turn.
    """
    state = work.put(images.select("index", "group_id", "alone", F.lit(None).cast("double").alias("to_confidence")), "state0")
    both = edges.select(F.col("a").alias("x"), F.col("b").alias("y"), "confidence", "turn").unionByName(edges.select(F.col("b").alias("x"), F.col("a").alias("y"), "confidence", "turn"))
    both = work.put(both, "both")
    open_turns = work.put(edges.select("turn"), "turns0")
    for k in range(1, max_rounds + 1):
        # Each lone image's edges, decided ones too: they are its rivals.
        end = lambda p: state.select(F.col("index").alias(p), F.col("group_id").alias(f"{p}_group"), F.col("alone").alias(f"{p}_alone"))
        seen = both.join(end("x"), "x").join(end("y"), "y").join(open_turns.withColumn("open", F.lit(True)), "turn", "left").withColumn("open", F.coalesce("open", F.lit(False)))
        seen = work.put(seen.where("x_alone OR y_alone"), f"seen{k}")
        open_turns = work.put(seen.where("open").select("turn").distinct(), f"turns{k}a")
        if open_turns.count() <= serial_edges:
            break
        first = seen.where("open AND x_alone").groupBy("x").agg(F.min("turn").alias("first"))
        # The first open edge of a lone image; those of its lone neighbours must not come before it.
        mine = seen.where("x_alone").join(first, "x").join(first.select(F.col("x").alias("y"), F.col("first").alias("y_first")), "y", "left")
        ready = mine.groupBy("x").agg(
            F.first("first").alias("first"), F.min(F.when(F.col("y_alone"), F.col("y_first"))).alias("near"),
            F.max_by(F.struct("y", "y_group", "y_alone", "confidence"), F.when(F.col("turn") == F.col("first"), 1)).alias("e"),
        ).where("near IS NULL OR near >= first")
        # Two lone images: passed over.  Else the best edge into yet another group is the rival.
        rival = mine.join(ready.select("x", F.col("e.y_group").alias("target")), "x").where(F.col("y_group") != F.col("target")).groupBy("x").agg(F.max("confidence").alias("rival"))
        judged = work.put(ready.join(rival, "x", "left").select(
            "x", "first", F.col("e.y_group").alias("target"), F.col("e.confidence").alias("confidence"),
            (~F.col("e.y_alone") & (F.col("rival").isNull() | (F.col("rival") <= F.col("e.confidence") - F.lit(margin)))).alias("moves")), f"judged{k}")
        moves = judged.where("moves").select(F.col("x").alias("index"), "target", "confidence")
        open_turns = work.put(open_turns.join(judged.select(F.col("first").alias("turn")), "turn", "left_anti"), f"turns{k}b")
        state = work.put(state.join(moves, "index", "left").select(
            "index", F.coalesce("target", "group_id").alias("group_id"), (F.col("alone") & F.col("target").isNull()).alias("alone"), F.coalesce("confidence", "to_confidence").alias("to_confidence")), f"state{k}")
    return state, edges.join(open_turns, "turn", "left_semi")
