"""Plans: images to groups.

``group`` takes the small plan (score candidates, cluster, repair) below
``large_threshold`` images and a plan for large sets from there on.  Group
columns: index, filename, group_id.
"""

from __future__ import annotations

import logging
import time

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vistaspark.config import EngineConfig
from vistaspark.functions import decisions as D
from vistaspark.operators import cluster as C
from vistaspark.operators import knn, large
from vistaspark.operators.features import extract_compact, extract_features
from vistaspark.operators.graph import connected_components
from vistaspark.operators.order import with_ordinal
from vistaspark.operators.repair import repair
from vistaspark.operators.scoring import score_pairs
from vistaspark.sources.tables import PairCache, fingerprint
from vistaspark.sources.workspace import Workspace


def group_core(images: DataFrame, cfg: EngineConfig = EngineConfig()) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(assignments, pair scores, features); assignments as ``cluster.cluster`` gives them.  Raises without images."""
    spark = images.sparkSession
    work = Workspace(spark, "core")
    names = images.select("index", "filename")
    features = work.put(extract_features(images, cfg.max_size, cfg.features_per_variant), "features")
    if features.isEmpty():
        raise ValueError("no images")
    pairs = work.put(knn.candidate_pairs(features, cfg.max_candidates, cfg.disable_pruning, block_rows=cfg.block_rows), "pairs")
    cache = PairCache(spark, cfg.pair_cache_path, fingerprint(cfg.thresholds, cfg.max_size, cfg.features_per_variant)) if cfg.pair_cache_path else None
    scores = work.put(score_pairs(pairs, features, names, cfg.thresholds, cache), "scores")
    return work.put(C.cluster(names, scores), "assigned"), scores, features


def group_small(images: DataFrame, cfg: EngineConfig = EngineConfig()) -> DataFrame:
    """Core grouping, then repair; repairs always go by default thresholds."""
    assigned, scores, features = group_core(images, cfg)
    names = images.select("index", "filename")
    described = names.join(features.select("index", "descriptor"), "index")
    default = EngineConfig().thresholds
    return repair(described, assigned.select("index", "group_id"), scores, lambda pairs: score_pairs(pairs, features, names, default))


def _compact(images: DataFrame, cfg: EngineConfig) -> tuple[DataFrame, DataFrame, Workspace]:
    work = Workspace(images.sparkSession, "large")
    compact = work.put(extract_compact(images, cfg.large_max_size), "compact")
    if cfg.large_blockwise_candidates:
        pairs = knn.neighbor_pairs(compact, cfg.large_neighbors, cfg.large_candidate_min_similarity, block_rows=cfg.block_rows)
    else:
        pairs = knn.approximate_neighbor_pairs(compact, cfg.large_neighbors)
    return compact, work.put(pairs, "pairs"), work


def group_compact(images: DataFrame, cfg: EngineConfig = EngineConfig()) -> DataFrame:
    compact, pairs, _ = _compact(images, cfg)
    return large.compact_components(compact, pairs, cfg.large_min_similarity, cfg.large_max_aspect_delta).drop("component")


def group_bridge(images: DataFrame, cfg: EngineConfig = EngineConfig()) -> DataFrame:
    """Compact components, joined where the geometry of a borderline pair between two of them is verified."""
    began = time.monotonic()
    compact, pairs, work = _compact(images, cfg)
    base = work.put(large.compact_components(compact, pairs, cfg.large_min_similarity, cfg.large_max_aspect_delta).drop("component"), "base")
    asked = work.put(large.bridge_candidates(
        compact, base, pairs, cfg.bridge_min_similarity, cfg.large_min_similarity, cfg.large_max_aspect_delta, cfg.bridge_edges_per_component_pair, cfg.bridge_max_pairs), "asked")
    # At most bridge_max_pairs rows: a number for each, in order of similarity, deals them into batches.
    from pyspark.sql import Window

    turn = (F.row_number().over(Window.orderBy(F.col("sim").desc(), "i", "j")) - 1) / max(1, cfg.bridge_batch_size)
    asked = work.put(asked.withColumn("batch", F.floor(turn).cast("int")), "batches")
    last = asked.agg(F.max("batch")).first()[0]
    names, accepted = images.select("index", "filename"), None
    for batch in range(0 if last is None else last + 1):
        if time.monotonic() - began >= cfg.bridge_time_budget:
            log.warning("bridge time budget: %d of %d batches of pairs not scored", last + 1 - batch, last + 1)
            break
        some = asked.where(F.col("batch") == batch)
        used = some.select(F.explode(F.array("i", "j")).alias("index")).distinct()
        features = work.put(extract_features(images.join(used, "index", "left_semi"), cfg.large_component_max_size, cfg.large_component_features), f"features{batch}")
        scored = score_pairs(some, features, names, EngineConfig().thresholds).where(D.bridge_accepts(cfg.bridge_accept_strong_reject))
        done = work.put(scored.select(F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j")).join(some, ["i", "j"]).select("group_i", "group_j"), f"accepted{batch}")
        work.drop(f"features{batch}")
        accepted = done if accepted is None else accepted.unionByName(done)
    if accepted is None:
        return base
    joined = connected_components(accepted, "group_i", "group_j")
    merged = base.join(joined, base["group_id"] == joined["node"], "left").select("index", "filename", F.coalesce("component", "group_id").alias("component"))
    return large.number_by_name(merged).drop("component")


def _refine(images: DataFrame, fine: DataFrame, cfg: EngineConfig, work: Workspace, tag: str) -> DataFrame:
    """(index, filename, component): the core plan within each component (index, component) of fine; a group's name is its least index."""
    from pyspark.sql import Window

    from vistaspark.operators.repair import dot

    names = images.select("index", "filename")
    features = work.put(extract_features(images.join(fine, "index", "left_semi"), cfg.large_component_max_size, cfg.large_component_features), f"features{tag}")
    described = features.select("index", "descriptor").join(fine.select("index", "component"), "index")
    # Components are small, so a top-k join within each is a join on the component and a window.
    a = described.select("component", F.col("index").alias("i"), F.col("descriptor").alias("da"))
    b = described.select("component", F.col("index").alias("j"), F.col("descriptor").alias("db"))
    near = a.join(b, "component").where("i <> j").select("i", "j", F.round(dot(F.col("da"), F.col("db")), knn.DECIMALS).alias("sim"))
    top = near.withColumn("rank", F.row_number().over(Window.partitionBy("i").orderBy(F.col("sim").desc(), "j"))).where(F.col("rank") <= cfg.large_component_candidates)
    wanted = work.put(knn.undirected(top), f"wanted{tag}")
    scores = work.put(score_pairs(wanted, features, names, EngineConfig().thresholds), f"scores{tag}")
    members = names.join(fine, "index", "left_semi")
    refined = work.put(C.cluster(members, scores).select("index", "filename", "group_id"), f"clustered{tag}")
    if cfg.large_component_postpass:
        refined = repair(members.join(features.select("index", "descriptor"), "index"), refined.select("index", "group_id"), scores, None)
    least = F.min("index").over(Window.partitionBy("group_id"))
    done = work.put(refined.select("index", "filename", least.alias("component")), f"refined{tag}")
    work.drop(f"features{tag}")
    return done


def by_falling_size(fine: DataFrame, batch_images: int, work: Workspace) -> DataFrame:
    """fine (index, component, n) with ``batch``: components by falling size (ties: the least component), dealt into batches of about ``batch_images`` images.

    A component is in the batch that its first image's place falls into, so batches
    hold whole components and are numbered from 0, with gaps where a component is
    larger than a batch.
    """
    placed = with_ordinal(fine.select("index", "component", "n", (-F.col("n")).alias("__less")), ["__less", "component", "index"], "__place")
    begin = placed.groupBy("component").agg(F.min("__place").alias("__begin"))
    batched = placed.join(begin, "component").withColumn("batch", F.floor(F.col("__begin") / batch_images).cast("long"))
    return work.put(batched.select("index", "component", "n", "batch"), "batched")


def group_hybrid(images: DataFrame, cfg: EngineConfig = EngineConfig()) -> DataFrame:
    """Loose components of bounded size, each refined by the core plan; those that stay too large are kept whole.

    All components are refined in one run of the core plan: candidates are drawn
    within components, so nothing joins two of them.  With a time budget they go in
    batches by falling size, and the budget is looked at between batches: what is
    refined is the largest components up to some size, the others are kept whole.
    """
    began = time.monotonic()
    compact, pairs, work = _compact(images, cfg)
    steps, ladder = cfg.large_super_min_similarity + 0.04, []
    while steps <= 0.98:
        ladder.append(steps)
        steps += 0.04
    parts = work.put(large.bounded_components(compact, pairs, cfg.large_super_min_similarity, cfg.large_max_component_size, cfg.large_max_aspect_delta, ladder), "parts")
    fine = parts.where((F.col("n") > 1) & (F.col("n") <= cfg.large_max_component_size))
    names = images.select("index", "filename")
    bounded = cfg.large_hybrid_time_budget != float("inf")
    fine = by_falling_size(fine, cfg.large_hybrid_batch_images, work) if bounded else fine.withColumn("batch", F.lit(0))
    # One number a batch, of some thousand images each.
    batches = sorted(r["batch"] for r in fine.select("batch").distinct().collect())
    refined = None
    for k, batch in enumerate(batches):
        if time.monotonic() - began >= cfg.large_hybrid_time_budget:
            log.warning("hybrid time budget: %d of %d batches of components not refined", len(batches) - k, len(batches))
            fine = fine.where(F.col("batch") < batch)
            break
        done = _refine(images, fine.where(F.col("batch") == batch), cfg, work, str(batch))
        refined = done if refined is None else refined.unionByName(done)
    whole = parts if refined is None else parts.join(fine.select("index"), "index", "left_anti")
    whole = whole.join(names, "index").select("index", "filename", (-1 - F.col("component")).alias("component"))
    return large.number_by_name(whole if refined is None else refined.unionByName(whole)).drop("component")


#: What a time budget (off by default) has cut is reported here.
log = logging.getLogger(__name__)
STRATEGIES = {"bridge": group_bridge, "hybrid": group_hybrid, "compact": group_compact}


def group(images: DataFrame, cfg: EngineConfig = EngineConfig()) -> DataFrame:
    """(index, filename, group_id), groups numbered from 0 by least filename."""
    if images.select("index").count() >= cfg.large_threshold:
        return STRATEGIES[cfg.large_strategy](images, cfg)
    return group_small(images, cfg)
