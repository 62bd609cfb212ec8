"""Queries over the driver's tables, each with SQL that DuckDB can run.

The tables hold no images, so unit vectors stand in for descriptors, and pair
metrics are synthetic: whole-number arithmetic on the two indexes, the same in
both engines.  They exercise rules and say nothing about image accuracy.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vistaspark.config import EngineConfig
from vistaspark.functions import decisions as D
from vistaspark.operators import cluster as C
from vistaspark.operators import affinity, evaluate, knn, large, repair, scoring
from vistaspark.operators.order import with_ordinal
from vistaspark.schemas import PAIR_SCORE
from vistaspark.sources.tables import PairCache, fingerprint
from vistaspark.sources.workspace import Workspace

K = 12
#: Similarities that give components of moderate size on the driver's vectors.
LINK, TIGHT, LOOSE, WIDE = 0.40, 0.44, 0.36, 0.30
NEIGHBORS, FLOOR = 24, 0.35
#: Least affinities of tails and medium groups; the driver's vectors are too far apart for the defaults, 0.52 and 0.60.
TAIL, MEDIUM = 0.20, 0.20


def images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors as images: index, filename, descriptor, truth, width, height."""
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(
        F.col("vec_id").alias("index"), F.format_string("img_%06d.jpg", "vec_id").alias("filename"), F.col("embedding").alias("descriptor"),
        F.col("label").alias("truth"), (F.lit(640) + F.col("vec_id") % 3 * 8).cast("int").alias("width"), F.lit(480).alias("height"))


IMAGES_SQL = """
images AS (SELECT vec_id AS idx, printf('img_%06d.jpg', vec_id) AS filename, embedding::DOUBLE[] AS d, label AS truth,
                  640 + vec_id % 3 * 8 AS width, 480 AS height FROM embeddings),
sims AS (SELECT a.idx AS i, b.idx AS j, round(list_dot_product(a.d, b.d), 6) AS sim FROM images a JOIN images b ON a.idx < b.idx),
both_ways AS (SELECT i, j, sim FROM sims UNION ALL SELECT j, i, sim FROM sims)"""


def _topk_sql(k: int) -> str:
    return f"""
top AS (SELECT i, j, sim, rank FROM (SELECT *, row_number() OVER (PARTITION BY i ORDER BY sim DESC, j) AS rank FROM both_ways) WHERE rank <= {k}),
cand AS (SELECT least(i, j) AS i, greatest(i, j) AS j, max(sim) AS sim FROM top GROUP BY 1, 2)"""


def with_metrics(pairs: DataFrame, strong: bool = False) -> DataFrame:
    """Synthetic metrics for pairs (i, j); ``strong``: those of pairs that mostly support each other."""
    i, j = F.col("i"), F.col("j")
    good, inl, parts, floor = (80 + (i * 31 + j * 17) % 40, 60 + (i * 13 + j * 29) % 40, (100, 400, 200, 200), 0.5) if strong else (
        (i * 31 + j * 17) % 120, (i * 13 + j * 29) % 100, (10, 100, 50, 100), 0.0)
    inl = F.least(good, inl)
    none = (i + j) % 37 == 0
    return (
        pairs.withColumn("good_matches", good).withColumn("ransac_inliers", inl)
        .withColumn("inlier_ratio", F.round(inl / F.greatest(F.lit(1), good), 4))
        .withColumn("median_reprojection_error", F.when(none, F.lit(float("inf"))).otherwise(((i * 3 + j * 5) % 64).cast("double") / parts[0]))
        .withColumn("avg_corner_shift_ratio", ((i * 7 + j * 11) % 20).cast("double") / parts[1])
        .withColumn("max_corner_shift_ratio", ((i * 7 + j * 11) % 20).cast("double") / parts[2])
        .withColumn("edge_score", F.lit(floor) + ((i * 19 + j * 23) % 100).cast("double") / parts[3])
        .withColumn("method", F.when(none, "none").when((i + 2 * j) % 11 == 0, "ecc_euclidean").otherwise("sift_homography"))
        .withColumn("confidence", D.confidence()).withColumn("decision", D.decision())
    )


def metrics_sql(source: str, name: str = "scores", strong: bool = False) -> str:
    good, inl, (error, avg, most, edge), floor = ("80 + (i * 31 + j * 17) % 40", "60 + (i * 13 + j * 29) % 40", (100, 400, 200, 200), 0.5) if strong else (
        "(i * 31 + j * 17) % 120", "(i * 13 + j * 29) % 100", (10, 100, 50, 100), 0.0)
    return f"""
{name}_raw AS (SELECT i, j, sim, {good} AS good_matches, least({good}, {inl}) AS ransac_inliers,
    round(least({good}, {inl})::DOUBLE / greatest(1, {good})::DOUBLE, 4) AS inlier_ratio,
    CASE WHEN (i + j) % 37 = 0 THEN 'inf'::DOUBLE ELSE ((i * 3 + j * 5) % 64)::DOUBLE / {error}::DOUBLE END AS median_reprojection_error,
    ((i * 7 + j * 11) % 20)::DOUBLE / {avg}::DOUBLE AS avg_corner_shift_ratio, ((i * 7 + j * 11) % 20)::DOUBLE / {most}::DOUBLE AS max_corner_shift_ratio,
    {floor}::DOUBLE + ((i * 19 + j * 23) % 100)::DOUBLE / {edge}::DOUBLE AS edge_score,
    CASE WHEN (i + j) % 37 = 0 THEN 'none' WHEN (i + 2 * j) % 11 = 0 THEN 'ecc_euclidean' ELSE 'sift_homography' END AS method FROM {source}),
{name}_flags AS (SELECT *, good_matches >= 45 AND ransac_inliers >= 25 AND inlier_ratio >= 0.3::DOUBLE AS enough,
    avg_corner_shift_ratio <= 0.08::DOUBLE AND max_corner_shift_ratio <= 0.16::DOUBLE AS motion, median_reprojection_error <= 5 AS reprojection,
    edge_score >= 0.5::DOUBLE OR (ransac_inliers >= 45 AND inlier_ratio >= 0.375::DOUBLE AND median_reprojection_error <= 3.75::DOUBLE) AS structure,
    round(greatest(0::DOUBLE, least(1::DOUBLE,
        0.25::DOUBLE * least(1::DOUBLE, ransac_inliers / 62.5::DOUBLE) + 0.2::DOUBLE * least(1::DOUBLE, inlier_ratio / 0.6::DOUBLE)
        + 0.2::DOUBLE * (CASE WHEN isinf(median_reprojection_error) THEN 0::DOUBLE ELSE greatest(0::DOUBLE, 1 - median_reprojection_error / 10::DOUBLE) END)
        + 0.2::DOUBLE * greatest(0::DOUBLE, 1 - avg_corner_shift_ratio / 0.16::DOUBLE) + 0.15::DOUBLE * least(1::DOUBLE, edge_score / 0.5::DOUBLE))), 4) AS confidence FROM {name}_raw),
{name} AS (SELECT *, CASE WHEN method = 'none' THEN 'reject' WHEN enough AND motion AND reprojection AND structure THEN 'verified'
    WHEN motion AND avg_corner_shift_ratio <= 0.1::DOUBLE AND edge_score >= 0.62::DOUBLE AND (ransac_inliers >= 8 OR method LIKE 'ecc%') THEN 'tentative' ELSE 'reject' END AS decision
    FROM {name}_flags)"""


RELAXED_SQL = """CASE WHEN method <> 'none' AND NOT isinf(median_reprojection_error) AND good_matches >= 40 AND ransac_inliers >= 20 AND inlier_ratio >= 0.28::DOUBLE
    AND median_reprojection_error <= 3 AND avg_corner_shift_ratio <= 1 AND max_corner_shift_ratio <= 1.8::DOUBLE AND edge_score >= 0.14::DOUBLE AND confidence >= 0.45::DOUBLE
  THEN 0.28::DOUBLE * least(1::DOUBLE, ransac_inliers / 60::DOUBLE) + 0.18::DOUBLE * least(1::DOUBLE, good_matches / 100::DOUBLE) + 0.18::DOUBLE * least(1::DOUBLE, inlier_ratio / 0.6::DOUBLE)
    + 0.16::DOUBLE * greatest(0::DOUBLE, 1 - median_reprojection_error / 3::DOUBLE) + 0.1::DOUBLE * greatest(0::DOUBLE, 1 - avg_corner_shift_ratio) + 0.1::DOUBLE * least(1::DOUBLE, edge_score / 0.3::DOUBLE) END"""
SINGLETON_SQL = """CASE WHEN method <> 'none' AND good_matches >= 14 AND ransac_inliers >= 10 AND inlier_ratio >= 0.75::DOUBLE AND median_reprojection_error <= 0.35::DOUBLE
    AND avg_corner_shift_ratio <= 0.6::DOUBLE AND max_corner_shift_ratio <= 0.9::DOUBLE AND edge_score >= 0.3::DOUBLE AND confidence >= 0.52::DOUBLE
  THEN 0.45::DOUBLE * confidence + 0.3::DOUBLE * edge_score + 0.25::DOUBLE * inlier_ratio END"""
TINY_SQL = """CASE WHEN method <> 'none' AND good_matches >= 7 AND ransac_inliers >= 7 AND inlier_ratio >= 0.9::DOUBLE AND median_reprojection_error <= 0.45::DOUBLE
    AND avg_corner_shift_ratio <= 0.12::DOUBLE AND max_corner_shift_ratio <= 0.22::DOUBLE AND edge_score >= 0.3::DOUBLE AND confidence >= 0.6::DOUBLE
  THEN 0.45::DOUBLE * confidence + 0.35::DOUBLE * inlier_ratio + 0.2::DOUBLE * edge_score END"""


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return knn.candidate_pairs(images(spark, sf_dir), K)


def pair_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_metrics(candidates(spark, sf_dir))


def graph_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scored pairs for clustering: similarity at least LOOSE, so that components stay small."""
    work = Workspace(spark, "graph-scores")
    return work.put(with_metrics(knn.similar_pairs(images(spark, sf_dir), LOOSE)), "scores")


CAND = f"WITH RECURSIVE {IMAGES_SQL}, {_topk_sql(K)}"
SCORES = f"{CAND}, {metrics_sql('cand')}"
GRAPH = f"WITH RECURSIVE {IMAGES_SQL}, graph AS (SELECT * FROM sims WHERE sim >= {LOOSE}), {metrics_sql('graph')}"


def components_sql(edges: str, name: str) -> str:
    """Least reachable index over edges (i, j)."""
    return f"""
{name}_e AS (SELECT i, j FROM {edges} UNION SELECT j, i FROM {edges}),
{name}_r AS (SELECT idx AS node, idx AS reach FROM images UNION SELECT e.j, r.reach FROM {name}_r r JOIN {name}_e e ON r.node = e.i WHERE r.reach < e.j),
{name} AS (SELECT node AS idx, min(reach) AS component FROM {name}_r GROUP BY 1)"""


VERIFIED = f"{GRAPH}, ver AS (SELECT i, j FROM scores WHERE decision = 'verified'), {components_sql('ver', 'comp')}"
#: Groups for the queries below: verified components.
GROUPED = f"""{VERIFIED}, acc AS (SELECT i, j, confidence FROM scores WHERE decision <> 'reject'),
acc2 AS (SELECT i AS idx, j AS other, confidence FROM acc UNION ALL SELECT j, i, confidence FROM acc),
inside AS (SELECT c.component, a.idx, a.other, a.confidence FROM acc2 a JOIN comp c ON a.idx = c.idx JOIN comp o ON a.other = o.idx AND c.component = o.component),
reps AS (SELECT component, idx AS representative FROM (
    SELECT c.component, c.idx, row_number() OVER (PARTITION BY c.component ORDER BY coalesce(m.mean, 0) DESC, c.idx) AS rn
    FROM comp c LEFT JOIN (SELECT idx, avg(confidence) AS mean FROM inside GROUP BY 1) m ON c.idx = m.idx) WHERE rn = 1),
conf AS (SELECT c.idx, c.component, r.representative, CASE WHEN c.idx = r.representative THEN 1 ELSE coalesce(b.to_rep, b.best, 1) END AS confidence
    FROM comp c JOIN reps r ON c.component = r.component
    LEFT JOIN (SELECT i.idx, max(i.confidence) AS best, max(CASE WHEN i.other = r.representative THEN i.confidence END) AS to_rep
               FROM inside i JOIN reps r ON i.component = r.component GROUP BY 1) b ON c.idx = b.idx),
numbered AS (SELECT r.component, f.filename AS representative_filename, row_number() OVER (ORDER BY f.filename) AS group_id FROM reps r JOIN images f ON r.representative = f.idx)"""


def _verified(spark, sf_dir):
    scores = graph_scores(spark, sf_dir)
    return C.verified_components(images(spark, sf_dir), scores), scores


def _partition(spark, sf_dir, threshold):
    """Partition of the images by similarity and aspect: (index, filename, group_id), group numbers from 0."""
    im = images(spark, sf_dir)
    return large.compact_components(im, large.similar_forest(im, [threshold], 0.03), threshold, 0.03)


def compact_sql(threshold: float, name: str) -> str:
    return f"""
{name}_edges AS (SELECT s.i, s.j FROM sims s JOIN images a ON s.i = a.idx JOIN images b ON s.j = b.idx
    WHERE s.sim >= {threshold} AND abs(a.width::DOUBLE / a.height - b.width::DOUBLE / b.height) <= 0.03::DOUBLE), {components_sql(name + '_edges', name)}"""


def affinity_sql(threshold: float, source: str, target: str, enough: str, k: int) -> str:
    """Ranked targets: groups a and b of a partition, conditions on their sizes and on the affinity."""
    return f"""WITH RECURSIVE {IMAGES_SQL}, {compact_sql(threshold, 'cc')}, numbered AS ({_NUM_SQL.format('cc')}), mem AS (SELECT n.group_id, i.idx, i.d, count(*) OVER (PARTITION BY n.group_id) AS n FROM numbered n JOIN images i ON n.index = i.idx),
        mean AS (SELECT group_id, list(v ORDER BY pos) AS m FROM (SELECT group_id, pos, avg(v) AS v FROM (SELECT group_id, unnest(d) AS v, generate_subscripts(d, 1) AS pos FROM mem) GROUP BY 1, 2) GROUP BY 1),
        unit AS (SELECT group_id, list_transform(m, lambda x: x / sqrt(list_dot_product(m, m))) AS c FROM mean),
        best AS (SELECT a.group_id AS src, b.group_id AS dst, any_value(a.n) AS src_n, any_value(b.n) AS dst_n, max(list_dot_product(a.d, b.d)) AS best FROM mem a JOIN mem b ON a.group_id <> b.group_id WHERE {source} AND {target} GROUP BY 1, 2),
        aff AS (SELECT src, dst, src_n, dst_n, 0.55::DOUBLE * best + 0.45::DOUBLE * list_dot_product(x.c, y.c) AS affinity FROM best JOIN unit x ON src = x.group_id JOIN unit y ON dst = y.group_id)
        SELECT src, dst, round(affinity, 6) AS affinity, rank FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY affinity DESC, dst DESC) AS rank FROM aff WHERE {enough}) WHERE rank <= {k}"""


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return q_exact_set_score(spark, sf_dir)


# Queries -----------------------------------------------------------------------------------------


def q_all_pairs(spark, sf_dir):
    return knn.similar_pairs(images(spark, sf_dir), WIDE)


def q_knn_topk(spark, sf_dir):
    return knn.top_k(images(spark, sf_dir), K)


def q_range_pairs(spark, sf_dir):
    return knn.neighbor_pairs(images(spark, sf_dir), NEIGHBORS, FLOOR)


def q_ann_pairs(spark, sf_dir):
    return knn.approximate_neighbor_pairs(images(spark, sf_dir), NEIGHBORS)


def q_ann_recall(spark, sf_dir):
    """One row: whether the forest finds at least nine tenths of all rows' true neighbours, with their true similarities."""
    im = images(spark, sf_dir)
    work = Workspace(spark, "ann-q")
    found = work.put(knn.approximate_top_k(im, NEIGHBORS), "found")
    true = knn.top_k(im, NEIGHBORS).select("i", "j", F.lit(1).alias("true"))
    side = lambda i, d: im.select(F.col("index").alias(i), F.col("descriptor").alias(d))
    off = F.abs(F.col("sim") - repair.dot(F.col("a"), F.col("b")))
    wrong = found.join(side("i", "a"), "i").join(side("j", "b"), "j").agg(F.coalesce(F.max(off), F.lit(0.0)).alias("off"))
    hits = true.join(found.select("i", "j", F.lit(1).alias("hit")), ["i", "j"], "left").agg(F.count("true").alias("neighbours"), F.count("hit").alias("hits"))
    return hits.crossJoin(wrong).select("neighbours", (10 * F.col("hits") >= 9 * F.col("neighbours")).alias("recall_reached"), (F.col("off") <= 2e-6).alias("similarities_true"))


def q_confidence(spark, sf_dir):
    return pair_scores(spark, sf_dir).select("i", "j", "confidence")


def q_decision(spark, sf_dir):
    return pair_scores(spark, sf_dir).select("i", "j", "decision")


def q_reason(spark, sf_dir):
    return pair_scores(spark, sf_dir).where("method <> 'none'").select("i", "j", "decision", D.reason().alias("reason"))


def q_bidirectional(spark, sf_dir):
    pairs = candidates(spark, sf_dir)
    forward = with_metrics(pairs).withColumn("is_forward", F.lit(1)).withColumn("a", F.col("i")).withColumn("b", F.col("j"))
    backward = with_metrics(pairs.select(F.col("j").alias("i"), F.col("i").alias("j"), "sim")).withColumn("is_forward", F.lit(0)).withColumn("a", F.col("j")).withColumn("b", F.col("i"))
    kept = F.max_by(F.struct("i", "j", "decision", "confidence", "ransac_inliers"), F.struct(D.direction_rank().alias("r"), F.col("is_forward")))
    return forward.unionByName(backward).groupBy("a", "b").agg(kept.alias("k")).select("a", "b", "k.i", "k.j", "k.decision", "k.confidence", "k.ransac_inliers")


def _support_query(column):
    return lambda spark, sf_dir: pair_scores(spark, sf_dir).select("i", "j", F.round(column(), 6).alias("support")).where("support is not null")


def q_bridge_accepts(spark, sf_dir):
    return pair_scores(spark, sf_dir).select("i", "j", D.bridge_accepts().alias("plain"), D.bridge_accepts(True).alias("with_flag"))


def q_components_verified(spark, sf_dir):
    found, _ = _verified(spark, sf_dir)
    return found.select("index", F.col("group_id").alias("component"), "status")


def q_components_compact(spark, sf_dir):
    return _partition(spark, sf_dir, LINK).select("index", "filename", "group_id")


def q_component_sizes(spark, sf_dir):
    return _partition(spark, sf_dir, LINK).groupBy("group_id").agg(F.count(F.lit(1)).alias("n")).groupBy("n").agg(F.count(F.lit(1)).alias("groups"))


def q_centroids(spark, sf_dir):
    groups = images(spark, sf_dir).select(F.col("truth").alias("group_id"), "index", "descriptor")
    return affinity.centroids(groups).select("group_id", F.posexplode("centroid").alias("pos", "value")).select("group_id", "pos", F.round("value", 6).alias("value"))


def q_affinity_topk(spark, sf_dir):
    members = repair.group_members(images(spark, sf_dir), _partition(spark, sf_dir, LINK).select("index", "group_id"))
    members = Workspace(spark, "affinity").put(members, "members")
    near = affinity.group_affinity(members, F.col("n") == 1, F.lit(True), k=24)
    return repair.rank_targets(near, 24).select("src", "dst", F.round("affinity", 6).alias("affinity"), "rank")


def _ranked(spark, sf_dir, kind):
    members = repair.group_members(images(spark, sf_dir), _partition(spark, sf_dir, LOOSE).select("index", "group_id"))
    members = Workspace(spark, "ranked-q").put(members, "members")
    return repair.targets(members, tail=TAIL, medium=MEDIUM, kinds=[kind])[kind].select("src", "dst", F.round("affinity", 6).alias("affinity"), "rank")


def q_affinity_tail(spark, sf_dir):
    return _ranked(spark, sf_dir, "tail")


def q_affinity_medium(spark, sf_dir):
    return _ranked(spark, sf_dir, "medium")


def q_match_tail(spark, sf_dir):
    of = Workspace(spark, "tail-q").put(_partition(spark, sf_dir, LINK).select("index", "filename", "group_id"), "groups")
    members = repair.group_members(images(spark, sf_dir), of.select("index", "group_id"))
    scores = Workspace(spark, "tail-q").put(with_metrics(candidates(spark, sf_dir), strong=True), "scores")
    found = repair.supports(_group_candidates(spark, sf_dir, of.select("index", F.col("group_id").alias("g")), scores).where("src_n = 2 and dst_n >= 4"), scores)
    return repair.tail_matches(found, members, scores).select("src", "dst", F.round("average", 6).alias("average"))


def q_representatives(spark, sf_dir):
    assigned, scores = _verified(spark, sf_dir)
    return C.representatives(assigned, scores)


def q_member_confidence(spark, sf_dir):
    assigned, scores = _verified(spark, sf_dir)
    reps = C.representatives(assigned, scores)
    return C.member_confidences(assigned, reps, scores).select("index", "group_id", "representative", "confidence")


def q_renumber(spark, sf_dir):
    assigned, scores = _verified(spark, sf_dir)
    reps = C.representatives(assigned, scores)
    out = C.renumber(C.member_confidences(assigned, reps, scores), images(spark, sf_dir))
    return out.select("index", "filename", "group_id", "status", "representative_filename")


def q_groups_report(spark, sf_dir):
    assigned, scores = _verified(spark, sf_dir)
    reps = C.representatives(assigned, scores)
    return C.groups_report(C.renumber(C.member_confidences(assigned, reps, scores), images(spark, sf_dir)))


def q_cluster(spark, sf_dir):
    return C.cluster(images(spark, sf_dir), graph_scores(spark, sf_dir)).select("index", "group_id", "status", "confidence", "representative")


def q_tentative_attach(spark, sf_dir):
    assigned, scores = _verified(spark, sf_dir)
    return C.tentative_attach(assigned, scores).select("index", "group_id", "status", "confidence")


def _supports(spark, sf_dir, groups=None):
    """Member supports between every two groups (index, g) of vectors, index % 40 unless given: (src, dst, member, target, support, sim)."""
    scored = pair_scores(spark, sf_dir).withColumn("support", D.member_support()).where("support is not null")
    both = scored.select(F.col("i").alias("member"), F.col("j").alias("target"), "support", "sim").unionByName(
        scored.select(F.col("j").alias("member"), F.col("i").alias("target"), "support", "sim"))
    of = images(spark, sf_dir).select("index", (F.col("index") % 40).alias("g")) if groups is None else groups
    return both.join(of.select(F.col("index").alias("member"), F.col("g").alias("src")), "member").join(of.select(F.col("index").alias("target"), F.col("g").alias("dst")), "target").where("src <> dst")


SUPPORTS = f"""{SCORES}, sup AS (SELECT i, j, sim, coalesce({RELAXED_SQL}, {TINY_SQL}) AS support FROM scores),
sup2 AS (SELECT i AS member, j AS target, i % 40 AS src, j % 40 AS dst, support, sim FROM sup WHERE support IS NOT NULL
         UNION ALL SELECT j, i, j % 40, i % 40, support, sim FROM sup WHERE support IS NOT NULL),
sup3 AS (SELECT * FROM sup2 WHERE src <> dst),
bests AS (SELECT src, dst, member, max(support) AS best FROM sup3 GROUP BY 1, 2, 3),
matches AS (SELECT src, dst, avg(best) AS average, min(best) AS least, count(*) AS members, count(*) FILTER (WHERE best >= 0.6::DOUBLE) AS covered FROM bests GROUP BY 1, 2)"""


def _group_candidates(spark, sf_dir, groups, scores):
    """Scored pairs between every two groups (index, g), in both directions, as repair's candidates."""
    n = groups.groupBy("g").agg(F.count(F.lit(1)).alias("n"))
    of = groups.join(n, "g")
    side = lambda i, g: of.select(F.col("index").alias(i), F.col("g").alias(g), F.col("n").alias(f"{g}_n"))
    both = scores.select(F.col("i").alias("member"), F.col("j").alias("target")).unionByName(scores.select(F.col("j").alias("member"), F.col("i").alias("target")))
    return both.join(side("member", "src"), "member").join(side("target", "dst"), "target").where("src <> dst").withColumn("rank", F.lit(1)).withColumn("member_rank", F.col("target"))


def _found_supports(spark, sf_dir, groups):
    scores = Workspace(spark, "supports-q").put(pair_scores(spark, sf_dir), "scores")
    return repair.supports(_group_candidates(spark, sf_dir, groups, scores), scores)


def q_member_supports(spark, sf_dir):
    groups = images(spark, sf_dir).select("index", (F.col("index") % 40).alias("g"))
    return repair.folded(_found_supports(spark, sf_dir, groups)).select(
        "src", "dst", F.round("average", 6).alias("average"), F.round("least", 6).alias("least"), F.col("supported").alias("members"), "covered")


def _partition_supports(spark, sf_dir):
    groups = Workspace(spark, "match-q").put(_partition(spark, sf_dir, LINK).select("index", F.col("component").alias("g")), "groups")
    return _found_supports(spark, sf_dir, groups)


def q_match_relaxed(spark, sf_dir):
    return repair.relaxed_matches(_partition_supports(spark, sf_dir)).select("src", "dst", F.round("average", 6).alias("average"))


def q_match_medium(spark, sf_dir):
    return repair.medium_matches(_partition_supports(spark, sf_dir)).select("src", "dst", F.round("average", 6).alias("average"))


def q_match_folds(spark, sf_dir):
    return repair.folded(_partition_supports(spark, sf_dir)).select(
        "src", "dst", "src_n", "dst_n", *[F.round(c, 6).alias(c) for c in ("average", "least", "top", "top_confidence", "top_shift", "top_edge")],
        "supported", "covered", "covered_targets", "corroborating", F.col("top_tiny").isNotNull().alias("any_tiny"))


def _matches(spark, sf_dir, groups=None):
    best = _supports(spark, sf_dir, groups).groupBy("src", "dst", "member").agg(F.max("support").alias("best"))
    return best.groupBy("src", "dst").agg(F.avg("best").alias("average"))


def q_best_with_margin(spark, sf_dir):
    return repair.best_with_margin(_matches(spark, sf_dir)).select("src", "dst", F.round("average", 6).alias("average"), F.round("second", 6).alias("second"))


def q_mutual_best(spark, sf_dir):
    return repair.mutual_best(repair.best_with_margin(_matches(spark, sf_dir))).select("src", "dst", F.round("average", 6).alias("average"))


def q_bridge_candidates(spark, sf_dir):
    groups = Workspace(spark, "bridge-q").put(_partition(spark, sf_dir, TIGHT).select("index", "group_id"), "groups")
    pairs = knn.neighbor_pairs(images(spark, sf_dir), NEIGHBORS, FLOOR)
    return large.bridge_candidates(images(spark, sf_dir), groups, pairs, FLOOR, TIGHT, 0.03, 1, EngineConfig().bridge_max_pairs).select("i", "j", "sim")


def q_split_oversized(spark, sf_dir):
    im = images(spark, sf_dir)
    ladder = [0.38, 0.42, 0.46]
    pairs = Workspace(spark, "split-q").put(large.similar_forest(im, [LOOSE, *ladder], 0.03), "pairs")
    return large.bounded_components(im, pairs, LOOSE, 12, 0.03, ladder).select("index", "component")


def q_exact_set_score(spark, sf_dir):
    a, b = (_partition(spark, sf_dir, t).select("group_id", "filename") for t in (LINK, TIGHT))
    return evaluate.exact_set_score(a, b)


def q_exact_set_matches(spark, sf_dir):
    a, b = (_partition(spark, sf_dir, t).select("group_id", "filename") for t in (LINK, TIGHT))
    return evaluate.exact_set_matches(a, b).select(F.concat_ws("|", "members").alias("members"))


def _cache(spark, sf_dir):
    """Candidates, and what an earlier run has scored of them, in the checkpoint that a run resumes from."""
    pairs = Workspace(spark, "cached-q").put(candidates(spark, sf_dir), "pairs")
    names = lambda i, f: images(spark, sf_dir).select(F.col("index").alias(i), F.col("filename").alias(f))
    scored = with_metrics(pairs).where("(i + j) % 3 <> 0").join(names("i", "filename_a"), "i").join(names("j", "filename_b"), "j")
    rows = scored.withColumn("reason", F.lit("")).withColumn("gradient_score", F.lit(0.0)).withColumn("avg_corner_shift_pixels", F.lit(0.0)).withColumn("max_corner_shift_pixels", F.lit(0.0))
    fields = [x.split() for x in PAIR_SCORE.split(",")]
    cache = PairCache(spark, f"{Workspace(spark, 'cache-q').path}/scores", fingerprint(EngineConfig().thresholds, EngineConfig().max_size, EngineConfig().features_per_variant))
    cache.append(rows.select(*[F.col(n).cast(t).alias(n) for n, t in fields]))
    return pairs, cache.load(pairs, images(spark, sf_dir))


def q_cached_pairs(spark, sf_dir):
    return scoring.unordered(_cache(spark, sf_dir)[1])


def q_missing_pairs(spark, sf_dir):
    return scoring.missing_pairs(*_cache(spark, sf_dir))


def q_greedy_proposals(spark, sf_dir):
    groups = Workspace(spark, "greedy-q").put(_partition(spark, sf_dir, LINK).select("index", "group_id"), "groups")
    sizes = groups.groupBy("group_id").agg(F.count(F.lit(1)).alias("n"))
    edges = _matches(spark, sf_dir, groups.select("index", F.col("group_id").alias("g"))).where("average >= 0.6")
    scored = edges.select("src", "dst", F.round("average", 1).alias("score"), F.lit(1).alias("phase"))
    proposals = with_ordinal(scored, ["src", "dst"], "seq", start=1)
    return repair.apply_proposals(proposals, sizes).select("group_id", "root")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "all_pairs_similarity": q_all_pairs, "knn_topk": q_knn_topk, "candidate_pairs_undirected": candidates, "knn_range_pairs": q_range_pairs, "ann_pairs": q_ann_pairs, "ann_recall": q_ann_recall,
    "pair_confidence": q_confidence, "pair_decision": q_decision, "pair_decision_reason": q_reason, "bidirectional_best": q_bidirectional,
    "support_relaxed": _support_query(D.relaxed_support), "support_singleton": _support_query(D.singleton_support), "support_tiny": _support_query(D.tiny_motion_support),
    "support_coalesced": _support_query(D.member_support), "bridge_accepts": q_bridge_accepts,
    "components_verified": q_components_verified, "components_compact": q_components_compact, "component_sizes": q_component_sizes,
    "group_centroid": q_centroids, "group_affinity_topk": q_affinity_topk, "group_affinity_tail": q_affinity_tail, "group_affinity_medium": q_affinity_medium, "representatives": q_representatives, "member_confidence": q_member_confidence,
    "renumber_groups": q_renumber, "groups_report": q_groups_report, "cluster_images": q_cluster, "tentative_attach": q_tentative_attach,
    "group_match_supports": q_member_supports, "group_match_folds": q_match_folds, "group_match_relaxed": q_match_relaxed, "group_match_medium": q_match_medium, "group_match_tail": q_match_tail, "best_with_margin": q_best_with_margin, "mutual_best": q_mutual_best,
    "bridge_candidates": q_bridge_candidates, "split_oversized": q_split_oversized, "exact_set_score": q_exact_set_score, "exact_set_matches": q_exact_set_matches,
    "cached_pairs": q_cached_pairs, "missing_pairs": q_missing_pairs, "greedy_proposals": q_greedy_proposals,
}

def folds_sql(scores: str) -> str:
    """Folds of every two groups of the partition at LINK."""
    return f"""{scores}, {compact_sql(LINK, 'mc')}, sized AS (SELECT idx, component, count(*) OVER (PARTITION BY component) AS n FROM mc),
said AS (SELECT *, coalesce({RELAXED_SQL}, {TINY_SQL}) AS support, {TINY_SQL} AS tiny FROM scores),
turned AS (SELECT i AS member, j AS target, support, tiny, confidence, avg_corner_shift_ratio AS shift, edge_score FROM said WHERE support IS NOT NULL
           UNION ALL SELECT j, i, support, tiny, confidence, avg_corner_shift_ratio, edge_score FROM said WHERE support IS NOT NULL),
placed AS (SELECT t.*, a.component AS src, b.component AS dst, a.n AS src_n, b.n AS dst_n, row_number() OVER (PARTITION BY a.component, b.component, member ORDER BY support DESC, target) AS place
           FROM turned t JOIN sized a ON t.member = a.idx JOIN sized b ON t.target = b.idx WHERE a.component <> b.component),
folds AS (SELECT src, dst, src_n, dst_n, avg(support) FILTER (WHERE place = 1) AS average, min(support) FILTER (WHERE place = 1) AS least, count(*) FILTER (WHERE place = 1) AS supported,
    count(*) FILTER (WHERE place = 1 AND support >= 0.6::DOUBLE) AS covered, count(DISTINCT CASE WHEN place = 1 AND support >= 0.6::DOUBLE THEN target END) AS covered_targets,
    count(DISTINCT CASE WHEN support >= 0.58::DOUBLE THEN target END) AS corroborating, max(support) FILTER (WHERE place = 1) AS top, max(confidence) FILTER (WHERE place = 1) AS top_confidence,
    max(shift) FILTER (WHERE place = 1) AS top_shift, max(edge_score) FILTER (WHERE place = 1) AS top_edge, max(tiny) FILTER (WHERE place = 1) AS top_tiny FROM placed GROUP BY 1, 2, 3, 4)"""


STRONG = f"{CAND}, {metrics_sql('cand', strong=True)}"
FOLDS = folds_sql(SCORES)
#: Tentative pairs, one a step, over lists with a place for every image: its group, whether it is alone, what it was moved by.
ATTACHED = f"""{VERIFIED},
place AS MATERIALIZED (SELECT idx, component, row_number() OVER (ORDER BY idx) AS p, count(*) OVER (PARTITION BY component) AS n FROM comp),
tent AS MATERIALIZED (SELECT a.p AS pa, b.p AS pb, confidence AS c, row_number() OVER (ORDER BY confidence DESC, i, j) AS turn
    FROM (SELECT least(i, j) AS i, greatest(i, j) AS j, confidence FROM scores WHERE decision = 'tentative') JOIN place a ON i = a.idx JOIN place b ON j = b.idx),
beside AS MATERIALIZED (SELECT p, list({{'q': q, 'c': c}}) AS near FROM (SELECT pa AS p, pb AS q, c FROM tent UNION ALL SELECT pb, pa, c FROM tent) GROUP BY 1),
step AS MATERIALIZED (SELECT turn, pa, pb, c, x.near AS near_a, y.near AS near_b FROM tent JOIN beside x ON x.p = pa JOIN beside y ON y.p = pb),
walk AS (
    SELECT 0::BIGINT AS turn, list(component ORDER BY p) AS g, list(n = 1 ORDER BY p) AS lone, list(NULL::DOUBLE ORDER BY p) AS via FROM place
    UNION ALL
    SELECT turn, CASE WHEN moves THEN list_transform(g, lambda x, i: CASE WHEN i = one THEN target ELSE x END) ELSE g END,
        CASE WHEN moves THEN list_transform(lone, lambda x, i: x AND i <> one) ELSE lone END,
        CASE WHEN moves THEN list_transform(via, lambda x, i: CASE WHEN i = one THEN c ELSE x END) ELSE via END
    FROM (SELECT *, one_alone AND coalesce(list_max(list_transform(list_filter(near, lambda x: g[x.q] <> target), lambda x: x.c)) <= c - 0.05::DOUBLE, true) AS moves
        FROM (SELECT t.turn, w.g, w.lone, w.via, t.c, w.lone[t.pa] <> w.lone[t.pb] AS one_alone, CASE WHEN w.lone[t.pa] THEN t.pa ELSE t.pb END AS one,
                CASE WHEN w.lone[t.pa] THEN w.g[t.pb] ELSE w.g[t.pa] END AS target, CASE WHEN w.lone[t.pa] THEN t.near_a ELSE t.near_b END AS near
            FROM walk w JOIN step t ON t.turn = w.turn + 1))),
att AS (SELECT idx, p.component AS home, w.g[p] AS component, CASE WHEN w.via[p] IS NOT NULL THEN 'tentative' WHEN n > 1 THEN 'verified' ELSE 'singleton' END AS status, coalesce(w.via[p], 1::DOUBLE) AS own
    FROM place p, (SELECT * FROM walk ORDER BY turn DESC LIMIT 1) w)"""
CLUSTERED = f"""{ATTACHED}, acc AS (SELECT i, j, confidence FROM scores WHERE decision <> 'reject'),
acc2 AS (SELECT i AS idx, j AS other, confidence FROM acc UNION ALL SELECT j, i, confidence FROM acc),
inside AS (SELECT c.component, a.idx, a.other, a.confidence FROM acc2 a JOIN att c ON a.idx = c.idx JOIN att o ON a.other = o.idx AND c.component = o.component),
reps AS (SELECT component, idx AS representative FROM (
    SELECT c.component, c.idx, row_number() OVER (PARTITION BY c.component ORDER BY coalesce(m.mean, 0) DESC, c.home, c.idx) AS rn
    FROM att c LEFT JOIN (SELECT idx, avg(confidence) AS mean FROM inside GROUP BY 1) m ON c.idx = m.idx) WHERE rn = 1),
bests AS (SELECT i.idx, max(i.confidence) AS best, max(CASE WHEN i.other = r.representative THEN i.confidence END) AS to_rep FROM inside i JOIN reps r ON i.component = r.component GROUP BY 1),
numbered AS (SELECT r.component, row_number() OVER (ORDER BY f.filename, r.component) AS group_id FROM reps r JOIN images f ON r.representative = f.idx)"""
_NUM_SQL = "SELECT idx AS index, filename, dense_rank() OVER (ORDER BY least_name) - 1 AS group_id FROM (SELECT c.idx, f.filename, c.component, min(f.filename) OVER (PARTITION BY c.component) AS least_name FROM {0} c JOIN images f ON c.idx = f.idx)"
_SETS = "SELECT DISTINCT string_agg(filename, '|' ORDER BY filename) AS members FROM {0} c JOIN images f ON c.idx = f.idx GROUP BY component"
_TWO = f"WITH RECURSIVE {IMAGES_SQL}, {compact_sql(LINK, 'pc')}, {compact_sql(TIGHT, 'tc')}, p AS ({_SETS.format('pc')}), t AS ({_SETS.format('tc')}), m AS (SELECT * FROM p INTERSECT SELECT * FROM t)"


def _rank_key(p: str) -> str:
    return f"(CASE WHEN {p}.decision <> 'reject' THEN 1 ELSE 0 END), (CASE WHEN {p}.decision = 'verified' THEN 1 ELSE 0 END), {p}.confidence, {p}.ransac_inliers, {p}.inlier_ratio, -{p}.median_reprojection_error"


ORACLE_SQL: dict[str, str] = {
    "all_pairs_similarity": f"WITH {IMAGES_SQL} SELECT i, j, sim FROM sims WHERE sim >= {WIDE}",
    "knn_topk": f"{CAND} SELECT i, j, sim, rank FROM top",
    "candidate_pairs_undirected": f"{CAND} SELECT i, j, sim FROM cand",
    "knn_range_pairs": f"WITH {IMAGES_SQL}, {_topk_sql(NEIGHBORS)} SELECT least(i, j) AS i, greatest(i, j) AS j, max(sim) AS sim FROM top WHERE sim >= {FLOOR} GROUP BY 1, 2",
    "ann_recall": f"WITH {IMAGES_SQL}, {_topk_sql(NEIGHBORS)} SELECT count(*) AS neighbours, true AS recall_reached, true AS similarities_true FROM top",
    "pair_confidence": f"{SCORES} SELECT i, j, confidence FROM scores",
    "pair_decision": f"{SCORES} SELECT i, j, decision FROM scores",
    "pair_decision_reason": f"""{SCORES} SELECT i, j, decision, CASE decision WHEN 'verified' THEN 'feature_homography_verified' WHEN 'tentative' THEN 'structural_alignment_tentative'
        ELSE coalesce(nullif(concat_ws(',', CASE WHEN NOT enough THEN 'weak_features' END, CASE WHEN NOT motion THEN 'motion_too_large' END,
            CASE WHEN NOT reprojection THEN 'reprojection_error' END, CASE WHEN NOT structure THEN 'weak_structure' END), ''), 'thresholds_not_met') END AS reason FROM scores WHERE method <> 'none'""",
    "bidirectional_best": f"""{CAND}, turned AS (SELECT i, j, sim FROM cand UNION ALL SELECT j, i, sim FROM cand), {metrics_sql('turned')}
        SELECT a, b, i, j, decision, confidence, ransac_inliers FROM (SELECT least(s.i, s.j) AS a, greatest(s.i, s.j) AS b, s.*,
            row_number() OVER (PARTITION BY least(s.i, s.j), greatest(s.i, s.j) ORDER BY {', '.join(x + ' DESC' for x in _rank_key('s').split(', '))}, s.i < s.j DESC) AS rn FROM scores s) WHERE rn = 1""",
    "support_relaxed": f"{SCORES} SELECT i, j, round({RELAXED_SQL}, 6) AS support FROM scores WHERE ({RELAXED_SQL}) IS NOT NULL",
    "support_singleton": f"{SCORES} SELECT i, j, round({SINGLETON_SQL}, 6) AS support FROM scores WHERE ({SINGLETON_SQL}) IS NOT NULL",
    "support_tiny": f"{SCORES} SELECT i, j, round({TINY_SQL}, 6) AS support FROM scores WHERE ({TINY_SQL}) IS NOT NULL",
    "support_coalesced": f"{SCORES} SELECT i, j, round(coalesce({RELAXED_SQL}, {TINY_SQL}), 6) AS support FROM scores WHERE coalesce({RELAXED_SQL}, {TINY_SQL}) IS NOT NULL",
    "bridge_accepts": f"{SCORES} SELECT i, j, decision = 'verified' AS plain, decision = 'verified' OR (ransac_inliers >= 18 AND inlier_ratio >= 0.45::DOUBLE AND median_reprojection_error <= 3 AND avg_corner_shift_ratio <= 0.12::DOUBLE) AS with_flag FROM scores",
    "components_verified": f"{VERIFIED} SELECT idx AS index, component, CASE WHEN count(*) OVER (PARTITION BY component) > 1 THEN 'verified' ELSE 'singleton' END AS status FROM comp",
    "components_compact": f"WITH RECURSIVE {IMAGES_SQL}, {compact_sql(LINK, 'cc')} {_NUM_SQL.format('cc')}",
    "component_sizes": f"WITH RECURSIVE {IMAGES_SQL}, {compact_sql(LINK, 'cc')} SELECT n, count(*) AS groups FROM (SELECT component, count(*) AS n FROM cc GROUP BY 1) GROUP BY 1",
    "group_centroid": f"""WITH {IMAGES_SQL}, x AS (SELECT truth AS group_id, unnest(d) AS v, generate_subscripts(d, 1) - 1 AS pos FROM images), m AS (SELECT group_id, pos, avg(v) AS v FROM x GROUP BY 1, 2),
        n AS (SELECT group_id, sqrt(sum(v * v)) AS norm FROM m GROUP BY 1) SELECT m.group_id, m.pos, round(CASE WHEN norm > 1e-8 THEN v / norm ELSE v END, 6) AS value FROM m JOIN n USING (group_id)""",
    "group_affinity_topk": affinity_sql(LINK, "a.n = 1", "true", "true", 24),
    "group_affinity_tail": affinity_sql(LOOSE, "a.n = 2", "b.n >= 4", f"affinity >= {TAIL}::DOUBLE", 16),
    "group_affinity_medium": affinity_sql(LOOSE, "a.n BETWEEN 3 AND 12", "b.n BETWEEN 3 AND 16", f"affinity >= {MEDIUM}::DOUBLE AND greatest(src_n, dst_n) <= 4 * least(src_n, dst_n)", 8),
    "representatives": f"{GROUPED} SELECT component AS group_id, representative FROM reps",
    "member_confidence": f"{GROUPED} SELECT idx AS index, component AS group_id, representative, confidence FROM conf",
    "renumber_groups": f"""{GROUPED} SELECT c.idx AS index, f.filename, n.group_id, CASE WHEN count(*) OVER (PARTITION BY c.component) > 1 THEN 'verified' ELSE 'singleton' END AS status, n.representative_filename
        FROM conf c JOIN numbered n ON c.component = n.component JOIN images f ON c.idx = f.idx""",
    "groups_report": f"""{GROUPED} SELECT printf('angle_%03d', n.group_id) AS angle_id, f.filename, n.representative_filename, count(*) OVER (PARTITION BY c.component) AS group_size,
        printf('%.4f', c.confidence::DOUBLE) AS confidence, CASE WHEN count(*) OVER (PARTITION BY c.component) > 1 THEN 'verified' ELSE 'singleton' END AS status
        FROM conf c JOIN numbered n ON c.component = n.component JOIN images f ON c.idx = f.idx""",
    "group_match_supports": f"{SUPPORTS} SELECT src, dst, round(average, 6) AS average, round(least, 6) AS least, members, covered FROM matches",
    "group_match_folds": f"{FOLDS} SELECT src, dst, src_n, dst_n, round(average, 6) AS average, round(least, 6) AS least, round(top, 6) AS top, round(top_confidence, 6) AS top_confidence, round(top_shift, 6) AS top_shift, round(top_edge, 6) AS top_edge, supported, covered, covered_targets, corroborating, top_tiny IS NOT NULL AS any_tiny FROM folds",
    "group_match_relaxed": f"""{FOLDS} SELECT src, dst, round(average, 6) AS average FROM folds WHERE supported = src_n AND average >= 0.6::DOUBLE AND least >= 0.52::DOUBLE
        AND (NOT (src_n = 1 AND dst_n > 1) OR corroborating >= 2 OR (top >= 0.8::DOUBLE AND top_confidence >= 0.8::DOUBLE AND top_shift <= 0.05::DOUBLE AND top_edge >= 0.25::DOUBLE) OR (top >= 0.72::DOUBLE AND top_tiny IS NOT NULL))""",
    "group_match_medium": f"""{FOLDS} SELECT src, dst, round(average, 6) AS average FROM folds WHERE src_n BETWEEN 3 AND 12 AND dst_n BETWEEN 3 AND 16 AND greatest(src_n, dst_n)::DOUBLE / least(src_n, dst_n) <= 4
        AND supported = src_n AND average >= 0.66::DOUBLE AND least >= 0.58::DOUBLE AND covered >= greatest(3, ceil(0.75::DOUBLE * src_n)) AND covered_targets >= least(3, dst_n)""",
    "group_match_tail": f"""{folds_sql(STRONG)}, named AS ({_NUM_SQL.format('mc')}), number AS (SELECT DISTINCT c.component, n.group_id FROM named n JOIN mc c ON n.index = c.idx),
        inner_pair AS (SELECT a.component AS src, least(0.7::DOUBLE, 0.85::DOUBLE * s.confidence) AS indirect FROM sized a JOIN sized b ON a.component = b.component AND a.idx < b.idx JOIN scores s ON s.i = a.idx AND s.j = b.idx
          WHERE a.n = 2 AND s.decision <> 'reject' AND s.confidence >= 0.9::DOUBLE AND s.ransac_inliers >= 50 AND s.avg_corner_shift_ratio <= 0.05::DOUBLE AND s.max_corner_shift_ratio <= 0.1::DOUBLE),
        direct AS (SELECT src, dst, max(support) AS direct FROM placed WHERE place = 1 AND src_n = 2 AND dst_n >= 4 AND support >= 0.7::DOUBLE GROUP BY 1, 2 HAVING count(*) = 1)
        SELECT x.group_id AS src, y.group_id AS dst, round((direct + indirect) / 2, 6) AS average FROM direct JOIN inner_pair USING (src) JOIN number x ON src = x.component JOIN number y ON dst = y.component WHERE (direct + indirect) / 2 >= 0.72::DOUBLE""",
    "best_with_margin": f"{SUPPORTS} SELECT src, dst, round(average, 6) AS average, round(second, 6) AS second FROM (SELECT src, dst, average, coalesce(lead(average) OVER w, 0) AS second, row_number() OVER w AS rn FROM matches WINDOW w AS (PARTITION BY src ORDER BY average DESC, dst)) WHERE rn = 1",
    "mutual_best": f"{SUPPORTS}, b AS (SELECT src, dst, average FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY average DESC, dst) AS rn FROM matches) WHERE rn = 1) SELECT x.src, x.dst, round(least(x.average, y.average), 6) AS average FROM b x JOIN b y ON x.dst = y.src AND y.dst = x.src WHERE x.src < x.dst",
    "bridge_candidates": f"""WITH RECURSIVE {IMAGES_SQL}, {_topk_sql(NEIGHBORS)}, {compact_sql(TIGHT, 'cc')}, r AS (SELECT least(i, j) AS i, greatest(i, j) AS j, max(sim) AS sim FROM top WHERE sim >= {FLOOR} GROUP BY 1, 2)
        SELECT i, j, sim FROM (SELECT r.*, row_number() OVER (PARTITION BY least(a.component, b.component), greatest(a.component, b.component) ORDER BY r.sim DESC, r.i, r.j) AS rn
          FROM r JOIN cc a ON r.i = a.idx JOIN cc b ON r.j = b.idx JOIN images x ON r.i = x.idx JOIN images y ON r.j = y.idx
          WHERE r.sim < {TIGHT} AND r.sim >= {FLOOR} AND a.component <> b.component AND abs(x.width::DOUBLE / x.height - y.width::DOUBLE / y.height) <= 0.03::DOUBLE) WHERE rn <= 1 ORDER BY sim DESC, i, j LIMIT {EngineConfig().bridge_max_pairs}""",
    "split_oversized": f"""WITH RECURSIVE {IMAGES_SQL}, {compact_sql(LOOSE, 'c0')}, {compact_sql(0.38, 'c1')}, {compact_sql(0.42, 'c2')}, {compact_sql(0.46, 'c3')},
        largest AS (SELECT w.component AS whole, any_value(w.n) AS n, max(p1.n) AS n1, max(p2.n) AS n2, max(p3.n) AS n3
          FROM (SELECT *, count(*) OVER (PARTITION BY component) AS n FROM c0) w JOIN (SELECT *, count(*) OVER (PARTITION BY component) AS n FROM c1) p1 USING (idx)
          JOIN (SELECT *, count(*) OVER (PARTITION BY component) AS n FROM c2) p2 USING (idx) JOIN (SELECT *, count(*) OVER (PARTITION BY component) AS n FROM c3) p3 USING (idx) GROUP BY 1)
        SELECT c0.idx AS index, CASE WHEN n <= 12 THEN c0.component WHEN n1 <= 12 THEN c1.component WHEN n2 <= 12 THEN c2.component WHEN n3 <= 12 THEN c3.component ELSE c0.component END AS component
        FROM c0 JOIN c1 USING (idx) JOIN c2 USING (idx) JOIN c3 USING (idx) JOIN largest ON c0.component = whole""",
    "exact_set_score": f"{_TWO} SELECT (SELECT count(*) FROM p) AS predicted_groups, (SELECT count(*) FROM t) AS truth_groups, (SELECT count(*) FROM m) AS exact_matches, (SELECT count(*) FROM m)::DOUBLE / (SELECT count(*) FROM t) AS score",
    "exact_set_matches": f"{_TWO} SELECT members FROM m",
    "tentative_attach": f"{ATTACHED} SELECT idx AS index, component AS group_id, status, own AS confidence FROM att",
    "cluster_images": f"""{CLUSTERED} SELECT c.idx AS index, n.group_id, c.status, CASE WHEN c.idx = r.representative THEN 1::DOUBLE ELSE coalesce(b.to_rep, b.best, c.own) END AS confidence, r.representative
        FROM att c JOIN reps r USING (component) JOIN numbered n USING (component) LEFT JOIN bests b ON b.idx = c.idx""",
    "greedy_proposals": f"""{FOLDS}, named AS ({_NUM_SQL.format('mc')}), sizes AS MATERIALIZED (SELECT c.component, n.group_id, count(*) AS n, row_number() OVER (ORDER BY n.group_id) AS p FROM named n JOIN mc c ON n.index = c.idx GROUP BY 1, 2),
        step AS MATERIALIZED (SELECT a.p AS src, b.p AS dst, a.n AS src_n, b.n AS dst_n, row_number() OVER (ORDER BY round(average, 1) DESC, a.group_id, b.group_id) AS turn
          FROM folds f JOIN sizes a ON f.src = a.component JOIN sizes b ON f.dst = b.component WHERE average >= 0.6::DOUBLE),
        walk AS (
          SELECT 0::BIGINT AS turn, list(group_id ORDER BY p) AS root, list(false ORDER BY p) AS used FROM sizes
          UNION ALL
          SELECT turn, CASE WHEN joins THEN list_transform(root, lambda x: CASE WHEN x = greatest(a, b) THEN least(a, b) ELSE x END) ELSE root END,
            CASE WHEN joins AND src_n <= 2 THEN list_transform(used, lambda x, i: x OR i = src OR (src_n = 1 AND dst_n = 1 AND i = dst)) ELSE used END
          FROM (SELECT t.*, w.root, w.used, w.root[t.src] AS a, w.root[t.dst] AS b,
                  t.src_n <= 12 AND NOT (t.src_n <= 2 AND w.used[t.src]) AND NOT (t.src_n = 1 AND t.dst_n = 1 AND w.used[t.dst]) AND w.root[t.src] <> w.root[t.dst] AS joins
                FROM walk w JOIN step t ON t.turn = w.turn + 1))
        SELECT s.group_id, w.root[p] AS root FROM sizes s, (SELECT * FROM walk ORDER BY turn DESC LIMIT 1) w""",
    "cached_pairs": f"{CAND} SELECT i, j FROM cand WHERE (i + j) % 3 <> 0",
    "missing_pairs": f"{CAND} SELECT i, j FROM cand WHERE (i + j) % 3 = 0",
}
