"""Settings of grouping, with their defaults."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Thresholds:
    """Limits that a pair's geometry is held against."""

    min_good_matches: int = 45
    min_inliers: int = 25
    min_inlier_ratio: float = 0.30
    max_reprojection_error: float = 5.0
    max_avg_corner_shift: float = 0.08
    max_corner_shift: float = 0.16
    min_edge_score: float = 0.50
    tentative_edge_score: float = 0.62
    tentative_avg_corner_shift: float = 0.10
    descriptor_ratio: float = 0.75


@dataclass(frozen=True)
class EngineConfig:
    thresholds: Thresholds = field(default_factory=Thresholds)
    max_candidates: int = 12
    disable_pruning: bool = False
    max_size: int = 1024
    features_per_variant: int = 2500
    #: Images from which the large plan is taken.
    large_threshold: int = 5000
    large_strategy: str = "bridge"  # bridge, hybrid or compact
    large_max_size: int = 256
    large_neighbors: int = 192
    large_min_similarity: float = 0.90
    large_max_aspect_delta: float = 0.03
    large_super_min_similarity: float = 0.84
    large_max_component_size: int = 64
    large_component_max_size: int = 768
    large_component_features: int = 900
    large_component_candidates: int = 16
    large_component_postpass: bool = False
    large_hybrid_time_budget: float = float("inf")
    #: Images of a batch of components; looked at where there is a time budget.
    large_hybrid_batch_images: int = 2_000
    large_blockwise_candidates: bool = True
    large_candidate_min_similarity: float = 0.45
    bridge_min_similarity: float = 0.84
    bridge_max_pairs: int = 20_000
    bridge_time_budget: float = float("inf")
    bridge_batch_size: int = 512
    bridge_edges_per_component_pair: int = 1
    bridge_accept_strong_reject: bool = False
    block_rows: int = 2048
    pair_cache_path: str | None = None
