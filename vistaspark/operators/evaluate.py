"""Exact-set scoring of a partition against a reference one."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def group_sets(rows: DataFrame, group: str = "group_id", member: str = "filename") -> DataFrame:
    """Distinct groups as sorted distinct members; a member in two groups is in both."""
    return rows.groupBy(group).agg(F.sort_array(F.collect_set(member)).alias("members")).select("members").distinct()


def exact_set_matches(predictions: DataFrame, truth: DataFrame) -> DataFrame:
    """Groups equal on both sides, as (members)."""
    return group_sets(predictions).intersect(group_sets(truth))


def exact_set_score(predictions: DataFrame, truth: DataFrame) -> DataFrame:
    """One row: predicted_groups, truth_groups, exact_matches, score (matches / truth groups, 0 without truth)."""
    p, t = group_sets(predictions), group_sets(truth)
    counts = (
        p.select(F.lit(1).alias("p"), F.lit(0).alias("t"), F.lit(0).alias("m"))
        .unionByName(t.select(F.lit(0).alias("p"), F.lit(1).alias("t"), F.lit(0).alias("m")))
        .unionByName(p.intersect(t).select(F.lit(0).alias("p"), F.lit(0).alias("t"), F.lit(1).alias("m")))
        .agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in "ptm"])
    )
    return counts.select(
        F.col("p").alias("predicted_groups"), F.col("t").alias("truth_groups"), F.col("m").alias("exact_matches"),
        F.when(F.col("t") > 0, F.col("m") / F.col("t")).otherwise(0.0).alias("score"))
