"""Resampling by a plan that callers bring: replicates are weights on cluster statistics, never copies of rows.

A plan has one row for each (rep, draw) with a cluster index, and may hold the cell columns. It is
counted to weights first, and joined to sums by cluster, so a replicate costs one row for each distinct
cluster it draws. Replicates that draw for themselves need no plan: see ``replicates``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CELL = ["model", "task"]


def weights(plan: DataFrame) -> DataFrame:
    own = [c for c in plan.columns if c not in ("rep", "draw", "cluster_idx")]
    return plan.groupBy(*own, "rep", "cluster_idx").agg(F.count("*").alias("w"))


def bootstrap_sums(clusters: DataFrame, plan: DataFrame, sums: list[str], by: list[str] = CELL) -> DataFrame:
    """Weighted sums of each replicate: clusters (by, cluster_idx, sums) and a plan, of one cell each where it holds ``by``."""
    joined = clusters.join(weights(plan), [c for c in by if c in plan.columns] + ["cluster_idx"])
    return joined.groupBy(*by, "rep").agg(*[F.sum(F.col("w") * F.col(c)).alias(c) for c in sums])
