"""Bottleneck reports from worker telemetry.

Telemetry and costs are both aggregated by cluster, so they join without another shuffle; only then do they meet the
change records.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clusterlens.config import AnalysisConfig
from clusterlens.functions.runtime import runtime_type
from clusterlens.functions.utilization import (
    bottleneck_recommendation,
    bottleneck_type,
    cpu_recommendation,
    io_recommendation,
    memory_bound,
    memory_recommendation,
)
from clusterlens.operators.inventory import RECORD_ORDER, live_clusters
from clusterlens.operators.joins import splittable_join
from clusterlens.operators.pricing import cluster_costs, round_costs
from clusterlens.operators.spend import amounts, factored, share_of_total, weighted_sum
from clusterlens.operators.telemetry import utilization_of
from clusterlens.sources.tables import InputTables


def _detail(
    found: DataFrame,
    columns: list[str | Column],
    t: InputTables,
    cfg: AnalysisConfig,
    costs: DataFrame | None,
    ordered: bool,
    latest_only: bool,
) -> DataFrame:
    """Live records of the clusters found, with costs, most expensive first."""
    costs = cluster_costs(t, cfg) if costs is None else costs
    found = found.join(round_costs(costs), "cluster_id", "left")
    rows = splittable_join(live_clusters(t.clusters, cfg, latest_only=latest_only), found, "cluster_id", "inner")
    if ordered:
        rows = rows.orderBy(F.col("total_cost_usd").desc_nulls_last(), *RECORD_ORDER)
    identity = ["account_id", "workspace_id", "cluster_id", "cluster_name", F.col("owned_by").alias("owner")]
    return rows.select(*identity, "dbr_version", *columns)


def _rounded(stats: DataFrame, *names: str) -> DataFrame:
    return stats.withColumns({name: F.round(name, 2) for name in names})


def high_cpu_clusters(
    t: InputTables,
    cfg: AnalysisConfig,
    costs: DataFrame | None = None,
    stats: DataFrame | None = None,
    *,
    ordered: bool = True,
    latest_only: bool = False,
) -> DataFrame:
    """Clusters whose average worker CPU, once rounded, reaches the threshold."""
    stats = utilization_of(t, cfg) if stats is None else stats
    shown = ["avg_cpu_percent", "max_cpu_percent"]
    found = _rounded(stats, *shown).select("cluster_id", *shown, "days_active")
    found = found.where(F.col("avg_cpu_percent") >= cfg.cpu_threshold)
    version = F.col("dbr_version")
    advice = cpu_recommendation(version, F.col("avg_cpu_percent"), cfg)
    columns = [
        runtime_type(version).alias("runtime_type"),
        *shown,
        "days_active",
        *amounts(),
        advice.alias("recommendation"),
    ]
    return _detail(found, columns, t, cfg, costs, ordered, latest_only)


def high_io_wait_clusters(
    t: InputTables,
    cfg: AnalysisConfig,
    costs: DataFrame | None = None,
    stats: DataFrame | None = None,
    *,
    ordered: bool = True,
    latest_only: bool = False,
) -> DataFrame:
    """Clusters whose average worker I/O wait, not rounded, reaches the threshold."""
    stats = utilization_of(t, cfg) if stats is None else stats
    shown = ["avg_io_wait_percent", "max_io_wait_percent", "avg_cpu_percent"]
    found = _rounded(stats.where(F.col("avg_io_wait_percent") >= cfg.io_wait_threshold), *shown)
    advice = io_recommendation(F.col("avg_io_wait_percent"), cfg)
    columns = [*shown, "driver_node_type", "worker_node_type", *amounts(), advice.alias("recommendation")]
    return _detail(found.select("cluster_id", *shown), columns, t, cfg, costs, ordered, latest_only)


def high_memory_clusters(
    t: InputTables,
    cfg: AnalysisConfig,
    costs: DataFrame | None = None,
    stats: DataFrame | None = None,
    *,
    ordered: bool = True,
    latest_only: bool = False,
) -> DataFrame:
    """Clusters whose average worker memory or swap, not rounded, reaches its threshold."""
    stats = utilization_of(t, cfg) if stats is None else stats
    memory, swap = F.col("avg_memory_percent"), F.col("avg_swap_percent")
    shown = ["avg_memory_percent", "max_memory_percent", "avg_swap_percent", "max_swap_percent"]
    found = _rounded(stats.where(memory_bound(memory, swap, cfg)), *shown)
    advice = memory_recommendation(memory, swap, cfg)
    columns = [*shown, "driver_node_type", "worker_node_type", *amounts(), advice.alias("recommendation")]
    return _detail(found.select("cluster_id", *shown), columns, t, cfg, costs, ordered, latest_only)


def bottleneck_summary(
    t: InputTables,
    cfg: AnalysisConfig,
    costs: DataFrame | None = None,
    stats: DataFrame | None = None,
    *,
    ordered: bool = True,
    latest_only: bool = False,
) -> DataFrame:
    """Live records with telemetry and their cost per bottleneck; counts records, not distinct clusters."""
    costs = cluster_costs(t, cfg) if costs is None else costs
    stats = utilization_of(t, cfg) if stats is None else stats
    live = live_clusters(t.clusters, cfg, latest_only=latest_only).where(F.col("cluster_id").isNotNull())
    bottleneck = bottleneck_type(
        F.col("avg_cpu_percent"),
        F.col("avg_io_wait_percent"),
        F.col("avg_memory_percent"),
        F.col("avg_swap_percent"),
        cfg,
    )
    spent = costs.select("cluster_id", "total_cost_usd")
    kind, cost = costs.schema["total_cost_usd"].dataType, F.coalesce(F.col("total_cost_usd"), F.lit(0))
    if factored(kind):
        per_cluster = live.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("records"))
        loaded = per_cluster.join(stats, "cluster_id", "inner").join(spent, "cluster_id", "left")
        total = weighted_sum(F.col("records"), cost, kind)
    else:
        per_record = live.select("cluster_id", F.lit(1).alias("records"))
        loaded = splittable_join(per_record, stats.join(spent, "cluster_id", "left"), "cluster_id", "inner")
        total = F.sum(cost.cast(kind))
    groups = loaded.withColumn("bottleneck_type", bottleneck).groupBy("bottleneck_type").agg(
        F.sum("records").alias("cluster_count"), total.alias("total_cost_usd")
    )
    rows = groups.withColumn("pct_of_total_cost", share_of_total()).withColumn(
        "total_cost_usd", F.round("total_cost_usd", 2)
    )
    if ordered:
        rows = rows.orderBy(F.col("total_cost_usd").desc(), "bottleneck_type")
    return rows.select(
        "bottleneck_type",
        bottleneck_recommendation(F.col("bottleneck_type")).alias("recommendation"),
        "cluster_count",
        "total_cost_usd",
        "pct_of_total_cost",
    )
