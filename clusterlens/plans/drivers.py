"""Driver size reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clusterlens.config import AnalysisConfig
from clusterlens.functions.drivers import driver_recommendation, memory_gb, oversized_driver, sizing_status
from clusterlens.operators.inventory import RECORD_ORDER, live_clusters
from clusterlens.operators.joins import splittable_join
from clusterlens.operators.pricing import cluster_costs, round_costs
from clusterlens.operators.specs import with_node_specs
from clusterlens.operators.spend import amounts, share_of_total, spend_by_group
from clusterlens.sources.tables import InputTables


def _oversized(t: InputTables, cfg: AnalysisConfig, latest_only: bool) -> DataFrame:
    records = with_node_specs(live_clusters(t.clusters, cfg, latest_only=latest_only), t, "driver", "inner")
    return records.where(oversized_driver(F.col("driver_cores"), F.col("driver_memory_mb"), cfg))


def oversized_driver_detail(
    t: InputTables,
    cfg: AnalysisConfig,
    costs: DataFrame | None = None,
    *,
    ordered: bool = True,
    latest_only: bool = False,
) -> DataFrame:
    """Live cluster records with a driver above the limits, most expensive first."""
    costs = cluster_costs(t, cfg) if costs is None else costs
    cores, memory = F.col("driver_cores"), F.col("driver_memory_mb")
    rows = splittable_join(_oversized(t, cfg, latest_only), round_costs(costs), "cluster_id", "left")
    if ordered:
        rows = rows.orderBy(
            F.col("total_cost_usd").desc_nulls_last(), cores.desc(), memory.desc(), *RECORD_ORDER
        )
    return rows.select(
        "account_id",
        "workspace_id",
        "cluster_id",
        "cluster_name",
        F.col("owned_by").alias("owner"),
        "driver_node_type",
        cores.alias("driver_vcpus"),
        F.round(memory_gb(memory), 1).alias("driver_memory_gb"),
        sizing_status(cores, memory, cfg).alias("sizing_status"),
        "worker_node_type",
        "worker_count",
        "dbr_version",
        "cluster_source",
        *amounts(),
    )


def driver_sizing_summary(
    t: InputTables,
    cfg: AnalysisConfig,
    costs: DataFrame | None = None,
    *,
    ordered: bool = True,
    latest_only: bool = False,
) -> DataFrame:
    """Clusters, quantity, cost and advice per oversized driver type; shares are of the flagged cost only."""
    costs = cluster_costs(t, cfg) if costs is None else costs
    keys = ["driver_node_type", "driver_cores", "driver_memory_mb"]
    groups = spend_by_group(_oversized(t, cfg, latest_only), keys, costs)
    rows = groups.withColumn("pct_of_total_cost", share_of_total()).withColumns(
        {name: F.round(name, 2) for name in ("total_dbus", "total_cost_usd")}
    )
    if ordered:
        rows = rows.orderBy(F.col("total_cost_usd").desc(), *keys)
    return rows.select(
        "driver_node_type",
        F.col("driver_cores").alias("driver_vcpus"),
        F.round(memory_gb(F.col("driver_memory_mb")), 1).alias("driver_memory_gb"),
        "cluster_count",
        "total_dbus",
        "total_cost_usd",
        "pct_of_total_cost",
        driver_recommendation(F.col("driver_cores")).alias("recommendation"),
    )
