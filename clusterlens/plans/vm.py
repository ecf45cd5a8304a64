"""VM generation reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clusterlens import labels
from clusterlens.config import AnalysisConfig
from clusterlens.functions.drivers import memory_gb
from clusterlens.functions.vm import (
    below_vm_threshold,
    known_generation,
    vm_generation,
    vm_generation_text,
    vm_series,
    vm_threshold,
)
from clusterlens.operators.inventory import RECORD_ORDER, live_clusters
from clusterlens.operators.joins import splittable_join
from clusterlens.operators.pricing import cluster_costs, round_costs
from clusterlens.operators.specs import with_node_specs
from clusterlens.operators.spend import amounts, share_of_total, spend_by_group
from clusterlens.sources.tables import InputTables

ROLES = ("driver", "worker")


def with_generations(clusters: DataFrame, cfg: AnalysisConfig) -> DataFrame:
    """Add series, generation and minimum generation of the driver and worker types."""
    columns = {}
    for role in ROLES:
        node_type = F.col(f"{role}_node_type")
        columns[f"{role}_series"] = vm_series(node_type)
        columns[f"{role}_generation"] = vm_generation(node_type)
        columns[f"{role}_threshold"] = vm_threshold(vm_series(node_type), cfg)
    return clusters.withColumns(columns)


def too_old() -> Column:
    """Applies to the columns of ``with_generations``."""
    return below_vm_threshold(*(F.col(f"{role}_{c}") for role in ROLES for c in ("generation", "threshold")))


def old_vm_detail(
    t: InputTables,
    cfg: AnalysisConfig,
    costs: DataFrame | None = None,
    *,
    ordered: bool = True,
    latest_only: bool = False,
) -> DataFrame:
    """Live cluster records whose driver or worker type is below the minimum generation, oldest first."""
    costs = cluster_costs(t, cfg) if costs is None else costs
    records = with_generations(live_clusters(t.clusters, cfg, latest_only=latest_only), cfg).where(too_old())
    for role in ROLES:
        records = with_node_specs(records, t, role)
    rows = splittable_join(records, round_costs(costs), "cluster_id", "left")
    if ordered:
        oldest = F.least(*(known_generation(F.col(f"{role}_generation")) for role in ROLES))
        rows = rows.orderBy(oldest, F.col("total_cost_usd").desc_nulls_last(), *RECORD_ORDER)

    def generation_columns(role: str) -> list[Column]:
        shown = F.coalesce(F.col(f"{role}_generation").cast("string"), F.lit(labels.NO_GENERATION))
        return [
            F.col(f"{role}_node_type"),
            F.col(f"{role}_series"),
            shown.alias(f"{role}_vm_generation"),
            F.col(f"{role}_threshold").alias(f"{role}_min_recommended"),
        ]

    def spec_columns(role: str) -> list[Column]:
        memory = F.round(memory_gb(F.col(f"{role}_memory_mb")), 1)
        return [F.col(f"{role}_cores"), memory.alias(f"{role}_memory_gb")]

    return rows.select(
        "account_id",
        "workspace_id",
        "cluster_id",
        "cluster_name",
        F.col("owned_by").alias("owner"),
        *generation_columns("driver"),
        *generation_columns("worker"),
        F.when(too_old(), labels.BELOW_RECOMMENDED).otherwise(labels.MEETS_THRESHOLD).alias("vm_status"),
        *spec_columns("driver"),
        *spec_columns("worker"),
        "dbr_version",
        "cluster_source",
        *amounts(),
    )


def vm_distribution(
    t: InputTables,
    cfg: AnalysisConfig,
    costs: DataFrame | None = None,
    *,
    ordered: bool = True,
    latest_only: bool = False,
) -> DataFrame:
    """Clusters, quantity and cost per series and generation of the driver type."""
    costs = cluster_costs(t, cfg) if costs is None else costs
    node_type = F.col("driver_node_type")
    records = (
        live_clusters(t.clusters, cfg, latest_only=latest_only)
        .where(vm_generation_text(node_type) != "")
        .withColumns(
            {
                "series": vm_series(node_type),
                "generation_text": vm_generation_text(node_type),
                "generation": vm_generation(node_type),
                "threshold": vm_threshold(vm_series(node_type), cfg),
            }
        )
    )
    groups = spend_by_group(records, ["series", "generation_text", "generation", "threshold"], costs)
    rows = groups.withColumn("pct_of_total_cost", share_of_total())
    if ordered:
        rows = rows.orderBy("series", "generation", "generation_text")
    below = F.col("generation") < F.col("threshold")
    return rows.select(
        "series",
        F.concat(F.lit("v"), "generation_text").alias("vm_generation"),
        F.concat(F.lit("v"), F.col("threshold").cast("string")).alias("min_recommended"),
        "cluster_count",
        F.when(below, labels.BELOW_THRESHOLD).otherwise(labels.MEETS_THRESHOLD).alias("status"),
        F.round("total_dbus", 2).alias("total_dbus"),
        F.round("total_cost_usd", 2).alias("total_cost_usd"),
        "pct_of_total_cost",
    )
