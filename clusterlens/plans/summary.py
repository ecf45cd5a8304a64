"""The executive summary: clusters and spend behind each kind of finding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clusterlens import labels
from clusterlens.config import AnalysisConfig
from clusterlens.functions.drivers import oversized_driver
from clusterlens.functions.runtime import days_until, runtime_family
from clusterlens.operators.inventory import live_clusters
from clusterlens.operators.joins import lookup_join, splittable_join
from clusterlens.operators.pricing import cluster_costs
from clusterlens.operators.spend import AMOUNTS, factored, repeated, weighted_sum
from clusterlens.plans.vm import too_old, with_generations
from clusterlens.sources.tables import InputTables

CATEGORIES = {
    "runtime_critical": labels.RUNTIME_CRITICAL,
    "runtime_warning": labels.RUNTIME_WARNING,
    "old_vm": labels.OLD_VM,
    "oversized_driver": labels.OVERSIZED_DRIVER,
}


def _with_runtime_hits(records: DataFrame, t: InputTables, cfg: AnalysisConfig) -> DataFrame:
    """Number of matching schedule entries that make a record critical, or put it in the warning range.

    The warning range includes both of its ends; critical includes expired.
    """
    days = days_until(F.col("end_of_support"), cfg)
    schedule = t.lts.groupBy("lts_version").agg(
        F.count_if(days < labels.CRITICAL_DAYS).alias("critical_entries"),
        F.count_if(days.between(labels.CRITICAL_DAYS, labels.WARNING_DAYS)).alias("warning_entries"),
    )
    schedule = schedule.select(F.col("lts_version").alias("_family"), "lts_version", "critical_entries", "warning_entries")
    joined = splittable_join(records.withColumn("_family", runtime_family(F.col("dbr_version"))), schedule, "_family", "left")
    non_lts = F.when(F.col("lts_version").isNull(), 1)
    return joined.withColumns(
        {
            "runtime_critical": non_lts.otherwise(F.col("critical_entries")),
            "runtime_warning": F.coalesce(F.col("warning_entries"), F.lit(0)),
        }
    )


def _with_old_vm_hits(records: DataFrame, t: InputTables, cfg: AnalysisConfig) -> DataFrame:
    return with_generations(records, cfg).withColumn("old_vm", too_old().cast("int"))


def _with_driver_hits(records: DataFrame, t: InputTables, cfg: AnalysisConfig) -> DataFrame:
    specs = t.node_types.groupBy(F.col("node_type").alias("driver_node_type")).agg(
        F.count_if(oversized_driver(F.col("core_count"), F.col("memory_mb"), cfg)).alias("oversized_entries")
    )
    joined = lookup_join(records, specs, t, "node_types", "driver_node_type", "left")
    return joined.withColumn("oversized_driver", F.coalesce(F.col("oversized_entries"), F.lit(0)))


def _totals(
    categories: list[str],
    t: InputTables,
    cfg: AnalysisConfig,
    costs: DataFrame | None,
    latest_only: bool,
) -> DataFrame:
    """One row per category, in the given order, from a single pass over clusters and usage.

    Hits are counted per cluster before costs are joined. A record that a lookup matches several times counts as often,
    and a category without hits has no total rather than a total of zero.
    """
    costs = cluster_costs(t, cfg) if costs is None else costs
    records = live_clusters(t.clusters, cfg, latest_only=latest_only)
    if {"runtime_critical", "runtime_warning"} & set(categories):
        records = _with_runtime_hits(records, t, cfg)
    if "old_vm" in categories:
        records = _with_old_vm_hits(records, t, cfg)
    if "oversized_driver" in categories:
        records = _with_driver_hits(records, t, cfg)
    kinds = {name: costs.schema[name].dataType for name in AMOUNTS}
    counts = [F.sum(c).alias(c) for c in categories]
    by_count = all(factored(kind) for kind in kinds.values())
    if by_count:
        priced = records.groupBy("cluster_id").agg(*counts).join(costs, "cluster_id", "left")
    else:  # too many decimals to multiply by counts: add up record by record
        joined = splittable_join(records.select("cluster_id", *categories), costs, "cluster_id", "left")
        sums = [
            F.sum(repeated(F.col(c), F.coalesce(F.col(name), F.lit(0)), kind)).alias(f"{c}_{name}")
            for c in categories
            for name, kind in kinds.items()
        ]
        priced = joined.groupBy("cluster_id").agg(*counts, *sums)
    priced = priced.where(F.greatest(*(F.col(c) for c in categories), F.lit(0)) > 0)

    def spend(category: str, name: str) -> Column:
        n = F.col(category)
        if not by_count:
            return F.round(F.sum(F.when(n > 0, F.col(f"{category}_{name}"))), 2)
        return F.round(weighted_sum(F.when(n > 0, n), F.coalesce(F.col(name), F.lit(0)), kinds[name]), 2)

    def totals(category: str) -> Column:
        title, action = CATEGORIES[category]
        return F.struct(
            F.lit(title).alias("issue_category"),
            F.count_if(F.col("cluster_id").isNotNull() & (F.col(category) > 0)).alias("cluster_count"),
            *(spend(category, name).alias(name) for name in AMOUNTS),
            F.lit(action).alias("recommendation"),
        )

    summary = priced.agg(F.array(*(totals(c) for c in categories)).alias("rows"))
    return summary.select(F.inline("rows"))


def summary_runtime_critical(
    t: InputTables, cfg: AnalysisConfig, costs: DataFrame | None = None, *, latest_only: bool = False
) -> DataFrame:
    """Clusters without long-term support, or with less than six months of it left."""
    return _totals(["runtime_critical"], t, cfg, costs, latest_only)


def summary_runtime_warning(
    t: InputTables, cfg: AnalysisConfig, costs: DataFrame | None = None, *, latest_only: bool = False
) -> DataFrame:
    """Clusters with six months to a year of support left."""
    return _totals(["runtime_warning"], t, cfg, costs, latest_only)


def summary_old_vm(
    t: InputTables, cfg: AnalysisConfig, costs: DataFrame | None = None, *, latest_only: bool = False
) -> DataFrame:
    """Clusters with a driver or worker below the minimum generation."""
    return _totals(["old_vm"], t, cfg, costs, latest_only)


def summary_oversized_driver(
    t: InputTables, cfg: AnalysisConfig, costs: DataFrame | None = None, *, latest_only: bool = False
) -> DataFrame:
    """Clusters with a driver above the limits."""
    return _totals(["oversized_driver"], t, cfg, costs, latest_only)


def executive_summary(
    t: InputTables, cfg: AnalysisConfig, costs: DataFrame | None = None, *, latest_only: bool = False
) -> DataFrame:
    """All four categories as one table."""
    return _totals(list(CATEGORIES), t, cfg, costs, latest_only).select(
        F.col("issue_category").alias("Issue Category"),
        F.col("cluster_count").alias("Affected Clusters"),
        F.col("total_dbus").alias("Total DBUs"),
        F.col("total_cost_usd").alias("Total Cost (USD)"),
        F.col("recommendation").alias("Recommendation"),
    )
