"""Runtime version reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clusterlens import labels
from clusterlens.config import AnalysisConfig
from clusterlens.functions.runtime import support_status, urgency
from clusterlens.operators.inventory import RECORD_ORDER, live_clusters
from clusterlens.operators.joins import splittable_join
from clusterlens.operators.pricing import cluster_costs, round_costs
from clusterlens.operators.spend import amounts, share_of_total, spend_by_group
from clusterlens.operators.support import with_support
from clusterlens.sources.tables import InputTables


def outdated_runtime_detail(
    t: InputTables,
    cfg: AnalysisConfig,
    costs: DataFrame | None = None,
    *,
    ordered: bool = True,
    latest_only: bool = False,
    only_outdated: bool = False,
) -> DataFrame:
    """Support status of every live cluster record, most urgent and most expensive first.

    Supported clusters are listed too, unless ``only_outdated`` is set.
    """
    costs = cluster_costs(t, cfg) if costs is None else costs
    lts, days = F.col("lts_version"), F.col("days_until_eos")
    status = support_status(lts, days, detailed=True)
    records = with_support(live_clusters(t.clusters, cfg, latest_only=latest_only), t.lts, cfg)
    if only_outdated:
        records = records.where(status != labels.SUPPORTED)
    rows = splittable_join(records, round_costs(costs), "cluster_id", "left")
    if ordered:
        rows = rows.orderBy(urgency(lts, days), F.col("total_cost_usd").desc_nulls_last(), *RECORD_ORDER)
    return rows.select(
        "account_id",
        "workspace_id",
        "cluster_id",
        "cluster_name",
        F.col("owned_by").alias("owner"),
        "dbr_version",
        F.coalesce(lts, F.col("runtime_family")).alias("dbr_family"),
        F.when(lts.isNotNull(), labels.LTS).otherwise(labels.NON_LTS).alias("version_type"),
        F.col("end_of_support").cast("string").alias("end_of_support_date"),
        days,
        status.alias("support_status"),
        "driver_node_type",
        "worker_node_type",
        "cluster_source",
        *amounts(),
    )


def runtime_distribution(
    t: InputTables,
    cfg: AnalysisConfig,
    costs: DataFrame | None = None,
    *,
    ordered: bool = True,
    latest_only: bool = False,
) -> DataFrame:
    """Clusters, quantity and cost per runtime family."""
    costs = cluster_costs(t, cfg) if costs is None else costs
    records = with_support(live_clusters(t.clusters, cfg, latest_only=latest_only), t.lts, cfg)
    groups = spend_by_group(records, ["runtime_family", "end_of_support", "days_until_eos"], costs)
    end, days = F.col("end_of_support"), F.col("days_until_eos")
    rows = groups.withColumn("pct_of_total_cost", share_of_total())
    if ordered:
        rows = rows.orderBy(urgency(end, days), "runtime_family")
    return rows.select(
        F.concat(F.lit(labels.FAMILY_PREFIX), "runtime_family").alias("dbr_version"),
        F.coalesce(end.cast("string"), F.lit(labels.NO_END_OF_SUPPORT)).alias("end_of_support_date"),
        F.coalesce(days, F.lit(0)).alias("days_remaining"),
        support_status(end, days, detailed=False).alias("status"),
        "cluster_count",
        F.round("total_dbus", 2).alias("total_dbus"),
        F.round("total_cost_usd", 2).alias("total_cost_usd"),
        "pct_of_total_cost",
    )
