"""All reports in one run."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from uuid import uuid4

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clusterlens.config import AnalysisConfig
from clusterlens.operators.pricing import cluster_costs
from clusterlens.operators.spend import AMOUNTS
from clusterlens.operators.telemetry import utilization_of
from clusterlens.plans.drivers import driver_sizing_summary, oversized_driver_detail
from clusterlens.plans.runtime import outdated_runtime_detail, runtime_distribution
from clusterlens.plans.summary import executive_summary
from clusterlens.plans.utilization import (
    bottleneck_summary,
    high_cpu_clusters,
    high_io_wait_clusters,
    high_memory_clusters,
)
from clusterlens.plans.vm import old_vm_detail, vm_distribution
from clusterlens.sources.tables import InputTables

COST_REPORTS = {
    "outdated_runtime_detail": outdated_runtime_detail,
    "runtime_distribution": runtime_distribution,
    "old_vm_detail": old_vm_detail,
    "vm_distribution": vm_distribution,
    "oversized_driver_detail": oversized_driver_detail,
    "driver_sizing_summary": driver_sizing_summary,
}
UTILIZATION_REPORTS = {
    "high_cpu_clusters": high_cpu_clusters,
    "high_io_wait_clusters": high_io_wait_clusters,
    "high_memory_clusters": high_memory_clusters,
    "bottleneck_summary": bottleneck_summary,
}


SHARED_FLAGS = ("has_costs", "has_stats")


def _per_cluster(t: InputTables, cfg: AnalysisConfig) -> DataFrame:
    """Costs and utilization side by side, with flags for which of the two a cluster has."""
    costs = cluster_costs(t, cfg).withColumn("has_costs", F.lit(True))
    stats = utilization_of(t, cfg).withColumn("has_stats", F.lit(True))
    return costs.join(stats, "cluster_id", "full")


@contextmanager
def all_reports(
    t: InputTables, cfg: AnalysisConfig, *, ordered: bool = True, latest_only: bool = False
) -> Iterator[dict[str, DataFrame]]:
    """Every report by name. Usage and telemetry, the two large inputs, are each read and aggregated once.

    Both aggregates go into one table, bucketed by cluster, in the output schema (else the session's current one): its
    scans keep the partitioning, read only the columns a report needs, and survive lost executors. The reports are valid
    inside the ``with`` block; the table is dropped at its end.
    """
    spark = t.usage.sparkSession
    parts = [cfg.output_catalog, *cfg.output_schema.split(".")] if cfg.output_schema else []
    table = ".".join(f"`{part}`" for part in [*filter(None, parts), f"clusterlens_run_{uuid4().hex}"])
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # one writer per bucket, as the shuffle and the buckets hash alike
    rows = _per_cluster(t, cfg).repartition(buckets, "cluster_id")
    try:
        rows.write.format("parquet").bucketBy(buckets, "cluster_id").saveAsTable(table)
        # the files are far smaller than the rows in them, so their size would have one row per cluster broadcast
        shared = spark.table(table).hint("merge")
        costs = shared.where("has_costs").select("cluster_id", *AMOUNTS)
        others = [c for c in shared.columns if c not in (*AMOUNTS, *SHARED_FLAGS, "cluster_id")]
        stats = shared.where("has_stats").select("cluster_id", *others)
        options = {"ordered": ordered, "latest_only": latest_only}
        reports = {name: report(t, cfg, costs, **options) for name, report in COST_REPORTS.items()}
        reports["executive_summary"] = executive_summary(t, cfg, costs, latest_only=latest_only)
        for name, report in UTILIZATION_REPORTS.items():
            reports[name] = report(t, cfg, costs, stats, **options)
        yield reports
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {table}")
