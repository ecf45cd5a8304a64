"""Cluster change records."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clusterlens import schemas
from clusterlens.config import ALL_WORKSPACES, AnalysisConfig

# Last sort keys of the detail reports. They make the order repeatable, and let the records of one cluster, which agree
# in every earlier key, be sorted in several tasks.
RECORD_ORDER = ("cluster_id", "change_time", "dbr_version", "driver_node_type", "worker_node_type")


def workspace_ids(clusters: DataFrame) -> DataFrame:
    return clusters.select("workspace_id").where(F.col("workspace_id").isNotNull()).distinct().orderBy("workspace_id")


def live_clusters(clusters: DataFrame, cfg: AnalysisConfig, *, latest_only: bool = False) -> DataFrame:
    """Change records within the lookback window of clusters that are not deleted.

    A cluster that changed several times has as many rows. With ``latest_only`` it has at most one: the latest record,
    before the deletion filter, so that an older record of a deleted cluster does not come back. Of records with the same
    instant a deletion is the latest, then the largest in the order of the remaining columns, NULLs being smallest.
    Records without a cluster id are no cluster's history and all stay.

    The maximum is over a struct with texts, so Spark sorts the records of each task by cluster, but it reduces a
    cluster with very many records before the shuffle.
    """
    records = clusters.select(schemas.CLUSTERS.fieldNames()).where(F.col("change_time") >= F.lit(cfg.window_start))
    if latest_only:
        names = records.columns
        rest = [c for c in names if c not in ("cluster_id", "change_time")]
        deleted = F.col("delete_time").isNotNull().alias("_deleted")
        latest = (
            records.where(F.col("cluster_id").isNotNull())
            .groupBy("cluster_id")
            .agg(F.max(F.struct("change_time", deleted, *rest)).alias("latest"))
            .select("cluster_id", "latest.*")
        )
        records = latest.select(names).unionByName(records.where(F.col("cluster_id").isNull()))
    live = records.where(F.col("delete_time").isNull())
    if cfg.workspace_filter != ALL_WORKSPACES:
        live = live.where(F.col("workspace_id") == F.lit(cfg.workspace_filter))
    return live
