
from __future__ import annotations

import sys
import uuid
from collections.abc import Callable
from dataclasses import replace
from datetime import timedelta
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

sys.path.insert(0, str(Path(__file__).resolve().parent))

import oracle_queries  # noqa: E402
from clusterlens.config import AnalysisConfig  # noqa: E402
from clusterlens.functions import drivers, runtime, utilization, vm  # noqa: E402
from clusterlens.operators.inventory import live_clusters, workspace_ids  # noqa: E402
from clusterlens.operators.pricing import cluster_costs, overlapping_prices, price_ranges, priced_usage  # noqa: E402
from clusterlens.operators.specs import with_node_specs  # noqa: E402
from clusterlens.operators.spend import AMOUNTS, share_of_total, spend_by_group  # noqa: E402
from clusterlens.operators.support import with_support  # noqa: E402
from clusterlens.operators.telemetry import utilization_of  # noqa: E402
from clusterlens.plans import drivers as driver_reports  # noqa: E402
from clusterlens.plans import runtime as runtime_reports  # noqa: E402
from clusterlens.plans import full_run, summary, utilization as utilization_reports  # noqa: E402
from clusterlens.plans import vm as vm_reports  # noqa: E402
from clusterlens.sources import testdata  # noqa: E402
from clusterlens.sources.sink import report_history, save_report, save_reports  # noqa: E402
from clusterlens.sources.tables import InputTables  # noqa: E402

try:  # the operators for training text are optional; only their absence is passed over
    import corpus_pipeline
    from clusterlens.llm import queries as llm_queries
except ModuleNotFoundError as missing:
    if missing.name not in ("corpus_pipeline", "clusterlens.llm", "clusterlens.llm.queries"):
        raise
    llm_queries = corpus_pipeline = None

CONFIG = AnalysisConfig(as_of=testdata.AS_OF)

Report = Callable[[InputTables, AnalysisConfig], DataFrame]


def _workspace_ids(t: InputTables, cfg: AnalysisConfig) -> DataFrame:
    return workspace_ids(t.clusters)


def _live_clusters(t: InputTables, cfg: AnalysisConfig) -> DataFrame:
    return live_clusters(t.clusters, cfg)


def _live_clusters_latest(t: InputTables, cfg: AnalysisConfig) -> DataFrame:
    return live_clusters(t.clusters, cfg, latest_only=True)


def _cluster_costs_rounded(t: InputTables, cfg: AnalysisConfig) -> DataFrame:
    return cluster_costs(t, cfg, rounded=True)


def _runtime_family(t: InputTables, cfg: AnalysisConfig) -> DataFrame:
    version = F.col("dbr_version")
    return t.clusters.select(
        "cluster_id",
        "dbr_version",
        runtime.runtime_family(version).alias("runtime_family"),
    )


def _runtime_type(t: InputTables, cfg: AnalysisConfig) -> DataFrame:
    kind = runtime.runtime_type(F.col("dbr_version")).alias("runtime_type")
    return t.clusters.select("cluster_id", "dbr_version", kind)


def _with_support(t: InputTables, cfg: AnalysisConfig) -> DataFrame:
    return with_support(live_clusters(t.clusters, cfg), t.lts, cfg).select(
        "cluster_id", "dbr_version", "runtime_family", "lts_version", "end_of_support", "days_until_eos"
    )


def _support_status(t: InputTables, cfg: AnalysisConfig) -> DataFrame:
    supported = with_support(live_clusters(t.clusters, cfg), t.lts, cfg)
    lts, days = F.col("lts_version"), F.col("days_until_eos")
    return supported.select(
        "cluster_id",
        "dbr_version",
        runtime.support_status(lts, days, detailed=True).alias("detailed_status"),
        runtime.support_status(lts, days, detailed=False).alias("short_status"),
    )


def _vm_series(t: InputTables, cfg: AnalysisConfig) -> DataFrame:
    series = vm.vm_series(F.col("worker_node_type")).alias("vm_series")
    return t.clusters.select("cluster_id", "worker_node_type", series)


def _vm_generation(t: InputTables, cfg: AnalysisConfig) -> DataFrame:
    generation = vm.vm_generation(F.col("worker_node_type")).alias("vm_generation")
    return t.clusters.select("cluster_id", "worker_node_type", generation)


def _vm_threshold(t: InputTables, cfg: AnalysisConfig) -> DataFrame:
    series = vm.vm_series(F.col("worker_node_type"))
    return t.clusters.select("cluster_id", "worker_node_type", vm.vm_threshold(series, cfg).alias("vm_threshold"))


def _below_vm_threshold(t: InputTables, cfg: AnalysisConfig) -> DataFrame:
    below = vm_reports.too_old().alias("below_threshold")
    return vm_reports.with_generations(t.clusters, cfg).select(
        "cluster_id", "driver_node_type", "worker_node_type", below
    )


def _with_node_specs(t: InputTables, cfg: AnalysisConfig) -> DataFrame:
    known = with_node_specs(live_clusters(t.clusters, cfg), t, "driver", "inner")
    both = with_node_specs(known, t, "worker", "left")
    memory = [
        F.round(drivers.memory_gb(F.col(f"{role}_memory_mb")), 1).alias(f"{role}_memory_gb")
        for role in ("driver", "worker")
    ]
    return both.select("cluster_id", "driver_node_type", "driver_cores", "worker_node_type", "worker_cores", *memory)


def _oversized_driver(t: InputTables, cfg: AnalysisConfig) -> DataFrame:
    cores, memory = F.col("driver_cores"), F.col("driver_memory_mb")
    return with_node_specs(live_clusters(t.clusters, cfg), t, "driver", "inner").select(
        "cluster_id",
        "driver_node_type",
        drivers.oversized_driver(cores, memory, cfg).alias("is_oversized"),
        drivers.sizing_status(cores, memory, cfg).alias("sizing_status"),
        drivers.driver_recommendation(cores).alias("recommendation"),
    )


def _worker_utilization(t: InputTables, cfg: AnalysisConfig) -> DataFrame:
    stats = utilization_of(t, cfg)
    return stats.select([F.round(c, 2).alias(c) if c.endswith("_percent") else F.col(c) for c in stats.columns])


def _bottleneck_type(t: InputTables, cfg: AnalysisConfig) -> DataFrame:
    averages = [F.col(f"avg_{m}_percent") for m in ("cpu", "io_wait", "memory", "swap")]
    bottleneck = utilization.bottleneck_type(*averages, cfg)
    return utilization_of(t, cfg).select("cluster_id", bottleneck.alias("bottleneck_type"))


def _share_of_total(t: InputTables, cfg: AnalysisConfig) -> DataFrame:
    by_sku = priced_usage(t, cfg).groupBy("sku_name").agg(F.sum("cost_usd").alias("total_cost_usd"))
    return by_sku.select("sku_name", share_of_total().alias("pct_of_total_cost"))


def _spend_by_group_wide(t: InputTables, cfg: AnalysisConfig) -> DataFrame:
    """Costs with as many decimals as a decimal(38,18) holds."""
    wide = [F.col(name).cast("decimal(38,18)").alias(name) for name in AMOUNTS]
    return spend_by_group(live_clusters(t.clusters, cfg), ["dbr_version"], cluster_costs(t, cfg).select("cluster_id", *wide))


REPORTS: dict[str, Report] = {
    "workspace_ids": _workspace_ids,
    "live_clusters": _live_clusters,
    "live_clusters_latest": _live_clusters_latest,
    "priced_usage": priced_usage,
    "cluster_costs": cluster_costs,
    "cluster_costs_rounded": _cluster_costs_rounded,
    "runtime_family": _runtime_family,
    "runtime_type": _runtime_type,
    "with_support": _with_support,
    "support_status": _support_status,
    "vm_series": _vm_series,
    "vm_generation": _vm_generation,
    "vm_threshold": _vm_threshold,
    "below_vm_threshold": _below_vm_threshold,
    "with_node_specs": _with_node_specs,
    "oversized_driver": _oversized_driver,
    "worker_utilization": _worker_utilization,
    "bottleneck_type": _bottleneck_type,
    "share_of_total": _share_of_total,
    "spend_by_group_wide": _spend_by_group_wide,
    "outdated_runtime_detail": runtime_reports.outdated_runtime_detail,
    "runtime_distribution": runtime_reports.runtime_distribution,
    "old_vm_detail": vm_reports.old_vm_detail,
    "vm_distribution": vm_reports.vm_distribution,
    "oversized_driver_detail": driver_reports.oversized_driver_detail,
    "driver_sizing_summary": driver_reports.driver_sizing_summary,
    "summary_runtime_critical": summary.summary_runtime_critical,
    "summary_runtime_warning": summary.summary_runtime_warning,
    "summary_old_vm": summary.summary_old_vm,
    "summary_oversized_driver": summary.summary_oversized_driver,
    "executive_summary": summary.executive_summary,
    "high_cpu_clusters": utilization_reports.high_cpu_clusters,
    "high_io_wait_clusters": utilization_reports.high_io_wait_clusters,
    "high_memory_clusters": utilization_reports.high_memory_clusters,
    "bottleneck_summary": utilization_reports.bottleneck_summary,
}


# The same reports by their other join paths: nothing measured small, or prices broadcast by day.
PATHS: dict[str, frozenset[str]] = {"shuffled": frozenset(), "daily": frozenset({"node_types", "daily_prices"})}
BY_PATH: dict[str, tuple[str, str]] = {
    "priced_usage_shuffled": ("priced_usage", "shuffled"),
    "priced_usage_daily": ("priced_usage", "daily"),
    "cluster_costs_daily": ("cluster_costs", "daily"),
    "with_node_specs_shuffled": ("with_node_specs", "shuffled"),
    "executive_summary_shuffled": ("executive_summary", "shuffled"),
    "oversized_driver_detail_shuffled": ("oversized_driver_detail", "shuffled"),
}
RANGED = ("priced_usage", "cluster_costs", "executive_summary")
# And with other parameters than the defaults.
PARAMS = {
    "workspace_filter": "ws-4", "lookback_days": "7", "driver_cpu_threshold": "8", "driver_memory_gb_threshold": "32",
    "cpu_threshold": "40", "io_wait_threshold": "5", "memory_threshold": "60", "swap_threshold": "2",
    "vm_threshold_D": "4", "vm_threshold_E": "6", "vm_threshold_default": "1",
}
TUNED = (
    "live_clusters", "live_clusters_latest", "priced_usage", "vm_threshold", "below_vm_threshold", "oversized_driver",
    "bottleneck_type", "outdated_runtime_detail", "runtime_distribution", "old_vm_detail", "vm_distribution",
    "oversized_driver_detail", "driver_sizing_summary", "executive_summary", "high_cpu_clusters",
    "high_io_wait_clusters", "high_memory_clusters", "bottleneck_summary",
)


def _comparable(df: DataFrame) -> DataFrame:
    """Decimals and nullable integers as doubles, dates and timestamps as text: the same values in both engines."""
    casts = {
        T.DecimalType: "double",
        T.IntegerType: "double",
        T.DateType: "string",
        T.TimestampType: "string",
    }
    columns = []
    for field in df.schema:
        column, target = F.col(f"`{field.name}`"), casts.get(type(field.dataType))
        columns.append(column.cast(target).alias(field.name) if target else column)
    return df.select(columns)


def _query(
    report: Report, cfg: AnalysisConfig = CONFIG, small: frozenset[str] = testdata.SampleTables.small
) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: _comparable(report(testdata.SampleTables(spark, sf_dir, small), cfg))


def _overlapping_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _comparable(overlapping_prices(testdata.quoted_prices(spark, sf_dir)))


def _ranged(report: Report) -> Callable[[SparkSession, str], DataFrame]:
    """With usage and prices cut into as many ranges of time as their rule allows."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        ranges = price_ranges(testdata.list_prices(spark), CONFIG, min_weight=1)
        return _comparable(report(testdata.SampleTables(spark, sf_dir, frozenset(), ranges), CONFIG))

    return query


# All reports from one full run, saved while its shared table exists, and read back from their histories.
FULL_RUN = tuple([*full_run.COST_REPORTS, "executive_summary", *full_run.UTILIZATION_REPORTS])
_runs: dict[tuple[str, str], AnalysisConfig] = {}


def _new_schema(spark: SparkSession, cfg: AnalysisConfig) -> AnalysisConfig:
    schema = f"clusterlens_{uuid.uuid4().hex}"
    spark.sql(f"CREATE DATABASE {schema}")
    return replace(cfg, output_schema=schema)


def _saved_run(spark: SparkSession, sf_dir: str) -> AnalysisConfig:
    """Where the reports of the session's full run over these tables are kept; the first caller makes the run."""
    key = spark.sparkContext.applicationId, sf_dir
    if key not in _runs:
        cfg = _new_schema(spark, CONFIG)
        with full_run.all_reports(testdata.SampleTables(spark, sf_dir), cfg, ordered=False) as reports:
            save_reports(reports, cfg)
        left = spark.sql(f"SHOW TABLES IN {cfg.output_schema} LIKE 'clusterlens_run_*'")
        if not left.isEmpty():
            raise RuntimeError("the shared table of the full run is still there")
        _runs[key] = cfg
    return _runs[key]


def _from_full_run(name: str) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        saved = report_history(spark, name, _saved_run(spark, sf_dir)).drop("as_of")
        shown = dict(zip(saved.columns, oracle_queries.SHOWN_NAMES.get(name, saved.columns), strict=True))
        return _comparable(saved.withColumnsRenamed(shown))

    return query


def _report_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two dates of a report, the first of them saved twice."""
    tables, cfg = testdata.SampleTables(spark, sf_dir), _new_schema(spark, CONFIG)
    for days in (0, 1, 0):
        dated = replace(cfg, as_of=cfg.as_of + timedelta(days=days))
        save_report(driver_reports.driver_sizing_summary(tables, dated, ordered=False), "driver_sizing_summary", dated)
    return _comparable(report_history(spark, "driver_sizing_summary", cfg))


def _own_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    tuned = AnalysisConfig.from_params({**PARAMS, "as_of": testdata.AS_OF})
    queries = {name: _query(report) for name, report in REPORTS.items()}
    queries |= {name: _query(REPORTS[base], small=PATHS[path]) for name, (base, path) in BY_PATH.items()}
    queries |= {f"{name}_full_run": _from_full_run(name) for name in FULL_RUN} | {"report_history": _report_history}
    queries |= {f"{name}_ranged": _ranged(REPORTS[name]) for name in RANGED} | {"overlapping_prices": _overlapping_prices}
    return queries | {f"{name}_tuned": _query(REPORTS[name], tuned) for name in TUNED}


def _own_sql() -> dict[str, str]:
    sql, tuned = oracle_queries.all_queries(), oracle_queries.all_queries(params=PARAMS)
    others = {name: sql[base] for name, (base, _) in BY_PATH.items()} | {f"{name}_full_run": sql[name] for name in FULL_RUN}
    others |= {f"{name}_ranged": sql[name] for name in RANGED}
    return sql | others | {f"{name}_tuned": tuned[name] for name in TUNED}


def entry(spark: SparkSession) -> DataFrame:
    return queries()["runtime_distribution"](spark, "/root/testdata/sf0.001")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = _own_queries()
    return own if llm_queries is None else own | llm_queries.QUERIES | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    own = _own_sql()
    if llm_queries is None:
        return own
    pipeline = {} if corpus_pipeline.ORACLE_SQL is None else {"pipeline": corpus_pipeline.ORACLE_SQL}
    return own | llm_queries.ORACLE_SQL | pipeline
