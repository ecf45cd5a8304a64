"""Time all reports over generated tables with hot keys: ``python larger_trial.py [usage rows in millions, default 20]``.

One cluster and one SKU hold a third of their rows each. Per million rows of usage there are 100,000 cluster records,
500,000 samples and 50,000 clusters. Nothing is kept.
"""

import sys
import tempfile
import time
from datetime import date
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clusterlens import schemas
from clusterlens.config import AnalysisConfig
from clusterlens.plans.full_run import COST_REPORTS, UTILIZATION_REPORTS, all_reports
from clusterlens.plans.summary import executive_summary
from clusterlens.session import local_session
from clusterlens.sources.tables import InputTables

RUNTIMES = ["17.3.x", "16.4.x", "14.3.x-ml", "12.2.x", "15.1.x", "custom"]
NODES = ["Standard_D4ds_v5", "Standard_D64ds_v5", "Standard_E8ds_v4", "Standard_F8s_v1", "Standard_NC24_v0"]


def one_of(values: list[str], n: Column) -> Column:
    return F.array(*map(F.lit, values))[(n % len(values)).cast("int")]


def hot(prefix: str, n: Column, others: int) -> Column:
    return F.when(n % 3 == 0, f"{prefix}-hot").otherwise(F.concat(F.lit(f"{prefix}-"), (n * 7919 % others).cast("string")))


def shaped(df: DataFrame, schema) -> DataFrame:  # noqa: ANN001
    missing = {f.name: F.lit(None).cast(f.dataType) for f in schema if f.name not in df.columns}
    return df.withColumns(missing).select([F.col(f.name).cast(f.dataType).alias(f.name) for f in schema])


def main(millions: float) -> None:
    warehouse = tempfile.mkdtemp(prefix="larger-trial-")
    settings = {"spark.sql.shuffle.partitions": "64", "spark.driver.memory": "16g", "spark.sql.warehouse.dir": warehouse}
    spark = local_session("8", "larger-trial", **settings)
    million, n = int(millions * 1_000_000), F.col("id")
    clusters, moment = max(1, million // 20), F.timestamp_seconds(F.lit(1_794_000_000) + n % 2_400_000)
    cluster_id = hot("c", n, clusters)
    frames = {
        "clusters": spark.range(million // 10).select(
            cluster_id.alias("cluster_id"), one_of(RUNTIMES, n).alias("dbr_version"), moment.alias("change_time"),
            one_of(NODES, n).alias("driver_node_type"), one_of(NODES, n + 1).alias("worker_node_type"),
        ),
        "node_timeline": spark.range(million // 2).select(
            cluster_id.alias("cluster_id"), moment.alias("start_time"), F.lit(False).alias("driver"),
            *[(n * k % 97).cast("double").alias(f"{c}_percent") for k, c in enumerate(("cpu_user", "cpu_system", "cpu_wait", "mem_used", "mem_swap"), 3)],
        ),
        "usage": spark.range(million).select(
            hot("s", n, 200).alias("sku_name"), moment.alias("usage_start_time"), (n % 100).alias("usage_quantity"),
            F.struct(cluster_id.alias("cluster_id")).alias("usage_metadata"),
        ),
        "list_prices": spark.range(201).select(
            F.when(n == 200, "s-hot").otherwise(F.concat(F.lit("s-"), n.cast("string"))).alias("sku_name"),
            F.lit("2020-01-01").cast("timestamp").alias("price_start_time"), F.struct(F.lit(0.5).cast("decimal(18,4)").alias("default")).alias("pricing"),
        ),
        "node_types": spark.range(len(NODES)).select(
            one_of(NODES, n).alias("node_type"), (n * 8 + 4).cast("double").alias("core_count"), (n * 40_000).alias("memory_mb")
        ),
    }
    with tempfile.TemporaryDirectory(prefix="larger-trial-") as folder:
        for name, frame in frames.items():
            shaped(frame, getattr(schemas, name.upper())).write.parquet(str(Path(folder) / name))
        stored = {name: spark.read.parquet(str(Path(folder) / name)) for name in frames}
        cfg = AnalysisConfig(as_of=date(2026, 12, 1))
        tables = InputTables.from_frames(cfg=cfg, **stored)

        def report(name: str, df: DataFrame) -> None:
            started = time.perf_counter()
            df.write.format("noop").mode("overwrite").save()
            sys.stdout.write(f"{name}: {time.perf_counter() - started:.1f} s\n")

        for name, build in {**COST_REPORTS, **UTILIZATION_REPORTS}.items():
            report(name, build(tables, cfg, ordered=False))
        report("executive_summary", executive_summary(tables, cfg))
        started = time.perf_counter()
        with all_reports(tables, cfg, ordered=False) as reports:
            for df in reports.values():
                df.write.format("noop").mode("overwrite").save()
        sys.stdout.write(f"all from shared aggregates: {time.perf_counter() - started:.1f} s\n")
    spark.stop()


if __name__ == "__main__":
    main(float(sys.argv[1]) if len(sys.argv) > 1 else 20)
