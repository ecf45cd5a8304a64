"""Keeping the history of a report."""

from __future__ import annotations

import re
import uuid
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from clusterlens.config import AnalysisConfig


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def storable(report: DataFrame) -> DataFrame:
    """The report with column names that every table format takes: if one does not, all in lower case with underscores."""
    if all(re.fullmatch(r"\w+", name) for name in report.columns):
        return report
    return report.toDF(*[re.sub(r"\W+", "_", name).strip("_").lower() for name in report.columns])


def history_table(name: str, cfg: AnalysisConfig) -> str:
    """The quoted name of the table that keeps a report."""
    if not cfg.output_schema:
        raise ValueError("output_schema is not configured")
    parts = [cfg.output_catalog, *cfg.output_schema.split("."), name]
    return ".".join(_quoted(part) for part in parts if part)


def report_history(spark: SparkSession, name: str, cfg: AnalysisConfig) -> DataFrame:
    """All that has been saved of a report, with the date of each row in ``as_of``."""
    return spark.table(history_table(name, cfg))


def _sums(columns: list[str]) -> list[Column]:
    """Number of rows and a checksum that does not depend on their order."""
    row = F.xxhash64(*[F.col(_quoted(c)) for c in columns]).cast("decimal(38,0)")
    return [F.count(F.lit(1)).alias("n_rows"), F.coalesce(F.sum(row), F.lit(0)).cast("string").alias("checksum")]


def _described(spark: SparkSession, table: str) -> dict[str, str]:
    return {row.col_name: row.data_type for row in spark.sql(f"DESCRIBE TABLE EXTENDED {table}").collect()}


def _remove_other_runs(spark: SparkSession, folder: str, prefix: str, kept: set[str]) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if files.exists(path):
        for status in files.listStatus(path):
            run = status.getPath().getName()
            if run.startswith(prefix) and run not in kept:
                files.delete(status.getPath(), True)


def _staged(report: DataFrame, folder: str) -> None:
    """Write the report and read it back: as many rows with the same checksum as were written, or an error."""
    seen = Observation()
    report.observe(seen, *_sums(report.columns)).write.format("parquet").save(folder)
    written = seen.get
    stored = report.sparkSession.read.schema(report.schema).parquet(folder).agg(*_sums(report.columns)).first().asDict()
    if written and written != stored:
        raise RuntimeError(f"{folder} holds {stored}, but {written} was written")


def _swap_in(report: DataFrame, table: str, location: str, day: str) -> None:
    """Put a verified copy of the report in the place of one date by a single change in the catalog.

    Until then readers see the rows of before, whatever fails. The folder that was replaced stays until the next save of
    that date, for readers that have begun on it.
    """
    spark = report.sparkSession
    runs, run = f"{location.rstrip('/')}/_runs", f"{day}-{uuid.uuid4().hex}"
    folder = f"{runs}/{run}"
    try:
        _staged(report, folder)
    except BaseException:
        _remove_other_runs(spark, runs, run, set())
        raise
    partition = f"PARTITION (as_of = DATE '{day}')"
    if spark.sql(f"SHOW PARTITIONS {table} {partition}").isEmpty():
        spark.sql(f"ALTER TABLE {table} ADD {partition} LOCATION '{folder}'")
        kept = {run}
    else:
        before = _described_partition(spark, table, partition)
        spark.sql(f"ALTER TABLE {table} {partition} SET LOCATION '{folder}'")
        kept = {run, before.rstrip("/").rsplit("/", 1)[-1]}
    spark.catalog.refreshTable(table)
    _remove_other_runs(spark, runs, f"{day}-", kept)


def _described_partition(spark: SparkSession, table: str, partition: str) -> str:
    rows = spark.sql(f"DESCRIBE TABLE EXTENDED {table} {partition}").collect()
    return next(row.data_type for row in rows if row.col_name == "Location")


def save_report(report: DataFrame, name: str, cfg: AnalysisConfig) -> str:
    """Write a report into the partition of its date and return the table name.

    Columns are stored under the names of ``storable``. A table whose columns differ in name or type is left alone.

    The table lies in the configured catalog and schema. Saving again for the same date replaces that date only, also by
    an empty report, so a failed run can be repeated. Into a Parquet table the rows are written beside those of
    the date, read back, compared by count and checksum, and then swapped in at once; other formats, which mostly have
    transactions, are overwritten. Pass
    reports built with ``ordered=False``: a stored table needs no total order.
    """
    table = history_table(name, cfg)
    report = storable(report)
    spark = report.sparkSession
    if not spark.catalog.tableExists(table):
        empty = report.where(F.lit(False)).withColumn("as_of", F.lit(cfg.as_of))
        empty.write.mode("ignore").partitionBy("as_of").saveAsTable(table)
    stored = {f.name: f.dataType for f in spark.table(table).schema if f.name != "as_of"}
    offered = {f.name: f.dataType for f in report.schema}
    if stored != offered:
        raise ValueError(f"columns of {table} differ from those of the report: {stored} / {offered}")
    report = report.select([F.col(_quoted(column)) for column in stored])
    known = _described(spark, table)
    if known.get("Provider", "").lower() == "parquet" and "Location" in known:
        _swap_in(report, table, known["Location"], str(cfg.as_of))
    else:
        spark.sql(
            f"INSERT OVERWRITE TABLE {table} PARTITION (as_of = DATE '{cfg.as_of}') SELECT * FROM {{report}}", report=report
        )
    return table


def save_reports(reports: dict[str, DataFrame], cfg: AnalysisConfig, *, at_once: int = 6) -> list[str]:
    """``save_report`` for each, some at a time: many of their stages have few tasks, which leave other cores idle.

    If one fails, the others are saved before its error is raised.
    """
    if not reports:
        return []
    spark = next(iter(reports.values())).sparkSession
    save = inheritable_thread_target(spark)(lambda name: save_report(reports[name], name, cfg))
    with ThreadPoolExecutor(at_once) as pool:
        return list(pool.map(save, reports))
