"""Runtime support dates."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clusterlens import labels
from clusterlens.config import AnalysisConfig
from clusterlens.functions.runtime import dated_status, days_until, runtime_family


def with_support(clusters: DataFrame, lts: DataFrame, cfg: AnalysisConfig) -> DataFrame:
    """Add the runtime family and, where it has long-term support, the version, end and days left of it.

    The schedule is a local relation of a few rows, which the optimizer broadcasts by its exact size.
    """
    days = days_until(F.col("end_of_support"), cfg).alias("days_until_eos")
    schedule = lts.select("lts_version", "end_of_support", days)
    with_family = clusters.withColumn("runtime_family", runtime_family(F.col("dbr_version")))
    return with_family.join(schedule, with_family.runtime_family == schedule.lts_version, "left")


def lts_schedule_status(lts: DataFrame, cfg: AnalysisConfig) -> DataFrame:
    days = days_until(F.col("end_of_support"), cfg)
    return lts.select(
        "lts_version",
        "release_date",
        "end_of_support",
        days.alias("days_left"),
        dated_status(days, labels.CRITICAL, labels.WARNING).alias("status"),
    )
