"""Expressions over runtime versions and their support dates."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from clusterlens import labels
from clusterlens.config import AnalysisConfig


def runtime_family(version: Column) -> Column:
    """First ``major.minor`` of a version text, or the empty string."""
    return F.regexp_extract(version, "([0-9]+[.][0-9]+)", 1)


def runtime_type(version: Column) -> Column:
    name = F.lower(version)
    return (
        F.when(name.contains("ml"), labels.ML_RUNTIME)
        .when(name.contains("gpu"), labels.GPU_RUNTIME)
        .otherwise(labels.STANDARD_RUNTIME)
    )


def days_until(end: Column, cfg: AnalysisConfig) -> Column:
    return F.date_diff(F.to_date(end), F.lit(cfg.as_of))


def dated_status(days: Column, critical: str, warning: str) -> Column:
    """Status of a runtime that has long-term support, from the days it has left."""
    return (
        F.when(days < 0, labels.EXPIRED)
        .when(days < labels.CRITICAL_DAYS, critical)
        .when(days < labels.WARNING_DAYS, warning)
        .otherwise(labels.SUPPORTED)
    )


def support_status(lts: Column, days: Column, *, detailed: bool) -> Column:
    """Status of any runtime; ``lts`` is NULL for one without long-term support."""
    if detailed:
        dated = dated_status(days, labels.CRITICAL_SIX_MONTHS, labels.WARNING_ONE_YEAR)
    else:
        dated = dated_status(days, labels.CRITICAL, labels.WARNING)
    return F.when(lts.isNull(), labels.CRITICAL_NON_LTS).otherwise(dated)


def urgency(lts: Column, days: Column) -> Column:
    """Ascending sort key. An LTS runtime that expired long ago comes before those without LTS."""
    return F.when(lts.isNull(), labels.NON_LTS_SORT_KEY).otherwise(F.coalesce(days, F.lit(labels.UNDATED_SORT_KEY)))
