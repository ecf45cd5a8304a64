"""Expressions over VM type names such as ``Standard_D16s_v3``."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from clusterlens import labels
from clusterlens.config import AnalysisConfig


def vm_series(node_type: Column) -> Column:
    """All capital letters that start the size, so ``DS`` for ``Standard_DS3_v2``; empty for other naming schemes."""
    return F.regexp_extract(node_type, "Standard_([A-Z]+)", 1)


def vm_generation_text(node_type: Column) -> Column:
    return F.regexp_extract(node_type, "_v([0-9]+)", 1)


def vm_generation(node_type: Column) -> Column:
    """Generation number, or NULL where the name has none."""
    return vm_generation_text(node_type).try_cast("int")


def vm_threshold(series: Column, cfg: AnalysisConfig) -> Column:
    """Minimum recommended generation of a series, chosen by its first letter."""
    default = F.lit(cfg.vm_threshold_default)
    if not cfg.vm_thresholds:
        return default
    by_letter = F.create_map(*(F.lit(x) for pair in sorted(cfg.vm_thresholds.items()) for x in pair))
    return F.coalesce(F.try_element_at(by_letter, F.substring(series, 1, 1)), default)


def known_generation(generation: Column) -> Column:
    return F.coalesce(generation, F.lit(labels.UNKNOWN_GENERATION))


def below_vm_threshold(
    driver_generation: Column, driver_threshold: Column, worker_generation: Column, worker_threshold: Column
) -> Column:
    """True where driver or worker is too old; a type without a generation never is."""
    return (known_generation(driver_generation) < driver_threshold) | (
        known_generation(worker_generation) < worker_threshold
    )
