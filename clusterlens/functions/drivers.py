"""Expressions over the hardware of driver nodes."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from clusterlens import labels
from clusterlens.config import AnalysisConfig


def memory_gb(memory_mb: Column) -> Column:
    return memory_mb / 1024


def oversized_driver(cores: Column, memory_mb: Column, cfg: AnalysisConfig) -> Column:
    """Strictly above either limit; memory is compared before rounding."""
    return (cores > cfg.driver_cpu_threshold) | (memory_gb(memory_mb) > cfg.driver_memory_gb_threshold)


def sizing_status(cores: Column, memory_mb: Column, cfg: AnalysisConfig) -> Column:
    return (
        F.when(cores > cfg.driver_cpu_threshold, labels.VCPUS_TOO_HIGH)
        .when(memory_gb(memory_mb) > cfg.driver_memory_gb_threshold, labels.MEMORY_TOO_HIGH)
        .otherwise(labels.APPROPRIATELY_SIZED)
    )


def driver_recommendation(cores: Column) -> Column:
    """Advice by fixed core counts, whatever the configured limits."""
    return (
        F.when(cores > labels.DRIVER_CORES_FOR_E8, labels.CONSIDER_E8)
        .when(cores > labels.DRIVER_CORES_FOR_E4, labels.CONSIDER_E4)
        .otherwise(labels.REVIEW_WORKLOAD)
    )
