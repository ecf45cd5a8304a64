"""Expressions over the utilization of a cluster's workers."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from clusterlens import labels
from clusterlens.config import AnalysisConfig


def memory_bound(memory: Column, swap: Column, cfg: AnalysisConfig) -> Column:
    return (memory >= cfg.memory_threshold) | (swap >= cfg.swap_threshold)


def bottleneck_type(cpu: Column, io_wait: Column, memory: Column, swap: Column, cfg: AnalysisConfig) -> Column:
    """The one bottleneck of a cluster: memory before I/O before CPU."""
    return (
        F.when(memory_bound(memory, swap, cfg), labels.MEMORY_BOUND)
        .when(io_wait >= cfg.io_wait_threshold, labels.IO_BOUND)
        .when(cpu >= cfg.cpu_threshold, labels.CPU_BOUND)
        .otherwise(labels.BALANCED)
    )


def bottleneck_recommendation(bottleneck: Column) -> Column:
    return (
        F.when(bottleneck == labels.CPU_BOUND, labels.FIX_CPU_BOUND)
        .when(bottleneck == labels.IO_BOUND, labels.FIX_IO_BOUND)
        .when(bottleneck == labels.MEMORY_BOUND, labels.FIX_MEMORY_BOUND)
        .otherwise(labels.FIX_NOTHING)
    )


def cpu_recommendation(version: Column, cpu: Column, cfg: AnalysisConfig) -> Column:
    high = cpu >= cfg.cpu_threshold
    ml = F.lower(version).contains("ml")
    return (
        F.when(ml & high, labels.CPU_HIGH_ML)
        .when(ml, labels.CPU_LOW_ML)
        .when(high, labels.CPU_HIGH)
        .otherwise(labels.CPU_LOW)
    )


def io_recommendation(io_wait: Column, cfg: AnalysisConfig) -> Column:
    return (
        F.when(io_wait >= cfg.io_wait_threshold * 2, labels.IO_VERY_HIGH)
        .when(io_wait >= cfg.io_wait_threshold, labels.IO_HIGH)
        .otherwise(labels.IO_MODERATE)
    )


def memory_recommendation(memory: Column, swap: Column, cfg: AnalysisConfig) -> Column:
    return (
        F.when(swap >= cfg.swap_threshold, labels.MEMORY_SWAPPING)
        .when(memory >= cfg.memory_threshold, labels.MEMORY_HIGH)
        .otherwise(labels.MEMORY_MODERATE)
    )
