"""Utilization of worker nodes."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clusterlens.config import AnalysisConfig
from clusterlens.sources.tables import InputTables

_DAYS_PER_WORD = 63


def day_words(cfg: AnalysisConfig) -> int:
    """Words of 63 days that cover the lookback window and the day after it."""
    return -(-(cfg.lookback_days + 2) // _DAYS_PER_WORD)


def _days_active(cfg: AnalysisConfig, last_known: bool) -> Column:
    """Distinct days with samples, as a set that partial aggregates can merge.

    Days that the words cover are bits, which Spark keeps in a hash aggregate and combines map-side. Later ones can only
    occur in a window that lies in the past; unless ``last_known`` says that there are none, they are collected.
    """
    day = F.date_diff(F.to_date("start_time"), F.lit(cfg.window_start))
    total = F.lit(0).cast("bigint")
    for word in range(day_words(cfg)):
        bit = day - F.lit(word * _DAYS_PER_WORD)
        mask = F.when(bit.between(0, _DAYS_PER_WORD - 1), F.call_function("shiftleft", F.lit(1).cast("bigint"), bit))
        total += F.coalesce(F.bit_count(F.bit_or(mask)), F.lit(0))
    if last_known:
        return total
    later = F.when(day >= day_words(cfg) * _DAYS_PER_WORD, day)
    return total + F.size(F.collect_set(later))


def first_later_day(cfg: AnalysisConfig) -> date:
    """The first day beyond the words."""
    return cfg.window_start + timedelta(days=day_words(cfg) * _DAYS_PER_WORD)


def no_samples_from(node_timeline: DataFrame, day: date) -> bool:
    """Whether no sample lies on that day or later, which the statistics of the files tell if they have any."""
    return node_timeline.where(F.col("start_time") >= F.lit(day)).isEmpty()


def utilization_of(t: InputTables, cfg: AnalysisConfig) -> DataFrame:
    """``worker_utilization`` of the inputs, by what has been measured about their last samples."""
    until = t.no_samples_from
    return worker_utilization(t.node_timeline, cfg, last_known=until is not None and until <= first_later_day(cfg))


def worker_utilization(node_timeline: DataFrame, cfg: AnalysisConfig, *, last_known: bool = False) -> DataFrame:
    """Averages and maxima per cluster over its workers' samples in the lookback window, not rounded.

    The one roll-up serves every utilization report; columns that a report does not use, among them the days, are pruned
    by the optimizer. It takes one shuffle. ``last_known`` states that there are no
    samples from ``first_later_day`` on.
    """
    samples = node_timeline.where(
        (F.col("start_time") >= F.lit(cfg.window_start))
        & (F.col("driver") == F.lit(False))
        & F.col("cluster_id").isNotNull()
    )
    cpu = F.col("cpu_user_percent") + F.col("cpu_system_percent")
    metrics = {
        "cpu": cpu,
        "io_wait": F.col("cpu_wait_percent"),
        "memory": F.col("mem_used_percent"),
        "swap": F.col("mem_swap_percent"),
    }
    extremes = []
    for name, metric in metrics.items():
        extremes += [F.avg(metric).alias(f"avg_{name}_percent"), F.max(metric).alias(f"max_{name}_percent")]
    return samples.groupBy("cluster_id").agg(*extremes, _days_active(cfg, last_known).alias("days_active"))
