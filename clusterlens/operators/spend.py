"""Joining costs to cluster records and adding them up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clusterlens.operators.joins import splittable_join

AMOUNTS = ("total_dbus", "total_cost_usd")

# Up to this scale the count of records, any BIGINT, and the fraction of an amount fit one decimal product.
MAX_FACTORED_SCALE = 18


def amounts() -> list[Column]:
    """Output columns for clusters that may have no usage."""
    return [F.coalesce(F.col(name), F.lit(0)).alias(name) for name in AMOUNTS]


def factored(kind: T.DataType) -> bool:
    """Whether equal records may be counted first and multiplied by their amount: not if the scale is too long."""
    return not isinstance(kind, T.DecimalType) or kind.scale <= MAX_FACTORED_SCALE


def weighted_sum(records: Column, amount: Column, kind: T.DataType) -> Column:
    """Sum of ``records * amount`` without the loss of scale of a plain decimal product, for ``factored`` kinds.

    Whole and fractional part are multiplied and summed apart, so there is no bound on the count; the total has the
    scale of the amount and may have 37 digits.
    """
    if not isinstance(kind, T.DecimalType):
        return F.sum(records * amount)
    exact = amount.cast(kind)
    whole = F.when(exact < 0, F.ceil(exact)).otherwise(F.floor(exact)).cast(T.DecimalType(38, 0))
    fraction = (exact % F.lit(1).cast(T.DecimalType(1, 0))).cast(T.DecimalType(max(1, kind.scale), kind.scale))
    count, total = records.cast(T.DecimalType(19, 0)), T.DecimalType(37, kind.scale)
    return F.sum(count * whole).cast(total) + F.sum(count * fraction).cast(total)


def repeated(records: Column, amount: Column, kind: T.DecimalType) -> Column:
    """``records * amount`` by addition, for small counts and kinds too long to multiply."""
    total = T.DecimalType(37, kind.scale)
    start, each = F.lit(0).cast(total), amount.cast(total)
    added = F.aggregate(F.sequence(F.lit(1), records.cast("int")), start, lambda sum_, _: (sum_ + each).cast(total))
    return F.when(records == 1, each).when(records < 1, start).otherwise(added)


def spend_by_group(records: DataFrame, keys: list[str], costs: DataFrame) -> DataFrame:
    """Distinct clusters, records, quantity and cost per group; every record counts the whole cost of its cluster.

    Records are first counted per cluster and group. That shrinks a cluster with very many records before it is
    shuffled, and leaves each cluster once per group, so that counting distinct clusters needs no distinct aggregation.
    Amounts with more than ``MAX_FACTORED_SCALE`` decimals are added up record by record instead, in a join that can
    split a hot cluster.
    """
    present = [name for name in AMOUNTS if name in costs.columns]
    kinds = {name: costs.schema[name].dataType for name in present}
    if all(factored(kind) for kind in kinds.values()):
        per_cluster = records.groupBy("cluster_id", *keys).agg(F.count(F.lit(1)).alias("records"))
        priced = per_cluster.join(costs, "cluster_id", "left")
        totals = [
            weighted_sum(F.col("records"), F.coalesce(F.col(name), F.lit(0)), kind).alias(name)
            for name, kind in kinds.items()
        ]
    else:
        joined = splittable_join(records.select("cluster_id", *keys), costs.select("cluster_id", *present), "cluster_id", "left")
        sums = [F.sum(F.coalesce(F.col(name), F.lit(0)).cast(kind)).alias(name) for name, kind in kinds.items()]
        priced = joined.groupBy("cluster_id", *keys).agg(F.count(F.lit(1)).alias("records"), *sums)
        totals = [F.sum(name).alias(name) for name in present]
    return priced.groupBy(*keys).agg(
        F.count("cluster_id").alias("cluster_count"), F.sum("records").alias("record_count"), *totals
    )


def share_of_total(amount: str = "total_cost_usd") -> Column:
    """Percentage of the grand total, or NULL if that is zero.

    Evaluated over the groups, which are as few as runtime families or VM types; the rows behind them have been
    aggregated before.
    """
    total = F.sum(amount).over(Window.partitionBy())
    return F.round(F.col(amount) * 100 / F.nullif(total, F.lit(0)), 2)
