"""Joins that stay balanced when one key holds a large part of the rows."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clusterlens.sources.tables import InputTables


def _image(key: str) -> Column:
    """A one-to-one image of a text key; NULL stays NULL."""
    return F.concat(F.lit("="), F.col(key).cast("string"))


def splittable_join(left: DataFrame, right: DataFrame, on: str, how: str) -> DataFrame:
    """Left or inner equi-join of rows with possibly hot text keys to a frame that was aggregated by the same key.

    Adaptive execution splits a skewed partition only if both inputs come straight from a shuffle, whereas a join on the
    grouping key itself would run in the stage of the aggregation. The join is therefore on an image of the key alone,
    whose partitioning no earlier step can have: Spark shuffles the aggregated rows, one per key, once more, whatever
    its options for co-partitioned joins. Where these prove small at run time they are broadcast instead.
    """
    others = [c for c in right.columns if c != on]
    rows = left.withColumn("_image", _image(on))
    joined = rows.join(right.select(_image(on).alias("_image"), *others), "_image", how)
    return joined.select(on, *[c for c in left.columns if c != on], *others)


def lookup_join(rows: DataFrame, lookup: DataFrame, t: InputTables, dimension: str, on: str, how: str) -> DataFrame:
    """Join a lookup made from a dimension: broadcast if the dimension was measured small, else shuffled."""
    if dimension in t.small:
        return rows.join(F.broadcast(lookup), on, how)
    return splittable_join(rows, lookup, on, how)
