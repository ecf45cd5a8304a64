"""Hardware of node types."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clusterlens.operators.joins import lookup_join
from clusterlens.sources.tables import InputTables


def with_node_specs(clusters: DataFrame, t: InputTables, role: str, how: str = "left") -> DataFrame:
    """Add ``{role}_cores`` and ``{role}_memory_mb`` of the driver or worker type.

    An inner join drops clusters of an unknown type.
    """
    specs = t.node_types.select(
        F.col("node_type").alias(f"{role}_node_type"),
        F.col("core_count").alias(f"{role}_cores"),
        F.col("memory_mb").alias(f"{role}_memory_mb"),
    )
    return lookup_join(clusters, specs, t, "node_types", f"{role}_node_type", how)
