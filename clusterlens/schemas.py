"""Schemas of the input tables: the columns that the reports read."""

from pyspark.sql import types as T

_STRING, _LONG, _DOUBLE = T.StringType(), T.LongType(), T.DoubleType()
_TIMESTAMP, _MONEY = T.TimestampType(), T.DecimalType(18, 4)


def _table(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in columns.items()])


CLUSTERS = _table(
    account_id=_STRING,
    workspace_id=_STRING,
    cluster_id=_STRING,
    cluster_name=_STRING,
    owned_by=_STRING,
    dbr_version=_STRING,
    driver_node_type=_STRING,
    worker_node_type=_STRING,
    worker_count=_LONG,
    cluster_source=_STRING,
    change_time=_TIMESTAMP,
    delete_time=_TIMESTAMP,
)

NODE_TYPES = _table(node_type=_STRING, core_count=_DOUBLE, memory_mb=_LONG)

NODE_TIMELINE = _table(
    cluster_id=_STRING,
    start_time=_TIMESTAMP,
    driver=T.BooleanType(),
    cpu_user_percent=_DOUBLE,
    cpu_system_percent=_DOUBLE,
    cpu_wait_percent=_DOUBLE,
    mem_used_percent=_DOUBLE,
    mem_swap_percent=_DOUBLE,
)

USAGE = _table(
    sku_name=_STRING,
    usage_start_time=_TIMESTAMP,
    usage_quantity=_MONEY,
    usage_metadata=_table(cluster_id=_STRING),
)

LIST_PRICES = _table(
    sku_name=_STRING,
    price_start_time=_TIMESTAMP,
    price_end_time=_TIMESTAMP,
    pricing=_table(default=_MONEY),
)

LTS_SUPPORT = T.StructType(
    [
        T.StructField("lts_version", _STRING, False),
        T.StructField("release_date", T.DateType(), False),
        T.StructField("end_of_support", T.DateType(), False),
        T.StructField("spark_version", _STRING, False),
    ]
)
