"""The five inputs derived from TPC-H-like tables, as laid down in FIXTURES.md.

Clusters come from customers, usage from line items, telemetry from events; node types and prices are short fixed lists.
"""

from __future__ import annotations

from datetime import date, datetime, timedelta
from decimal import Decimal
from functools import cached_property

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clusterlens import schemas
from clusterlens.operators.ranges import Ranges
from clusterlens.sources.tables import lts_support

AS_OF = date(2026, 12, 1)

# Runtimes and node types (name, cores, memory in MB) that clusters cycle through.
RUNTIMES = (
    "17.3.x-scala2.13",
    "16.4.x-scala2.12",
    "15.4.x-photon-scala2.12",
    "14.3.x-cpu-ml-scala2.12",
    "13.3.x-scala2.12",
    "12.2.x-gpu-ml-scala2.12",
    "15.1.x-scala2.12",
    "11.3.x-scala2.12",
    "custom-image",
)
NODES = (
    ("Standard_D4ds_v5", 4.0, 16384),
    ("Standard_D16s_v3", 16.0, 65536),
    ("Standard_DS3_v2", 4.0, 14336),
    ("Standard_E8ds_v4", 8.0, 65536),
    ("Standard_E32ds_v5", 32.0, 262144),
    ("Standard_F8s_v2", 8.0, 16384),
    ("Standard_L8s_v2", 8.0, 65536),
    ("Standard_M64ms", 64.0, 1792000),
    ("Standard_NC24ads_A100_v4", 24.0, 225280),
    ("Standard_D64ds_v5", 64.0, 262144),
    ("m5.xlarge", 4.0, 16384),
    ("Standard_E20_v5", 20.0, 163840),
)
# SKU, first day, first day no longer valid, price.
PRICES = (
    ("A_F", "2020-01-01", "2026-11-15", "0.1500"),
    ("A_F", "2026-11-15", None, "0.2200"),
    ("A_O", "2020-01-01", None, "0.5500"),
    ("N_F", "2020-01-01", "2026-11-20", "0.0700"),
    ("N_F", "2026-11-20", None, "0.1000"),
    ("N_O", "2020-01-01", "2026-11-10", "0.3000"),
    ("R_F", "2020-01-01", None, "0.4000"),
)


def _pick(values: tuple, index: Column) -> Column:
    return F.get(F.array(*(F.lit(v) for v in values)), index.cast("int"))


def _days_before(days: Column) -> Column:
    return F.date_sub(F.lit(AS_OF), days.cast("int")).cast("timestamp")


def clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Change records: one per customer, more for every eighth and tenth, made in a single scan."""
    customer = spark.read.parquet(f"{sf_dir}/customer.parquet")
    nation = spark.read.parquet(f"{sf_dir}/nation.parquet").select("n_nationkey", "n_regionkey")
    k = F.col("c_custkey")

    def block(shift: int, modulus: int) -> Column:
        return F.struct(F.lit(shift).alias("shift"), F.lit(modulus).alias("modulus"))

    blocks = F.array_compact(
        F.array(block(0, 45), F.when(k % 8 == 0, block(1, 20)), F.when(k % 10 == 0, block(0, 25)))
    )
    records = customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select("*", F.inline(blocks))
    names = tuple(node[0] for node in NODES)
    shift = F.col("shift")
    return records.select(
        F.concat(F.lit("acct-"), F.col("n_regionkey").cast("string")).alias("account_id"),
        F.concat(F.lit("ws-"), F.col("c_nationkey").cast("string")).alias("workspace_id"),
        F.concat(F.lit("c-"), k.cast("string")).alias("cluster_id"),
        F.col("c_name").alias("cluster_name"),
        F.concat(F.lit("owner-"), (k % 17).cast("string")).alias("owned_by"),
        _pick(RUNTIMES, (k + shift) % len(RUNTIMES)).alias("dbr_version"),
        _pick(names, (k + shift) % len(names)).alias("driver_node_type"),
        F.when(k % 13 != 0, _pick(names, (k * 5 + 3 + shift) % len(names))).alias("worker_node_type"),
        (k % 9).cast("long").alias("worker_count"),
        F.when(F.col("c_mktsegment") == "BUILDING", "JOB").otherwise("UI").alias("cluster_source"),
        _days_before(k % F.col("modulus")).alias("change_time"),
        F.when(k % 11 == 0, F.lit(AS_OF).cast("timestamp")).alias("delete_time"),
    )


def usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    lineitem = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    cluster_id = F.concat(F.lit("c-"), F.col("o_custkey").cast("string"))
    return lineitem.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.concat("l_returnflag", F.lit("_"), "l_linestatus").alias("sku_name"),
        _days_before((F.col("l_orderkey") * 3 + F.col("l_linenumber")) % 60).alias("usage_start_time"),
        F.col("l_quantity").cast("decimal(18,4)").alias("usage_quantity"),
        F.struct(F.when(F.col("l_linenumber") != 7, cluster_id).alias("cluster_id")).alias("usage_metadata"),
    )


def node_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    event, user = F.col("event_id"), F.col("user_id")

    def metric(hot: Column, when_hot: Column, otherwise: Column, name: str) -> Column:
        return F.when(hot, when_hot).otherwise(otherwise).cast("double").alias(name)

    return events.select(
        F.concat(F.lit("c-"), user.cast("string")).alias("cluster_id"),
        F.timestamp_add("DAY", F.lit(1035), F.col("ts")).cast("timestamp").alias("start_time"),
        (event % 6 == 0).alias("driver"),
        metric(user % 4 == 0, 65 + event % 20, 20 + event % 20, "cpu_user_percent"),
        (event % 9).cast("double").alias("cpu_system_percent"),
        metric(user % 5 == 1, 8 + event % 15, event % 4, "cpu_wait_percent"),
        metric(user % 7 == 2, 75 + event % 20, 40 + event % 25, "mem_used_percent"),
        metric(user % 9 == 3, event % 5, F.lit(0), "mem_swap_percent"),
    )


def node_types(spark: SparkSession) -> DataFrame:
    rows = [dict(zip(schemas.NODE_TYPES.fieldNames(), node, strict=True)) for node in NODES]
    return spark.createDataFrame(pa.Table.from_pylist(rows), schemas.NODE_TYPES)


def list_prices(spark: SparkSession) -> DataFrame:
    def midnight(day: str | None) -> datetime | None:
        return day and datetime.fromisoformat(day)

    day = pa.timestamp("us")
    schema = pa.schema(
        [
            ("sku_name", pa.string()),
            ("price_start_time", day),
            ("price_end_time", day),
            ("pricing", pa.struct([("default", pa.decimal128(18, 4))])),
        ]
    )
    rows = [
        {
            "sku_name": sku,
            "price_start_time": midnight(start),
            "price_end_time": midnight(end),
            "pricing": {"default": Decimal(price)},
        }
        for sku, start, end, price in PRICES
    ]
    local = spark.createDataFrame(pa.Table.from_pylist(rows, schema))
    return local.select([F.col(f.name).cast(f.dataType) for f in schemas.LIST_PRICES])


def quoted_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A long price list made from line items, with overlaps, ties, open and invalid intervals: one SKU per part, and one
    with a third of all prices."""
    lineitem = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    hot, start = F.col("l_orderkey") % 3 == 0, F.col("l_shipdate").cast("timestamp")
    days = F.when(hot, F.col("l_partkey") % 3).otherwise(F.col("l_partkey") % 40 - 1)
    end = F.when(hot | (F.col("l_partkey") % 50 != 0), F.timestamp_add("DAY", days.cast("int"), start))
    return lineitem.select(
        F.when(hot, "hot").otherwise(F.concat(F.lit("P-"), F.col("l_partkey").cast("string"))).alias("sku_name"),
        start.alias("price_start_time"),
        end.cast("timestamp").alias("price_end_time"),
        F.struct(F.col("l_extendedprice").cast("decimal(18,4)").alias("default")).alias("pricing"),
    )


_last_samples: dict[tuple[str, str], date | None] = {}


class SampleTables:
    """The inputs as ``InputTables`` holds them, each derived when first used.

    The two dimensions are the short lists above, so their size is known without measuring; ``small`` chooses other join
    paths.
    """

    small = frozenset({"node_types", "list_prices"})
    price_ranges = None

    def __init__(
        self, spark: SparkSession, sf_dir: str, small: frozenset[str] = small, price_ranges: Ranges | None = None
    ) -> None:
        self._spark, self._sf_dir, self.small, self.price_ranges = spark, sf_dir, small, price_ranges

    @cached_property
    def clusters(self) -> DataFrame:
        return clusters(self._spark, self._sf_dir)

    @cached_property
    def node_types(self) -> DataFrame:
        return node_types(self._spark)

    @cached_property
    def node_timeline(self) -> DataFrame:
        return node_timeline(self._spark, self._sf_dir)

    @cached_property
    def no_samples_from(self) -> date | None:
        """Measured once per session and folder."""
        key = self._spark.sparkContext.applicationId, self._sf_dir
        if key not in _last_samples:
            _last_samples[key] = self.node_timeline.agg(F.max(F.to_date("start_time"))).first()[0]
        last = _last_samples[key]
        return last and last + timedelta(days=1)

    @cached_property
    def usage(self) -> DataFrame:
        return usage(self._spark, self._sf_dir)

    @cached_property
    def list_prices(self) -> DataFrame:
        return list_prices(self._spark)

    @cached_property
    def lts(self) -> DataFrame:
        return lts_support(self._spark)
