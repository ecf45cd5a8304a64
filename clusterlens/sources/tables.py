"""The input tables and where they come from."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from dataclasses import dataclass, replace
from datetime import date
from types import MappingProxyType

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clusterlens import schemas
from clusterlens.config import AnalysisConfig
from clusterlens.operators.ranges import Ranges

# Where a metastore keeps the five inputs.
DEFAULT_NAMES = MappingProxyType(
    {
        "clusters": "system.compute.clusters",
        "node_types": "system.compute.node_types",
        "node_timeline": "system.compute.node_timeline",
        "usage": "system.billing.usage",
        "list_prices": "system.billing.list_prices",
    }
)

# Version, release, end of support and Spark version of each runtime with long-term support.
LTS_SCHEDULE = (
    ("17.3", date(2025, 10, 22), date(2028, 10, 22), "4.0.0"),
    ("16.4", date(2025, 5, 9), date(2028, 5, 9), "3.5.2"),
    ("15.4", date(2024, 8, 19), date(2027, 8, 19), "3.5.0"),
    ("14.3", date(2024, 2, 1), date(2027, 2, 1), "3.5.0"),
    ("13.3", date(2023, 8, 22), date(2026, 8, 22), "3.4.1"),
    ("12.2", date(2023, 3, 1), date(2026, 3, 1), "3.3.2"),
)

# A dimension is broadcast only within these bounds: its rows, the bytes of its keys, and the rows of any one key.
BROADCAST_MAX_ROWS = 500_000
BROADCAST_MAX_KEY_BYTES = 32 * 1024 * 1024
BROADCAST_MAX_ROWS_PER_KEY = 1_000

def lts_support(spark: SparkSession, schedule: Iterable[tuple[str, date, date, str]] = LTS_SCHEDULE) -> DataFrame:
    """The support schedule as a local relation, whose exact size the optimizer knows."""
    names = schemas.LTS_SUPPORT.fieldNames()
    rows = [dict(zip(names, row, strict=True)) for row in schedule]
    return spark.createDataFrame(pa.Table.from_pylist(rows), schemas.LTS_SUPPORT)


def fits_broadcast(dimension: DataFrame, *keys: str) -> bool:
    """Measure a dimension with one distributed aggregate over its key columns."""
    per_key = dimension.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows"))
    width = sum((F.coalesce(F.octet_length(F.col(k).cast("string")), F.lit(0)) for k in keys), F.lit(0))
    n_rows, peak = F.sum("n_rows").alias("n_rows"), F.max("n_rows").alias("peak")
    size = per_key.agg(n_rows, peak, F.sum(width * F.col("n_rows")).alias("n_bytes")).first()
    return (
        (size.n_rows or 0) <= BROADCAST_MAX_ROWS
        and (size.peak or 0) <= BROADCAST_MAX_ROWS_PER_KEY
        and (size.n_bytes or 0) <= BROADCAST_MAX_KEY_BYTES
    )


@dataclass(frozen=True)
class InputTables:
    """One DataFrame per input, and the names of the dimensions that were measured to be small.

    ``small`` may hold ``node_types``, ``list_prices`` and ``daily_prices`` (prices spelled out by day of the window, for
    a SKU with very many of them). ``from_frames`` and ``from_catalog`` measure; the plain constructor does not, and then
    no dimension gets a broadcast hint and joins take the shuffled path, unless the optimizer's own size check decides
    otherwise. ``no_samples_from`` is a day from which on telemetry is known to have no samples. ``price_ranges`` are the
    ranges by which usage and prices are joined where prices are not small; where they are not given, each report that
    needs them measures them.
    """

    clusters: DataFrame
    node_types: DataFrame
    node_timeline: DataFrame
    usage: DataFrame
    list_prices: DataFrame
    lts: DataFrame
    small: frozenset[str] = frozenset()
    no_samples_from: date | None = None
    price_ranges: Ranges | None = None

    @classmethod
    def from_catalog(
        cls, spark: SparkSession, names: Mapping[str, str] = DEFAULT_NAMES, cfg: AnalysisConfig | None = None
    ) -> InputTables:
        """Read the tables from the catalog; ``names`` may override some of the default names."""
        unknown = set(names) - set(DEFAULT_NAMES)
        if unknown:
            raise ValueError(f"unknown tables: {sorted(unknown)}")
        resolved = {**DEFAULT_NAMES, **names}
        return cls(**{k: spark.table(v) for k, v in resolved.items()}, lts=lts_support(spark)).measured(cfg)

    @classmethod
    def from_frames(cls, *, cfg: AnalysisConfig | None = None, lts: DataFrame | None = None, **frames: DataFrame) -> InputTables:
        """The five inputs as DataFrames by name, measured; ``lts`` replaces the built-in support schedule."""
        spark = next(iter(frames.values())).sparkSession
        return cls(**frames, lts=lts_support(spark) if lts is None else lts).measured(cfg)

    def measured(self, cfg: AnalysisConfig | None = None) -> InputTables:
        """The same tables, with the size of each dimension checked once for all reports.

        With a configuration, only the prices that can be valid in its window count, as only they are broadcast.
        """
        from clusterlens.operators.pricing import active_prices, by_day, price_ranges
        from clusterlens.operators.telemetry import first_later_day, no_samples_from

        prices = self.list_prices.withColumnRenamed("sku_name", "price_sku") if cfg is None else active_prices(self.list_prices, cfg)
        small, ranges = set(), None
        if fits_broadcast(self.node_types, "node_type"):
            small.add("node_types")
        if fits_broadcast(prices, "price_sku"):
            small.add("list_prices")
        elif cfg is not None and fits_broadcast(by_day(prices, cfg), "price_sku", "price_day"):
            small.add("daily_prices")
        elif cfg is not None:
            ranges = price_ranges(self.list_prices, cfg)
        until = None if cfg is None else first_later_day(cfg)
        if until is not None and not no_samples_from(self.node_timeline, until):
            until = None
        return replace(self, small=frozenset(small), no_samples_from=until, price_ranges=ranges)
