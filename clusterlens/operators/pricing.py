"""Metered usage and its list prices."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clusterlens.config import AnalysisConfig
from clusterlens.operators.ranges import Ranges, equal_ranges, sampled_ranges
from clusterlens.sources.tables import InputTables


def recent_usage(usage: DataFrame, cfg: AnalysisConfig) -> DataFrame:
    return usage.where(F.col("usage_start_time") >= F.lit(cfg.window_start)).select(
        F.col("usage_metadata.cluster_id").alias("cluster_id"), "sku_name", "usage_start_time", "usage_quantity"
    )


def active_prices(list_prices: DataFrame, cfg: AnalysisConfig) -> DataFrame:
    """Prices that can match usage in the lookback window: those that ended before it are left out."""
    return list_prices.where(
        F.col("price_end_time").isNull() | (F.col("price_end_time") > F.lit(cfg.window_start))
    ).select(
        F.col("sku_name").alias("price_sku"),
        "price_start_time",
        "price_end_time",
        F.col("pricing.default").alias("list_price"),
    )


def _window_day(instant: Column, cfg: AnalysisConfig) -> Column:
    """Day of the lookback window; its first day stands for earlier ones too, and the day after it for later ones."""
    day = F.date_diff(F.to_date(instant), F.lit(cfg.window_start))
    return F.least(F.greatest(day, F.lit(0)), F.lit(cfg.lookback_days + 1))


def by_day(prices: DataFrame, cfg: AnalysisConfig) -> DataFrame:
    """One row per price and day of the window it covers, at most ``lookback_days + 2`` of them."""
    start, end = F.col("price_start_time"), F.col("price_end_time")
    last_day = F.when(end.isNull(), F.lit(cfg.lookback_days + 1)).otherwise(_window_day(end, cfg))
    return prices.where(start.isNotNull() & (end.isNull() | (start < end))).withColumn(
        "price_day", F.explode(F.sequence(_window_day(start, cfg), last_day))
    )


def _valid_prices(prices: DataFrame) -> DataFrame:
    start, end = F.col("price_start_time"), F.col("price_end_time")
    return prices.where(F.col("price_sku").isNotNull() & start.isNotNull() & (end.isNull() | (start < end)))


def price_ranges(list_prices: DataFrame, cfg: AnalysisConfig, **options: int) -> Ranges:
    """Ranges of the prices that can be valid in the window; those that began before it begin with it."""
    start = F.greatest(F.col("price_start_time"), F.lit(cfg.window_start).cast("timestamp"))
    prices = _valid_prices(active_prices(list_prices, cfg))
    return equal_ranges(prices, "price_sku", start, F.col("price_end_time"), **options)


def by_range(prices: DataFrame, ranges: Ranges) -> DataFrame:
    """One row per price and range that it reaches into."""
    start, end = F.col("price_start_time"), F.col("price_end_time")
    reach = ranges.added_to(_valid_prices(prices), "price_sku", first=(start, True), last=(end, False))
    return reach.withColumn("price_range", F.explode(F.sequence("first", "last"))).drop("first", "last")


def priced_usage(t: InputTables, cfg: AnalysisConfig) -> DataFrame:
    """Usage in the lookback window with the list price valid at its start, or 0 where there is none.

    A price is valid from its start up to, but not including, its end. Where validity intervals of a SKU overlap, usage
    is repeated once per price; ``overlapping_prices`` finds them.

    Measured small, the prices are broadcast and usage is not shuffled. If only single SKUs have too many of them, the
    prices are broadcast by SKU and day of the window, so that a row of usage is compared with those of its day alone.
    Otherwise usage and prices meet in a shuffle on SKU and range of time. Ranges hold about equally many prices of a SKU,
    and all together repeat a price once on average at most, however long prices and window are (``price_ranges``).
    Adaptive execution splits a SKU with much usage.
    """
    usage, prices = recent_usage(t.usage, cfg), active_prices(t.list_prices, cfg)
    start, end = F.col("price_start_time"), F.col("price_end_time")
    begun = F.col("usage_start_time")
    valid = (F.col("sku_name") == F.col("price_sku")) & (begun >= start) & (end.isNull() | (begun < end))
    if "list_prices" in t.small:
        priced = usage.join(F.broadcast(prices), valid, "left")
    elif "daily_prices" in t.small:
        usage = usage.withColumn("usage_day", _window_day(begun, cfg))
        same_day = F.col("usage_day") == F.col("price_day")
        priced = usage.join(F.broadcast(by_day(prices, cfg)), valid & same_day, "left")
    else:
        ranges = t.price_ranges if t.price_ranges is not None else price_ranges(t.list_prices, cfg)
        usage = ranges.added_to(usage, "sku_name", usage_range=(begun, True))
        same_range = F.col("usage_range") == F.col("price_range")
        priced = usage.join(by_range(prices, ranges), valid & same_range, "left")
    unit_price, kinds = F.coalesce(F.col("list_price"), F.lit(0)), {f.name: f.dataType for f in priced.schema}
    cost = F.col("usage_quantity") * unit_price
    if cfg.exact_costs:
        cost = exact_product(F.col("usage_quantity"), unit_price, kinds["usage_quantity"], kinds["list_price"])
    return priced.select(
        "cluster_id",
        "sku_name",
        "usage_start_time",
        "usage_quantity",
        unit_price.alias("unit_price"),
        cost.alias("cost_usd"),
    )


# An exact product is made of numbers with at most so many decimals, and has as many; so are its whole digits bounded.
EXACT_SCALE, EXACT_WHOLE = 18, 17
MAX_PRECISION = 38  # of any decimal type


def exact_product(a: Column, b: Column, kind_a: T.DataType, kind_b: T.DataType) -> Column:
    """``a * b`` rounded once, half up, to as many decimals as both have together, at most ``EXACT_SCALE``.

    Whole and fractional parts are multiplied apart, each exactly, and have one sign, so that only the product of the
    fractions is rounded. Types whose plain product is exact, or with too many decimals to be split, are multiplied
    plainly, and so are numbers with more than ``EXACT_WHOLE`` whole digits between them.
    """
    both = (kind_a, kind_b)
    if not all(isinstance(kind, T.DecimalType) for kind in both):
        return a * b
    if kind_a.precision + kind_b.precision < MAX_PRECISION or max(k.scale for k in both) > EXACT_SCALE:
        return a * b
    scale = min(kind_a.scale + kind_b.scale, EXACT_SCALE)
    kept = T.DecimalType(18 + scale, scale)
    parts = []
    for column, kind in ((a, kind_a), (b, kind_b)):
        exact = column.cast(kind)
        whole = F.when(exact < 0, F.ceil(exact)).otherwise(F.floor(exact)).cast(T.DecimalType(18, 0))
        fraction = (exact % F.lit(1).cast(T.DecimalType(1, 0))).cast(T.DecimalType(EXACT_SCALE, EXACT_SCALE))
        parts.append((whole, fraction))
    (whole_a, fraction_a), (whole_b, fraction_b) = parts
    total = (whole_a * whole_b).cast(kept)
    for left, right in ((whole_a, fraction_b), (fraction_a, whole_b), (fraction_a, fraction_b)):
        total = (total + F.round(left * right, scale).cast(kept)).cast(kept)
    bound = F.lit(10.0**EXACT_WHOLE)
    sizes = F.abs(a.cast("double")), F.abs(b.cast("double"))
    fits = (sizes[0] < bound) & (sizes[1] < bound) & (sizes[0] * sizes[1] < bound)
    plain = (a.cast(kind_a) * b.cast(kind_b)).cast(T.DecimalType(MAX_PRECISION, scale))
    return F.when(fits, total.cast(T.DecimalType(MAX_PRECISION, scale))).otherwise(plain)


def cluster_costs(t: InputTables, cfg: AnalysisConfig, *, rounded: bool = False) -> DataFrame:
    """Quantity and cost per cluster. Usage without a cluster is dropped before the shuffle."""
    costs = (
        priced_usage(t, cfg)
        .where(F.col("cluster_id").isNotNull())
        .groupBy("cluster_id")
        .agg(F.sum("usage_quantity").alias("total_dbus"), F.sum("cost_usd").alias("total_cost_usd"))
    )
    return round_costs(costs) if rounded else costs


def round_costs(costs: DataFrame) -> DataFrame:
    return costs.select(
        "cluster_id",
        F.round("total_dbus", 2).alias("total_dbus"),
        F.round("total_cost_usd", 2).alias("total_cost_usd"),
    )


def overlapping_prices(list_prices: DataFrame, **options: int) -> DataFrame:
    """Intervals of prices that begin before an earlier price of the same SKU has ended, and so would count usage twice,
    and ``n_prices``, how many prices with that interval do.

    Of prices that begin together, the one that ends first counts as the earlier. Equal intervals are counted before
    anything is shuffled. The latest end so far is carried over the ranges of a SKU in a first pass, a few rows for each
    SKU, and found within a range in a second, so that a SKU with very many prices is spread over tasks.
    """
    forever = F.lit("9999-12-31").cast("timestamp")
    start, end = F.col("price_start_time"), F.col("price_end_time")
    valid = list_prices.where(start.isNotNull() & (end.isNull() | (start < end)))
    ranges = sampled_ranges(valid, "sku_name", start, **options)
    counted = valid.groupBy("sku_name", start, end).agg(F.count(F.lit(1)).alias("n_prices"))
    prices = ranges.added_to(counted, "sku_name", range=(start, True)).withColumn("until", F.coalesce(end, forever))

    before = Window.unboundedPreceding, -1
    over_ranges = Window.partitionBy("sku_name").orderBy("range").rowsBetween(*before)
    in_range = Window.partitionBy("sku_name", "range").orderBy("price_start_time", "until").rowsBetween(*before)
    per_range = prices.groupBy("sku_name", "range").agg(F.max("until").alias("until"))
    carried = per_range.select(
        F.col("sku_name").alias("_sku"), F.col("range").alias("_range"), F.max("until").over(over_ranges).alias("carried")
    )
    covered = prices.withColumn("covered", F.max("until").over(in_range)).join(
        carried, F.col("sku_name").eqNullSafe(F.col("_sku")) & (F.col("range") == F.col("_range"))
    )
    overlapped = F.coalesce(start < F.greatest("covered", "carried"), F.lit(False))
    doubled = F.when(overlapped, F.col("n_prices")).otherwise(F.col("n_prices") - 1)
    return covered.select("sku_name", "price_start_time", "price_end_time", doubled.alias("n_prices")).where("n_prices > 0")
