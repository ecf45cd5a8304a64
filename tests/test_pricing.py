import random
from dataclasses import replace
from datetime import datetime, timedelta
from decimal import ROUND_HALF_UP, Decimal, localcontext

import pytest
from pyspark.sql import functions as F

from clusterlens.config import AnalysisConfig
from clusterlens.operators.pricing import active_prices, by_range, cluster_costs, overlapping_prices, price_ranges, priced_usage
from clusterlens.operators.ranges import MIN_WEIGHT, chosen_cuts, equal_ranges, sampled_ranges
from clusterlens.sources import tables as sources
from clusterlens.sources.tables import InputTables, fits_broadcast
from tests.frames import CFG, SMALL, at, price, tables, used, values

BOTH_PATHS = pytest.mark.parametrize(
    "small", [SMALL, frozenset(), frozenset({"daily_prices"})], ids=["broadcast", "shuffled", "daily"]
)


@BOTH_PATHS
def test_validity_is_half_open(spark, small):
    prices = [price("01-01", "11-20", "2"), price("11-20", "11-25", "3")]
    usage = [used("c", begun=b) for b in ("11-19 23:59", "11-20", "11-24 23:59", "11-25")]
    rows = values(priced_usage(tables(spark, usage=usage, prices=prices, small=small), CFG), "usage_start_time", "cost_usd")
    assert [int(cost) for _, cost in sorted(rows)] == [2, 3, 3, 0]


@BOTH_PATHS
def test_overlapping_prices_repeat_usage(spark, small):
    prices = [price("01-01", None, "2"), price("11-10", "11-30", "3")]
    t = tables(spark, usage=[used("c", "4")], prices=prices, small=small)
    assert values(cluster_costs(t, CFG), "cluster_id", "total_dbus", "total_cost_usd") == [("c", Decimal(8), Decimal(20))]
    assert values(overlapping_prices(t.list_prices), "sku_name", "price_start_time") == [("S", at("11-10"))]


def test_overlaps_are_found_behind_a_short_price(spark):
    prices = [price("01-01", "06-01"), price("02-01", "02-02"), price("03-01", "07-01"), price("07-01", None), price("01-01", None, sku="T")]
    found = values(overlapping_prices(tables(spark, prices=prices).list_prices), "price_start_time")
    assert sorted(found) == [(at("02-01"),), (at("03-01"),)]


@BOTH_PATHS
def test_missing_price_and_missing_cluster(spark, small):
    usage = [used("c", "5", sku="unpriced"), used(None, "7"), used("c", "2"), used("old", begun="10-31 23:59"), used("edge", begun="11-01")]
    prices = [price("01-01", None, "1.5"), price("01-01", None, None, sku="unpriced")]
    t = tables(spark, usage=usage, prices=prices, small=small)
    assert sorted(values(cluster_costs(t, CFG), "cluster_id", "total_dbus", "total_cost_usd")) == [
        ("c", Decimal(7), Decimal(3)),
        ("edge", Decimal(1), Decimal("1.5")),
    ]
    assert priced_usage(t, CFG).count() == 4


def test_rounding_happens_after_the_sum(spark):
    t = tables(spark, usage=[used("c", "0.0040")] * 2, prices=[price("01-01", None, "0.5")])
    assert values(cluster_costs(t, CFG), "total_dbus", "total_cost_usd") == [(Decimal("0.008"), Decimal("0.004"))]
    assert values(cluster_costs(t, CFG, rounded=True), "total_dbus", "total_cost_usd") == [(Decimal("0.01"), Decimal("0.00"))]


@BOTH_PATHS
def test_against_brute_force(spark, small):
    """Random usage and prices, also outside the window, empty, reversed, overlapping and open."""
    pick = random.Random(7)
    first = datetime(2026, 10, 25)

    def instant():
        return first + timedelta(hours=pick.randrange(0, 24 * 50), minutes=pick.choice([0, 0, 30]))

    prices = []
    for sku in ("S", "T", "U"):
        for _ in range(25):
            row = price(None, None, f"{pick.randrange(1, 900) / 100}", sku)
            row["price_start_time"] = pick.choice([instant(), instant(), datetime(2020, 1, 1), None])
            row["price_end_time"] = pick.choice([instant(), instant(), instant(), None])
            prices.append(row)
    usage = []
    for n in range(300):
        row = used(pick.choice(["a", "b", "c", None]), f"{pick.randrange(1, 500) / 10}", pick.choice(["S", "S", "T", "V"]))
        row["usage_start_time"] = prices[n % len(prices)]["price_start_time"] if n % 3 == 0 else instant()
        if row["usage_start_time"]:
            usage.append(row)

    expected = {}
    for u in usage:
        if u["usage_start_time"] < datetime(2026, 11, 1):
            continue
        matches = [
            p["pricing"]["default"]
            for p in prices
            if p["sku_name"] == u["sku_name"]
            and p["price_start_time"]
            and p["price_start_time"] <= u["usage_start_time"]
            and (p["price_end_time"] is None or u["usage_start_time"] < p["price_end_time"])
        ]
        key = u["usage_metadata"]["cluster_id"]
        for amount in matches or [Decimal(0)]:
            n, quantity, cost = expected.get(key, (0, 0, 0))
            expected[key] = (n + 1, quantity + u["usage_quantity"], cost + u["usage_quantity"] * amount)

    t = tables(spark, usage=usage, prices=prices, small=small)
    got = {}
    for row in priced_usage(t, CFG).collect():
        n, quantity, cost = got.get(row.cluster_id, (0, 0, 0))
        got[row.cluster_id] = (n + 1, quantity + row.usage_quantity, cost + row.cost_usd)
    assert got == expected
    del expected[None]
    costs = values(cluster_costs(t, CFG), "cluster_id", "total_dbus", "total_cost_usd")
    assert {c: (q, d) for c, q, d in costs} == {c: (q, d) for c, (_, q, d) in expected.items()}


def test_dimensions_are_measured(spark, monkeypatch):
    t = tables(spark, prices=[price("01-01", None, sku=s) for s in ("S", "S", "T")], small=frozenset())
    assert t.measured().small == SMALL
    assert fits_broadcast(tables(spark, prices=[]).list_prices, "sku_name")
    monkeypatch.setattr(sources, "BROADCAST_MAX_ROWS_PER_KEY", 1)
    assert t.measured().small == {"node_types"}
    monkeypatch.setattr(sources, "BROADCAST_MAX_ROWS", 2)
    assert t.measured().small == frozenset()
    monkeypatch.setattr(sources, "BROADCAST_MAX_ROWS", 9)
    monkeypatch.setattr(sources, "BROADCAST_MAX_KEY_BYTES", 5)
    assert t.measured().small == frozenset()


def test_only_active_prices_are_measured(spark, monkeypatch):
    monkeypatch.setattr(sources, "BROADCAST_MAX_ROWS_PER_KEY", 2)
    ended = [price("01-01", f"02-{n:02}") for n in range(2, 20)]
    t = tables(spark, prices=[*ended, price("03-01", None)], small=frozenset())
    assert t.measured().small == {"node_types"}
    assert t.measured(CFG).small == SMALL
    many = [price(f"11-{n:02}", f"11-{n + 1:02}") for n in range(2, 20)]
    assert tables(spark, prices=many, small=frozenset()).measured(CFG).small == {"node_types", "daily_prices"}


def test_overlaps_against_brute_force(spark):
    pick = random.Random(11)
    starts = pick.sample(range(600), 120)
    prices = []
    for n in starts:
        row = price(None, None, "1", pick.choice("ST"))
        row["price_start_time"] = datetime(2025, 1, 1) + timedelta(days=n)
        row["price_end_time"] = pick.choice([None] + [row["price_start_time"] + timedelta(days=d) for d in (0, 3, 40, 90)] * 9)
        prices.append(row)
    valid = [p for p in prices if p["price_end_time"] is None or p["price_start_time"] < p["price_end_time"]]
    expected = sorted(
        (p["sku_name"], p["price_start_time"])
        for p in valid
        if any(
            q["sku_name"] == p["sku_name"] and q["price_start_time"] < p["price_start_time"]
            and (q["price_end_time"] is None or p["price_start_time"] < q["price_end_time"])
            for q in valid
        )
    )
    for options in ({}, {"min_weight": 1}, {"min_weight": 5, "places": 20}):
        found = values(overlapping_prices(tables(spark, prices=prices).list_prices, **options), "sku_name", "price_start_time")
        assert sorted(found) == expected


def test_overlapping_ties_and_copies(spark):
    prices = [price("01-01", "02-01")] * 3 + [price("01-01", "03-01"), price("01-01", None, sku="T"), price("03-01", "03-02")]
    prices += [price("01-05", "01-05"), price(None, "01-01"), price("01-01", "02-01", sku=None), price("01-02", "02-01", sku=None)]
    found = values(overlapping_prices(tables(spark, prices=prices).list_prices), "*")
    assert sorted(found, key=str) == sorted(
        [("S", at("01-01"), at("02-01"), 2), ("S", at("01-01"), at("03-01"), 1), (None, at("01-02"), at("02-01"), 1)], key=str
    )


def test_a_dense_sku_is_spread(spark):
    """A third of all prices in one SKU and day: no range holds more than a small part of them."""
    n = F.col("id")
    made = spark.range(90_000).select(
        F.when(n % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), (n % 997).cast("string"))).alias("sku_name"),
        F.timestamp_seconds(F.lit(1_700_000_000) + n % 86_400).alias("price_start_time"),
        F.timestamp_seconds(F.lit(1_700_000_000) + n % 86_400 + 1).alias("price_end_time"),
    )
    ranges = sampled_ranges(made, "sku_name", F.col("price_start_time"))
    largest = ranges.added_to(made, "sku_name", range=(F.col("price_start_time"), True)).groupBy("sku_name", "range").count()
    assert largest.agg(F.max("count")).first()[0] < 1_000
    assert overlapping_prices(made).agg(F.sum("n_prices")).first()[0] == 90_000 - made.distinct().count()


@BOTH_PATHS
def test_long_decimals_keep_the_engine_scale(spark, small):
    """decimal(38,18) times decimal(38,18) has six decimals; quantities keep all of theirs."""
    wide = "decimal(38,18)"
    t = tables(spark, usage=[used("c", "1"), used("c", "2")], prices=[price("01-01", None, "0.15")], small=small)
    tiny, twice = (F.lit(text).cast(wide) for text in ("0.000000123456789", "0.000000246913578"))
    usage = t.usage.withColumn("usage_quantity", F.when(F.col("usage_quantity") == 1, tiny).otherwise(twice))
    prices = t.list_prices.withColumn("pricing", F.struct(F.col("pricing.default").cast(wide).alias("default")))
    t = InputTables(t.clusters, t.node_types, t.node_timeline, usage, prices, t.lts, t.small)
    row = cluster_costs(t, CFG).first()
    assert row.total_dbus == Decimal("0.000000370370367000")
    assert row.total_cost_usd == 0 and cluster_costs(t, CFG).schema["total_cost_usd"].dataType.scale == 6


def _long_and_short(n_long, n_short):
    """Prices of one SKU over a year: long ones, begun here and there and mostly open, and short ones after one another."""
    pick, first, prices = random.Random(3), datetime(2025, 12, 1), []
    for n in range(n_long):
        row = price(None, None, f"{1 + n % 7}")
        row["price_start_time"] = first + timedelta(minutes=pick.randrange(-10_000, 365 * 1440))
        row["price_end_time"] = None if n % 3 else row["price_start_time"] + timedelta(days=300)
        prices.append(row)
    for n in range(n_short):
        row = price(None, None, "2")
        row["price_start_time"] = first + timedelta(minutes=200 * n)
        row["price_end_time"] = row["price_start_time"] + timedelta(minutes=200)
        prices.append(row)
    return prices


@pytest.mark.parametrize("n_long, n_short", [(5_000, 0), (0, 2_500), (300, 2_000), (10, 30)])
def test_ranges_repeat_each_price_once_on_average_at_most(spark, n_long, n_short):
    year = replace(CFG, lookback_days=365)
    prices = [*_long_and_short(n_long, n_short), price("01-01", None, sku="T")]
    t = tables(spark, prices=prices, small=frozenset())
    ranges = price_ranges(t.list_prices, year)
    active = active_prices(t.list_prices, year)
    spread = by_range(active, ranges)
    assert active.count() <= spread.count() <= 2 * active.count()
    per_range = spread.where("price_sku = 'S'").groupBy("price_range").count().agg(F.max("count")).first()[0]
    if n_short > 1_000:
        assert len(ranges.cuts["S"]) > 3 and per_range < active.count() / 2
    assert n_long + n_short > MIN_WEIGHT or not ranges.cuts

    pick = random.Random(4)
    usage = []
    for n in range(40):
        row = used(f"c{n}", "1", pick.choice("SST"))
        row["usage_start_time"] = pick.choice(
            [pick.choice(prices)["price_start_time"], datetime(2025, 12, 1) + timedelta(minutes=pick.randrange(365 * 1440))]
        )
        usage.append(row)
    usage[0]["usage_start_time"] = datetime(2025, 12, 1)
    made = replace(tables(spark, usage=usage, prices=prices, small=frozenset()), price_ranges=ranges)
    got = priced_usage(made, year).groupBy("cluster_id").agg(F.count(F.lit(1)), F.sum("cost_usd")).collect()
    expected = {}
    for u in usage:
        at = u["usage_start_time"]
        hits = [
            p["pricing"]["default"] for p in prices
            if p["sku_name"] == u["sku_name"] and p["price_start_time"] <= at and (p["price_end_time"] is None or at < p["price_end_time"])
        ]
        if at >= datetime(2025, 12, 1):
            expected[u["usage_metadata"]["cluster_id"]] = len(hits) or 1, sum(hits)
    assert {r[0]: (r[1], r[2]) for r in got} == expected


def test_small_ranges_against_brute_force(spark, monkeypatch):
    """Every instant as a place, every cut allowed that pays: the search in blocks and the count behind it."""
    pick = random.Random(9)
    for _ in range(3):
        rows = []
        for _ in range(400):
            start = pick.randrange(300)
            rows.append((pick.choice("ab"), start, pick.choice([None, start + pick.randrange(1, 90)])))
        at = F.col("s").cast("timestamp"), F.col("e").cast("timestamp")
        frame_ = spark.createDataFrame(rows, "k string, s long, e long")
        ranges = equal_ranges(frame_, "k", *at, min_weight=1, places=10_000)
        for key in "ab":
            starts = sorted({s for k, s, _ in rows if k == key})
            weights = []
            for before, cut in zip([None, *starts], starts, strict=False):
                since = sum(k == key and s < cut and (before is None or s >= before) for k, s, _ in rows)
                across = sum(k == key and s < cut and (e is None or cut < e) for k, s, e in rows)
                weights.append((cut * 10**6, since, across))
            assert ranges.cuts.get(key, ()) == chosen_cuts(weights, 1)
        placed = ranges.added_to(frame_, "k", first=(at[0], True), last=(at[1], False)).collect()
        for row in placed:
            cuts = [c // 10**6 for c in ranges.cuts.get(row.k, ())]
            assert row.first == sum(c <= row.s for c in cuts)
            assert row["last"] == (len(cuts) if row.e is None else sum(c < row.e for c in cuts))


def test_unmeasured_and_measured_ranges(spark, monkeypatch):
    prices = _long_and_short(0, 200)
    monkeypatch.setattr(sources, "BROADCAST_MAX_ROWS_PER_KEY", 0)
    t = tables(spark, usage=[used("c", "3")], prices=[*prices, price("01-01", None)], small=frozenset()).measured(CFG)
    assert t.small == frozenset() and t.price_ranges is not None
    assert values(cluster_costs(t, CFG), "total_cost_usd") == values(cluster_costs(replace(t, price_ranges=None), CFG), "total_cost_usd")
    assert equal_ranges(spark.createDataFrame([], "k string, s timestamp, e timestamp"), "k", F.col("s"), F.col("e")).cuts == {}


@pytest.mark.parametrize("small", [SMALL, frozenset()], ids=["broadcast", "shuffled"])
def test_exact_costs_equal_pythons_decimals(spark, small):
    wide, pick = "decimal(38,18)", random.Random(6)

    def some():
        digits = pick.choice([1, 5, 8])
        return pick.choice([1, -1]) * Decimal(pick.randrange(10**digits * 10**18)).scaleb(-18 - pick.choice([0, 3, 9])).quantize(Decimal(1).scaleb(-18))

    amounts = [(some(), some()) for _ in range(300)] + [(Decimal(0), some()), (Decimal("0.5"), Decimal("-0.000000000000000001"))]
    usage = [used(f"c{n}", "1", f"S{n}") for n in range(len(amounts))]
    prices = [price("01-01", None, "1", f"S{n}") for n in range(len(amounts))]
    t = tables(spark, usage=usage, prices=prices, small=small)
    table = spark.createDataFrame([(f"S{n}", *pair) for n, pair in enumerate(amounts)], f"sku string, q {wide}, p {wide}")
    usage_ = t.usage.join(table, F.col("sku_name") == F.col("sku")).select(*[F.col("q").alias(c) if c == "usage_quantity" else c for c in t.usage.columns])
    prices_ = t.list_prices.join(table, F.col("sku_name") == F.col("sku")).select("sku_name", "price_start_time", "price_end_time", F.struct(F.col("p").alias("default")).alias("pricing"))
    t = replace(t, usage=usage_, list_prices=prices_)
    with localcontext() as context:
        context.prec = 80
        expected = {f"c{n}": (q * p).quantize(Decimal(1).scaleb(-18), ROUND_HALF_UP) for n, (q, p) in enumerate(amounts)}
    exact = replace(CFG, exact_costs=True)
    assert dict(values(cluster_costs(t, exact), "cluster_id", "total_cost_usd")) == expected
    assert cluster_costs(t, CFG).schema["total_cost_usd"].dataType.scale == 6
    plain = tables(spark, usage=[used("c", "2.5")], prices=[price("01-01", None, "0.25")], small=small)
    assert values(cluster_costs(plain, exact), "*") == values(cluster_costs(plain, CFG), "*")
    assert AnalysisConfig.from_params({"exact_costs": "TRUE"}).exact_costs
    with pytest.raises(ValueError, match="true or false"):
        AnalysisConfig.from_params({"exact_costs": "yes"})
