from decimal import Context, Decimal

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clusterlens.operators.spend import factored, repeated, spend_by_group, weighted_sum
from clusterlens.plans.runtime import runtime_distribution
from clusterlens.plans.summary import executive_summary
from clusterlens.plans.utilization import bottleneck_summary
from tests.frames import CFG, cluster, sample, tables, used

ANSI = pytest.mark.parametrize("ansi", ["true", "false"])


@ANSI
@pytest.mark.parametrize(
    ("kind", "count", "amount"),
    [
        (T.DecimalType(38, 8), 999_999_999_999_999, "12345678.12345678"),
        (T.DecimalType(28, 4), 5_000_000_000, "-123456789.1234"),
        (T.DecimalType(38, 6), 3, "9999999999999999999.123456"),
        (T.DecimalType(38, 18), 10_000_000_000, "1234567.123456789012345678"),
        (T.DecimalType(38, 18), 9_223_372_036_854_775_807, "-0.123456789012345678"),
        (T.DecimalType(10, 0), 7, "5"),
    ],
)
def test_products_keep_their_scale(spark, settings, ansi, kind, count, amount):
    settings(spark__sql__ansi__enabled=ansi)
    rows = spark.range(2).select(F.lit(count).cast("bigint").alias("n"), F.lit(amount).cast(kind).alias("x"))
    row = rows.agg(weighted_sum(F.col("n"), F.col("x"), kind).alias("x"))
    assert row.schema["x"].dataType.scale == kind.scale
    exact = Context(prec=80)
    assert row.first().x == exact.multiply(exact.multiply(Decimal(count), Decimal(amount)), 2)


def test_products_of_doubles(spark):
    rows = spark.range(1).agg(weighted_sum(F.lit(3), F.lit(1.5), T.DoubleType()))
    assert rows.first()[0] == 4.5


def test_repeated_addition(spark):
    kind = T.DecimalType(38, 30)
    amount = F.lit("1.000000000000000000000000000001").cast(kind)
    rows = spark.range(4).select(repeated(F.col("id").cast("int"), amount, kind).alias("x")).collect()
    assert [row.x for row in rows] == [Context(prec=60).multiply(Decimal(n), Decimal("1.000000000000000000000000000001")) for n in range(4)]


def groups(spark, kind, rows=2000):
    """Hot, missing and NULL clusters."""
    n = F.col("id")
    key = F.when(n % 3 == 0, "hot").when(n % 7 == 0, None).otherwise(F.concat(F.lit("c"), (n % 40).cast("string")))
    records = spark.range(rows).select(key.alias("cluster_id"), (n % 5).alias("grade"))
    amount = (n + F.lit("0.0001").cast("decimal(5,4)")).cast(kind)
    ids = F.when(n == 0, "hot").otherwise(F.concat(F.lit("c"), n.cast("string")))
    costs = spark.range(30).select(ids.alias("cluster_id"), n.cast(kind).alias("total_dbus"), amount.alias("total_cost_usd"))
    return records, costs


@ANSI
@pytest.mark.parametrize("kind", ["decimal(38,8)", "decimal(38,18)", "decimal(38,24)", "decimal(38,30)", "double"])
def test_groups_match_a_plain_join(spark, settings, ansi, kind):
    settings(spark__sql__ansi__enabled=ansi)
    records, costs = groups(spark, kind)
    expected = (
        records.join(costs, "cluster_id", "left")
        .groupBy("grade")
        .agg(
            F.count_distinct("cluster_id").alias("cluster_count"),
            F.count("*").alias("record_count"),
            F.sum(F.coalesce("total_dbus", F.lit(0)).cast(kind)).alias("total_dbus"),
            F.sum(F.coalesce("total_cost_usd", F.lit(0)).cast(kind)).alias("total_cost_usd"),
        )
    )
    found = spend_by_group(records, ["grade"], costs)
    if kind == "double":
        found, expected = (df.withColumns({c: F.round(c, 6) for c in ("total_dbus", "total_cost_usd")}) for df in (found, expected))
    assert sorted(found.collect()) == sorted(expected.collect())


@ANSI
def test_a_hot_cluster_of_ten_million_records(spark, settings, ansi):
    settings(spark__sql__ansi__enabled=ansi)
    records = spark.range(0, 10_000_001, 1, 8).select(F.lit("hot").alias("cluster_id"), F.lit(1).alias("grade"))
    two = F.lit("2.000000000000000001").cast("decimal(38,18)")
    costs = spark.range(1).select(F.lit("hot").alias("cluster_id"), two.alias("total_dbus"), two.alias("total_cost_usd"))
    row = spend_by_group(records, ["grade"], costs).first()
    assert (row.cluster_count, row.record_count) == (1, 10_000_001)
    assert row.total_dbus == row.total_cost_usd == Decimal("20000002.000000000010000001")


@pytest.mark.parametrize("kind", ["decimal(38,18)", "decimal(38,24)"])
def test_reports_with_long_decimals(spark, kind):
    """Every report that adds up spend, against the default kind."""
    rows = [cluster("a", dbr_version="9.1.x", driver_node_type="Standard_D64ds_v5")] * 11 + [cluster("b", worker_node_type="Standard_DS3_v2")]
    t = tables(spark, clusters=rows, usage=[used("a", "5"), used("b", "7.5")], samples=[sample("a", cpu=90.0), sample("b")])
    for report in (runtime_distribution, executive_summary, bottleneck_summary):
        plain = report(t, CFG)
        costs = spark.createDataFrame([("a", Decimal(5), Decimal(5)), ("b", Decimal("7.5"), Decimal("7.5"))], "cluster_id string, total_dbus decimal(38,8), total_cost_usd decimal(38,8)")
        wide = costs.select("cluster_id", F.col("total_dbus").cast(kind).alias("total_dbus"), F.col("total_cost_usd").cast(kind).alias("total_cost_usd"))
        assert factored(wide.schema["total_dbus"].dataType) == (kind == "decimal(38,18)")
        assert [tuple(map(str, r)) for r in report(t, CFG, wide).collect()] == [tuple(map(str, r)) for r in plain.collect()]
