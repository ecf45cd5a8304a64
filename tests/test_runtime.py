from dataclasses import replace
from datetime import date, timedelta
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from clusterlens.functions.runtime import runtime_family, runtime_type, support_status
from clusterlens.operators.support import lts_schedule_status
from clusterlens.plans.runtime import outdated_runtime_detail, runtime_distribution
from clusterlens.sources.tables import lts_support
from tests.frames import CFG, at, cluster, price, tables, used, values

END_OF_15_4 = date(2027, 8, 19)


def days_left(days):
    """A configuration under which version 15.4 has that many days left."""
    return replace(CFG, as_of=END_OF_15_4 - timedelta(days=days))


@pytest.mark.parametrize(
    ("days", "detailed", "short"),
    [
        (-1, "⛔ EXPIRED", "⛔ EXPIRED"),
        (0, "🔴 CRITICAL (<6 months)", "🔴 CRITICAL"),
        (179, "🔴 CRITICAL (<6 months)", "🔴 CRITICAL"),
        (180, "🟠 WARNING (<1 year)", "🟠 WARNING"),
        (364, "🟠 WARNING (<1 year)", "🟠 WARNING"),
        (365, "🟢 SUPPORTED", "🟢 SUPPORTED"),
        (366, "🟢 SUPPORTED", "🟢 SUPPORTED"),
        (None, "🟢 SUPPORTED", "🟢 SUPPORTED"),
    ],
)
def test_status_boundaries(spark, days, detailed, short):
    row = spark.range(1).select(
        support_status(F.lit("15.4"), F.lit(days).cast("int"), detailed=True).alias("detailed"),
        support_status(F.lit("15.4"), F.lit(days).cast("int"), detailed=False).alias("short"),
        support_status(F.lit(None).cast("string"), F.lit(days).cast("int"), detailed=True).alias("non_lts"),
    )
    assert tuple(row.first()) == (detailed, short, "🔴 CRITICAL (Non-LTS)")


@pytest.mark.parametrize(("days", "status"), [(-1, "⛔ EXPIRED"), (179, "🔴 CRITICAL"), (180, "🟠 WARNING"), (365, "🟢 SUPPORTED")])
def test_schedule_status(spark, days, status):
    rows = lts_schedule_status(lts_support(spark), days_left(days)).where("lts_version = '15.4'")
    assert values(rows, "days_left", "status", "end_of_support") == [(days, status, END_OF_15_4)]


def test_schedule(spark):
    rows = lts_support(spark).collect()
    assert [(r.lts_version, str(r.release_date), str(r.end_of_support), r.spark_version) for r in rows] == [
        ("17.3", "2025-10-22", "2028-10-22", "4.0.0"),
        ("16.4", "2025-05-09", "2028-05-09", "3.5.2"),
        ("15.4", "2024-08-19", "2027-08-19", "3.5.0"),
        ("14.3", "2024-02-01", "2027-02-01", "3.5.0"),
        ("13.3", "2023-08-22", "2026-08-22", "3.4.1"),
        ("12.2", "2023-03-01", "2026-03-01", "3.3.2"),
    ]


def test_family_and_type(spark):
    rows = [
        ("15.4.x-scala2.12", "15.4", "📊 Standard Runtime"),
        ("14.3.x-gpu-ML-scala2.12", "14.3", "🤖 ML Runtime"),
        ("14.3.x-GPU", "14.3", "🎮 GPU Runtime"),
        ("custom-2024", "", "📊 Standard Runtime"),
        ("html-5", "", "🤖 ML Runtime"),
        (None, None, "📊 Standard Runtime"),
    ]
    df = spark.createDataFrame([(v,) for v, *_ in rows], "v string")
    assert values(df.select("v", runtime_family(F.col("v")), runtime_type(F.col("v"))), "*") == rows


def test_detail(spark):
    t = tables(
        spark,
        clusters=[
            cluster("supported"),
            cluster("non-lts", dbr_version="15.1.x"),
            cluster("expired", dbr_version="12.2.x"),
            cluster("non-lts-used", dbr_version=None),
            cluster("twice", dbr_version="14.3.x"),
            cluster("twice", dbr_version="14.3.x", change_time=at("11-25")),
        ],
        usage=[used("non-lts-used", "2.005"), used("twice", "3"), used("gone", "9")],
        prices=[price("01-01", None, "0.5")],
    )
    rows = values(
        outdated_runtime_detail(t, CFG),
        "cluster_id", "dbr_family", "version_type", "end_of_support_date", "days_until_eos", "support_status", "total_dbus", "total_cost_usd",
    )
    zero = Decimal(0)
    assert rows == [
        ("expired", "12.2", "LTS", "2026-03-01", -275, "⛔ EXPIRED", zero, zero),
        ("non-lts-used", None, "Non-LTS", None, None, "🔴 CRITICAL (Non-LTS)", Decimal("2.01"), Decimal("1.00")),
        ("non-lts", "15.1", "Non-LTS", None, None, "🔴 CRITICAL (Non-LTS)", zero, zero),
        ("twice", "14.3", "LTS", "2027-02-01", 62, "🔴 CRITICAL (<6 months)", Decimal(3), Decimal("1.5")),
        ("twice", "14.3", "LTS", "2027-02-01", 62, "🔴 CRITICAL (<6 months)", Decimal(3), Decimal("1.5")),
        ("supported", "17.3", "LTS", "2028-10-22", 691, "🟢 SUPPORTED", zero, zero),
    ]
    assert outdated_runtime_detail(t, CFG, only_outdated=True).where("cluster_id = 'supported'").count() == 0
    assert outdated_runtime_detail(t, CFG, only_outdated=True).count() == 5
    assert outdated_runtime_detail(t, CFG, latest_only=True, ordered=False).count() == 5


def test_usage_without_cost_sorts_before_no_usage(spark):
    t = tables(spark, clusters=[cluster("a-unused"), cluster("b-free")], usage=[used("b-free", sku="unpriced")])
    assert values(outdated_runtime_detail(t, CFG), "cluster_id") == [("b-free",), ("a-unused",)]


def test_distribution_counts_clusters_once_and_cost_per_record(spark):
    t = tables(
        spark,
        clusters=[
            cluster("a"),
            cluster("a", change_time=at("11-25")),
            cluster("b"),
            cluster(None),
            cluster("a", dbr_version="custom"),
            cluster("c", dbr_version=None),
        ],
        usage=[used("a", "10"), used("b", "5")],
    )
    rows = values(
        runtime_distribution(t, CFG),
        "dbr_version", "end_of_support_date", "days_remaining", "status", "cluster_count", "total_dbus", "total_cost_usd", "pct_of_total_cost",
    )
    no_lts = ("Non-LTS (Short Support)", 0, "🔴 CRITICAL (Non-LTS)", 1)
    assert rows == [
        (None, *no_lts, Decimal(0), Decimal(0), Decimal(0)),
        ("DBR ", *no_lts, Decimal(10), Decimal(10), Decimal("28.57")),
        ("DBR 17.3", "2028-10-22", 691, "🟢 SUPPORTED", 2, Decimal(25), Decimal(25), Decimal("71.43")),
    ]


def test_no_cost_at_all_has_no_share(spark):
    t = tables(spark, clusters=[cluster()])
    assert values(runtime_distribution(t, CFG), "total_cost_usd", "pct_of_total_cost") == [(Decimal(0), None)]
