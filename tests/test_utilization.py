import random
from dataclasses import replace
from datetime import datetime, timedelta
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from clusterlens.functions.utilization import cpu_recommendation, io_recommendation, memory_recommendation
from clusterlens.operators.telemetry import first_later_day, no_samples_from, utilization_of, worker_utilization
from clusterlens.plans.utilization import bottleneck_summary, high_cpu_clusters, high_io_wait_clusters, high_memory_clusters
from tests.frames import CFG, at, cluster, sample, tables, used, values


def test_roll_up_of_workers_in_the_window(spark):
    samples = [
        sample(cpu=10.0, system=5.0, io=1.0, mem=20.0, swap=1.0, start_time=at("11-01")),
        sample(cpu=20.0, system=6.0, io=2.0, mem=40.0, swap=3.0, start_time=at("11-01 23:59")),
        sample(cpu=None, system=50.0, start_time=at("11-03"), io=None, mem=None, swap=None),
        sample(cpu=99.0, driver=True),
        sample(cpu=99.0, driver=None),
        sample(cpu=99.0, start_time=at("10-31 23:59")),
        sample(None, cpu=99.0),
    ]
    rows = values(worker_utilization(tables(spark, samples=samples).node_timeline, CFG), "*")
    assert rows == [("c-1", 20.5, 26.0, 1.5, 2.0, 30.0, 40.0, 2.0, 3.0, 2)]


def averages(spark, metric, numbers):
    """One cluster per number, with that average of one metric."""
    ids = [f"c{n}" for n in numbers]
    return tables(
        spark, clusters=[cluster(i) for i in ids], samples=[sample(i, **{metric: n}) for i, n in zip(ids, numbers, strict=True)]
    )


def found(report, t):
    return sorted(r[0] for r in values(report(t, CFG), "cluster_id"))


def test_cpu_is_compared_rounded_in_the_detail_and_unrounded_in_the_summary(spark):
    t = averages(spark, "cpu", [69.994, 69.996, 70.0])
    assert found(high_cpu_clusters, t) == ["c69.996", "c70.0"]
    assert dict(values(bottleneck_summary(t, CFG), "bottleneck_type", "cluster_count")) == {
        "CPU-bound": 1,
        "Balanced/Underutilized": 2,
    }


def test_io_and_memory_are_compared_unrounded(spark):
    assert found(high_io_wait_clusters, averages(spark, "io", [9.996, 10.0, 20.0])) == ["c10.0", "c20.0"]
    assert found(high_memory_clusters, averages(spark, "mem", [79.996, 80.0])) == ["c80.0"]
    assert found(high_memory_clusters, averages(spark, "swap", [0.996, 1.0])) == ["c1.0"]


def test_recommendations(spark):
    df = spark.createDataFrame(
        [("15.4", 70.0), ("15.4", 69.0), ("15.4-ml", 70.0), ("15.4-ML", 69.0), (None, 70.0), ("x", None)], "v string, x double"
    )
    assert [r[0] for r in values(df.select(cpu_recommendation(F.col("v"), F.col("x"), CFG)), "*")] == [
        "🔴 CPU-bound - Photon, larger nodes, more workers",
        "🟢 Below threshold - Not CPU-bound",
        "🟠 ML Runtime - Photon helps Spark SQL/feature eng; or compute-optimized",
        "🟡 ML Runtime - Evaluate if using Spark SQL/DataFrames",
        "🔴 CPU-bound - Photon, larger nodes, more workers",
        "🟢 Below threshold - Not CPU-bound",
    ]
    io = spark.createDataFrame([(9.9,), (10.0,), (19.99,), (20.0,)], "x double")
    moderate = "🟡 MODERATE - Consider Liquid Clustering for file pruning"
    bound = "🟠 I/O-bound - Delta Cache, Liquid Clustering"
    high = "🔴 HIGH - Delta Cache + Liquid Clustering for file pruning"
    assert [r[0] for r in values(io.select(io_recommendation(F.col("x"), CFG)), "*")] == [moderate, bound, bound, high]
    memory = spark.createDataFrame([(80.0, 1.0), (80.0, 0.0), (79.0, 0.0)], "m double, s double")
    assert [r[0] for r in values(memory.select(memory_recommendation(F.col("m"), F.col("s"), CFG)), "*")] == [
        "🔴 SWAPPING - larger nodes, more workers",
        "🟠 Memory-bound - larger nodes, more workers",
        "🟡 MODERATE - Monitor for memory pressure",
    ]


def test_details_overlap_and_the_summary_does_not(spark):
    t = tables(
        spark,
        clusters=[
            cluster("all"),
            cluster("all", change_time=at("11-25")),
            cluster("io"),
            cluster("idle"),
            cluster("silent"),
            cluster(None),
        ],
        samples=[
            sample("all", cpu=90.0, io=30.0, mem=90.0, swap=5.0),
            sample("io", io=10.0, cpu=80.0),
            sample("idle"),
            sample("gone", cpu=99.0),
            sample(None, cpu=99.0),
        ],
        usage=[used("all", "10"), used("idle", "20"), used("silent", "7")],
    )
    assert found(high_cpu_clusters, t) == ["all", "all", "io"]
    assert found(high_io_wait_clusters, t) == ["all", "all", "io"]
    assert found(high_memory_clusters, t) == ["all", "all"]
    assert values(bottleneck_summary(t, CFG), "bottleneck_type", "recommendation", "cluster_count", "total_cost_usd", "pct_of_total_cost") == [
        ("Balanced/Underutilized", "✅ No immediate action needed", 1, Decimal(20), Decimal(50)),
        ("Memory-bound", "🧠 Memory-optimized , larger nodes, or more workers", 2, Decimal(20), Decimal(50)),
        ("I/O-bound", "💾 Delta Cache, Liquid Clustering for file pruning, storage-optimized", 1, Decimal(0), Decimal(0)),
    ]
    assert values(high_cpu_clusters(t, CFG), "cluster_id", "runtime_type", "avg_cpu_percent", "days_active", "total_cost_usd") == [
        ("all", "📊 Standard Runtime", 90.0, 1, Decimal(10)),
        ("all", "📊 Standard Runtime", 90.0, 1, Decimal(10)),
        ("io", "📊 Standard Runtime", 80.0, 1, Decimal(0)),
    ]
    assert bottleneck_summary(t, CFG, latest_only=True).where("bottleneck_type = 'Memory-bound'").first().cluster_count == 1


@pytest.mark.parametrize(("option", "value"), [("cpu_threshold", 95), ("cpu_threshold", 50)])
def test_thresholds(spark, option, value):
    t = averages(spark, "cpu", [60.0, 90.0])
    assert high_cpu_clusters(t, replace(CFG, **{option: value})).count() == (0 if value == 95 else 2)


def test_shares_without_any_cost(spark):
    assert values(bottleneck_summary(averages(spark, "cpu", [1.0]), CFG), "pct_of_total_cost") == [(None,)]


def test_days_are_counted_as_a_set_in_one_shuffle(spark):
    """Days over several words, their edges, and days after the window, against a plain count."""
    long = replace(CFG, lookback_days=200)
    first = datetime.combine(long.window_start, datetime.min.time())
    pick = random.Random(5)
    days = [0, 62, 63, 125, 126, 188, 189, 200, 251, 252, 400] + [pick.randrange(0, 300) for _ in range(60)]
    samples = [sample(pick.choice("ab"), start_time=first + timedelta(days=d, hours=pick.randrange(24))) for d in days]
    samples += [sample("none", start_time=first - timedelta(hours=1)), sample("driver", driver=True)]
    timeline = tables(spark, samples=samples).node_timeline
    expected = {}
    for row in samples[:-2]:
        expected.setdefault(row["cluster_id"], set()).add(row["start_time"].date())
    stats = worker_utilization(timeline, long)
    assert dict(values(stats, "cluster_id", "days_active")) == {c: len(d) for c, d in expected.items()}
    assert not no_samples_from(timeline, first_later_day(long))
    early = timeline.where(F.col("start_time") < F.lit(first_later_day(long)))
    assert no_samples_from(early, first_later_day(long))
    known = worker_utilization(early, long, last_known=True)
    assert sorted(values(known, "*")) == sorted(values(worker_utilization(early, long), "*"))
    assert first_later_day(long) == long.window_start + timedelta(days=252)


def test_measured_tables_know_their_last_samples(spark):
    t = tables(spark, samples=[sample()])
    assert t.no_samples_from is None and t.measured().no_samples_from is None
    assert t.measured(CFG).no_samples_from == first_later_day(CFG)
    late = tables(spark, samples=[sample(start_time=datetime(2028, 1, 1))])
    assert late.measured(CFG).no_samples_from is None
    assert values(utilization_of(late.measured(CFG), CFG), "days_active") == [(1,)]
