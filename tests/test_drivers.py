from dataclasses import replace
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from clusterlens.functions.drivers import driver_recommendation, oversized_driver, sizing_status
from clusterlens.plans.drivers import driver_sizing_summary, oversized_driver_detail
from tests.frames import CFG, cluster, tables, used, values

NODES = [
    ("limit", 16.0, 65536),
    ("cores", 17.0, 1024),
    ("memory", 16.0, 65537),
    ("both", 40.0, 131072),
    ("huge", 33.0, 1024),
]


def test_limits_are_strict_and_memory_is_not_rounded(spark):
    df = spark.createDataFrame(NODES, "node string, cores double, mb long")
    cores, mb = F.col("cores"), F.col("mb")
    rows = df.select("node", oversized_driver(cores, mb, CFG), sizing_status(cores, mb, CFG), driver_recommendation(cores))
    e8, e4 = "Consider Standard_E8ds_v5 (8 vCPU, 64GB)", "Consider Standard_E4ds_v5 (4 vCPU, 32GB)"
    review = "Review workload requirements"
    assert values(rows, "*") == [
        ("limit", False, "🟢 Appropriately Sized", review),
        ("cores", True, "🔴 vCPUs Too High", e4),
        ("memory", True, "🟠 Memory Too High", review),
        ("both", True, "🔴 vCPUs Too High", e8),
        ("huge", True, "🔴 vCPUs Too High", e8),
    ]


@pytest.mark.parametrize("small", [frozenset({"list_prices", "node_types"}), frozenset()], ids=["broadcast", "shuffled"])
def test_reports(spark, small):
    t = tables(
        spark,
        clusters=[
            cluster("a", driver_node_type="both"),
            cluster("a", driver_node_type="both"),
            cluster("b", driver_node_type="memory"),
            cluster("c", driver_node_type="limit"),
            cluster("d", driver_node_type="unknown"),
            cluster("e", driver_node_type="cores"),
            cluster("f", driver_node_type="huge"),
        ],
        usage=[used("a", "5"), used("b", "30"), used("c", "100")],
        nodes=NODES,
        small=small,
    )
    assert values(oversized_driver_detail(t, CFG), "cluster_id", "driver_vcpus", "driver_memory_gb", "total_cost_usd") == [
        ("b", 16.0, 64.0, Decimal(30)),
        ("a", 40.0, 128.0, Decimal(5)),
        ("a", 40.0, 128.0, Decimal(5)),
        ("f", 33.0, 1.0, Decimal(0)),
        ("e", 17.0, 1.0, Decimal(0)),
    ]
    rows = values(driver_sizing_summary(t, CFG), "driver_node_type", "cluster_count", "total_dbus", "total_cost_usd", "pct_of_total_cost")
    zero = Decimal(0)
    assert rows == [
        ("memory", 1, Decimal(30), Decimal(30), Decimal(75)),
        ("both", 1, Decimal(10), Decimal(10), Decimal(25)),
        ("cores", 1, zero, zero, zero),
        ("huge", 1, zero, zero, zero),
    ]
    strict = replace(CFG, driver_cpu_threshold=8, driver_memory_gb_threshold=32)
    assert oversized_driver_detail(t, strict).count() == 6


def test_a_type_listed_twice_counts_its_clusters_once(spark):
    nodes = [("twin", 64.0, 1024), ("twin", 64.0, 1024), ("twin", 64.0, 2048)]
    t = tables(spark, clusters=[cluster("a", driver_node_type="twin")], usage=[used("a", "3")], nodes=nodes)
    assert values(driver_sizing_summary(t, CFG), "driver_memory_gb", "cluster_count", "total_cost_usd") == [
        (1.0, 1, Decimal(6)),
        (2.0, 1, Decimal(3)),
    ]
