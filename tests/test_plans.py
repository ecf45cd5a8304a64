"""What the optimizer makes of the reports over parquet tables."""

import contextlib
import io
import re

import pytest
from pyspark.sql import functions as F

from clusterlens import schemas
from clusterlens.operators.joins import splittable_join
from clusterlens.operators.pricing import cluster_costs, priced_usage
from clusterlens.operators.telemetry import worker_utilization
from clusterlens.plans.full_run import COST_REPORTS, UTILIZATION_REPORTS, all_reports
from clusterlens.plans.summary import executive_summary
from clusterlens.sources.tables import InputTables, lts_support
from tests.frames import CFG, SMALL, cluster, price, sample, tables, used

REPORTS = {**COST_REPORTS, **UTILIZATION_REPORTS, "executive_summary": executive_summary}


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("tables")
    made = tables(spark, clusters=[cluster()], usage=[used("c-1")], samples=[sample()])
    names = ["clusters", "node_types", "node_timeline", "usage", "list_prices"]
    for name in names:
        getattr(made, name).write.parquet(str(folder / name))
    frames = {name: spark.read.parquet(str(folder / name)) for name in names}
    return InputTables(**frames, lts=lts_support(spark)).measured()


def plan(df, mode="formatted"):
    text = io.StringIO()
    with contextlib.redirect_stdout(text):
        df.explain(mode)
    return text.getvalue()


def scans(df):
    """Pushed filters and read schema of each file scan, by table."""
    found = {}
    for block in re.split(r"\n\n+", plan(df)):
        if "Location:" in block:
            table = re.search(r"Location: .*/(\w+)\]", block).group(1)
            filters = re.search(r"PushedFilters: \[(.*)\]", block)
            found.setdefault(table, []).append((filters.group(1) if filters else "", re.search(r"ReadSchema: (.*)", block).group(1)))
    return found


@pytest.mark.parametrize("name", REPORTS)
def test_reports_use_built_in_operators_only(stored, name):
    text = plan(REPORTS[name](stored, CFG))
    for bad in ("Python", "ArrowEval", "CartesianProduct", "BroadcastNestedLoopJoin", "ExistingRDD"):
        assert bad not in text
    assert max(len(found) for found in scans(REPORTS[name](stored, CFG)).values()) <= 2


def test_the_summary_reads_each_large_table_once(stored):
    assert {table: len(found) for table, found in scans(executive_summary(stored, CFG)).items()} == {
        "clusters": 1,
        "usage": 1,
        "list_prices": 1,
        "node_types": 1,
    }


def test_usage_filters_and_columns_reach_the_scan(stored):
    [(filters, columns)] = scans(cluster_costs(stored, CFG))["usage"]
    assert "GreaterThanOrEqual(usage_start_time,2026-11-01" in filters
    assert "IsNotNull(usage_metadata.cluster_id)" in filters
    assert columns.count(":") == 5  # three columns, and the struct with its one field
    assert len(re.findall("Exchange hashpartitioning", plan(cluster_costs(stored, CFG), "simple"))) == 1


def test_cluster_filters_reach_the_scan(stored):
    [(filters, columns)] = scans(REPORTS["vm_distribution"](stored, CFG))["clusters"]
    assert "GreaterThanOrEqual(change_time,2026-11-01" in filters and "IsNull(delete_time)" in filters
    assert "account_id" not in columns and "dbr_version" not in columns


def test_telemetry_filters_and_columns_reach_the_scan(stored):
    io_only = worker_utilization(stored.node_timeline, CFG).select("cluster_id", "avg_io_wait_percent")
    [(filters, columns)] = scans(io_only)["node_timeline"]
    assert "GreaterThanOrEqual(start_time,2026-11-01" in filters and "Not(EqualTo(driver,true))" in filters
    assert "cpu_wait_percent" in columns and "mem_used_percent" not in columns and "cpu_user_percent" not in columns
    assert len(re.findall("Exchange hashpartitioning", plan(io_only, "simple"))) == 1


def test_telemetry_is_shuffled_once_also_for_days(stored, settings):
    settings(spark__sql__autoBroadcastJoinThreshold="-1", spark__sql__adaptive__enabled="false")
    for t, aggregate in ((stored, "ObjectHashAggregate"), (stored.measured(CFG), "HashAggregate")):
        text = plan(REPORTS["high_cpu_clusters"](t, CFG, ordered=False), "simple").splitlines()
        [scan] = [n for n, line in enumerate(text) if "cpu_user_percent" in line and "FileScan" in line]
        join = max(n for n in range(scan) if "Join" in text[n])
        above = "\n".join(text[join:scan])
        assert above.count("Exchange") == 1 and "SortAggregate" not in above
        assert len(re.findall(rf"\b{aggregate}\(", above)) == 2 and "days_active" in above


def test_measured_prices_are_broadcast_and_others_are_not(stored, settings):
    settings(spark__sql__autoBroadcastJoinThreshold="-1")
    assert stored.small == SMALL
    assert "BroadcastHashJoin" in plan(priced_usage(stored, CFG), "simple")
    unmeasured = InputTables(
        stored.clusters, stored.node_types, stored.node_timeline, stored.usage, stored.list_prices, stored.lts
    )
    text = plan(priced_usage(unmeasured, CFG), "simple")
    assert "Broadcast" not in text
    assert re.search(r"hashpartitioning\(sku_name\S*, \d+\)", text)


def force_skew_handling(settings):
    settings(
        spark__sql__autoBroadcastJoinThreshold="-1",
        spark__sql__adaptive__autoBroadcastJoinThreshold="-1",
        spark__sql__adaptive__skewJoin__skewedPartitionThresholdInBytes="32k",
        spark__sql__adaptive__skewJoin__skewedPartitionFactor="2",
        spark__sql__adaptive__advisoryPartitionSizeInBytes="32k",
    )


def hot(spark, rows, others):
    """One key with a third of the rows."""
    number = F.col("id")
    key = F.when(number % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), (number % others).cast("string")))
    return spark.range(0, rows, 1, 8).select(key.alias("key"), number, F.sha2(number.cast("string"), 256).alias("text"))


@pytest.mark.parametrize("how", ["left", "inner"])
def test_a_hot_cluster_is_split(spark, settings, how):
    force_skew_handling(settings)
    rows = hot(spark, 120_000, 500)
    per_key = rows.where("id % 2 = 0").groupBy("key").agg(F.sum("id").alias("total"))
    joined = splittable_join(rows, per_key, "key", how)
    assert joined.columns == ["key", "id", "text", "total"]
    assert joined.agg(F.count("text"), F.sum("total")).count() == 1
    joined.collect()
    assert "skew=true" in plan(joined, "simple")
    plain = rows.join(per_key, "key", how)
    assert joined.exceptAll(plain).isEmpty() and plain.exceptAll(joined).isEmpty()


def test_a_hot_sku_is_split(spark, settings):
    """All its usage on one day, and too many prices to be broadcast."""
    force_skew_handling(settings)
    usage = hot(spark, 120_000, 40).select(
        F.col("key").alias("sku_name"),
        F.lit("2026-11-20").cast("timestamp").alias("usage_start_time"),
        F.lit("1.5").cast("decimal(18,4)").alias("usage_quantity"),
        F.struct(F.col("text").alias("cluster_id")).alias("usage_metadata"),
    )
    t = tables(spark, prices=[price("01-01", None, "2", "hot"), price("01-01", "11-20", "9", "k1")], small=frozenset())
    t = InputTables(t.clusters, t.node_types, t.node_timeline, usage, t.list_prices, t.lts)
    assert usage.schema == schemas.USAGE or [f.dataType for f in usage.schema] == [f.dataType for f in schemas.USAGE]
    priced = priced_usage(t, CFG)
    assert len(priced.collect()) == 120_000
    assert "skew=true" in plan(priced, "simple")
    assert priced.agg(F.sum("cost_usd")).first()[0] == 40_000 * 3


def test_shared_aggregates_keep_their_partitioning(stored, settings):
    """In the full run no report shuffles the shared table by cluster again, and none reads all of its columns."""
    settings(spark__sql__autoBroadcastJoinThreshold="-1", spark__sql__adaptive__enabled="false")
    with all_reports(stored, CFG) as reports:
        for name, report in reports.items():
            text = plan(report, "simple")
            assert "ExistingRDD" not in text and "Python" not in text
            shared = [(n, line) for n, line in enumerate(text.splitlines()) if "clusterlens_run_" in line]
            assert shared, name
            for n, line in shared:
                above = text.splitlines()[:n]
                depth = len(re.match(r"[ :+-]*", line).group(0))
                for upper in reversed(above):
                    upper_depth = len(re.match(r"[ :+-]*", upper).group(0))
                    if upper_depth < depth:
                        depth = upper_depth
                        assert not re.search(r"Exchange hashpartitioning\(cluster_id#\d+, \d+\)", upper), (name, text)
                        if "Join" in upper:
                            break
                assert line.count(":") < 20
        assert "total_dbus" not in scans_of_shared(reports["bottleneck_summary"])
        assert "max_cpu_percent" not in scans_of_shared(reports["bottleneck_summary"])


def test_the_shared_table_is_not_broadcast_by_the_size_of_its_files(stored, settings):
    settings(spark__sql__autoBroadcastJoinThreshold="1g", spark__sql__adaptive__enabled="false")
    with all_reports(stored, CFG) as reports:
        for name, report in reports.items():
            lines = plan(report, "simple").splitlines()
            for n, line in enumerate(lines):
                if "clusterlens_run_" in line:
                    depth = len(re.match(r"[ :+-]*", line).group(0))
                    for upper in reversed(lines[:n]):
                        upper_depth = len(re.match(r"[ :+-]*", upper).group(0))
                        if upper_depth < depth:
                            depth = upper_depth
                            assert "BroadcastExchange" not in upper, (name, "\n".join(lines))
                            if "Join" in upper:
                                break


def scans_of_shared(df):
    blocks = [b for b in re.split(r"\n\n+", plan(df)) if "clusterlens_run_" in b and "ReadSchema" in b]
    return " ".join(re.search(r"ReadSchema: (.*)", b).group(1) for b in blocks)


def test_many_prices_of_one_sku_move_no_usage(spark, settings):
    settings(spark__sql__autoBroadcastJoinThreshold="-1", spark__sql__adaptive__autoBroadcastJoinThreshold="-1")
    from datetime import datetime, timedelta

    prices = []
    for n in range(5_000):
        row = price(None, None, "2")
        row["price_start_time"] = datetime(2026, 11, 1) + timedelta(minutes=8 * n)
        row["price_end_time"] = row["price_start_time"] + timedelta(minutes=8)
        prices.append(row)
    t = tables(spark, usage=[used("c", "3"), used("c", "4", begun="11-02")], prices=prices, small=frozenset()).measured(CFG)
    assert t.small == {"node_types", "daily_prices"}
    priced = priced_usage(t, CFG)
    assert "Exchange hashpartitioning" not in plan(priced, "simple")
    assert priced.agg(F.sum("cost_usd")).first()[0] == 14


@pytest.mark.parametrize("together", ["true", "false"])
def test_hot_keys_are_split_whatever_the_option(spark, settings, together):
    force_skew_handling(settings)
    settings(spark__sql__requireAllClusterKeysForCoPartition=together)
    rows = hot(spark, 120_000, 500)
    joined = splittable_join(rows, rows.groupBy("key").agg(F.sum("id").alias("total")), "key", "left")
    joined.collect()
    assert "skew=true" in plan(joined, "simple")
    t = tables(spark)
    version = F.when(F.col("id") % 3 == 0, "14.3.x").otherwise(F.concat(F.col("key"), F.lit(".1.x")))
    made = rows.select(F.col("text").alias("cluster_id"), version.alias("dbr_version"), F.lit("2026-11-20").cast("timestamp").alias("change_time"))
    clusters = made.select([F.col(f.name) if f.name in made.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in schemas.CLUSTERS])
    report = executive_summary(InputTables(clusters, t.node_types, t.node_timeline, t.usage, t.list_prices, t.lts), CFG)
    report.collect()
    assert "skew=true" in plan(report, "simple")
