import threading
from dataclasses import replace
from datetime import timedelta
from decimal import Decimal
from pathlib import Path
from uuid import uuid4

import pytest
from pyspark.sql import functions as F

from clusterlens.plans.full_run import all_reports
from clusterlens.plans.runtime import outdated_runtime_detail, runtime_distribution
from clusterlens.sources import sink
from clusterlens.sources.sink import history_table, report_history, save_report, save_reports
from clusterlens.sources.tables import InputTables
from tests.frames import CFG, SMALL, cluster, sample, tables, used, values

OUT = replace(CFG, output_catalog="spark_catalog", output_schema="history")


@pytest.fixture(scope="module")
def schema(spark):
    spark.sql("CREATE DATABASE IF NOT EXISTS history")
    yield
    spark.sql("DROP DATABASE history CASCADE")


def test_history_keeps_one_snapshot_per_date(spark, schema):
    t = tables(spark, clusters=[cluster("a"), cluster("b")], usage=[used("a", "5")], samples=[sample("a", cpu=90.0)])
    later = replace(OUT, as_of=OUT.as_of + timedelta(days=1))
    for cfg in (OUT, later, OUT):
        with all_reports(t, cfg, ordered=False) as reports:
            assert spark.sql("SHOW TABLES IN history LIKE 'clusterlens_run_*'").count() == 1
            for name, report in reports.items():
                assert save_report(report, name, cfg) == f"`spark_catalog`.`history`.`{name}`"
        assert spark.sql("SHOW TABLES IN history LIKE 'clusterlens_run_*'").count() == 0
    detail = spark.table("history.outdated_runtime_detail")
    assert detail.count() == 4
    assert detail.columns[-1] == "as_of"
    assert sorted(values(detail.distinct(), "cluster_id", "as_of")) == [
        (c, d) for c in "ab" for d in (OUT.as_of, later.as_of)
    ]
    assert spark.table("history.executive_summary").count() == 8
    assert spark.table("history.executive_summary").columns == [
        "issue_category", "affected_clusters", "total_dbus", "total_cost_usd", "recommendation", "as_of"
    ]
    save_report(outdated_runtime_detail(tables(spark), later), "outdated_runtime_detail", later)
    assert values(spark.table("history.outdated_runtime_detail").distinct().orderBy("cluster_id"), "cluster_id", "as_of") == [
        ("a", OUT.as_of),
        ("b", OUT.as_of),
    ]
    with pytest.raises(ValueError, match="differ"):
        save_report(detail.drop("as_of", "owner"), "outdated_runtime_detail", OUT)


def test_needs_a_schema(spark):
    with pytest.raises(ValueError, match="output_schema"):
        save_report(spark.range(1), "x", CFG)


def test_catalog_tables(spark, schema):
    made = tables(spark, clusters=[cluster("a")], usage=[used("a", "5")])
    names = {}
    for name in ("clusters", "node_types", "node_timeline", "usage", "list_prices"):
        names[name] = f"history.{name}"
        getattr(made, name).write.saveAsTable(names[name])
    t = InputTables.from_catalog(spark, names)
    assert t.small == SMALL
    assert t.usage.schema == made.usage.schema
    with pytest.raises(ValueError, match="nonsense"):
        InputTables.from_catalog(spark, {"nonsense": "x"})


def test_other_types_are_refused(spark, schema):
    report = spark.range(1).selectExpr("CAST(1.5 AS DECIMAL(10,2)) AS `Total (USD)`")
    save_report(report, "typed", OUT)
    save_report(report, "typed", OUT)
    with pytest.raises(ValueError, match="differ"):
        save_report(report.selectExpr("CAST(`Total (USD)` AS DECIMAL(12,2)) AS `Total (USD)`"), "typed", OUT)
    assert values(spark.table("history.typed"), "total_usd") == [(Decimal("1.50"),)]


def test_frames_are_measured(spark):
    made = tables(spark)
    names = ("clusters", "node_types", "node_timeline", "usage", "list_prices")
    t = InputTables.from_frames(**{name: getattr(made, name) for name in names})
    assert t.small == SMALL and t.lts.count() == 6


def test_the_table_of_a_failed_run_is_dropped(spark, schema):
    with pytest.raises(RuntimeError), all_reports(tables(spark, clusters=[cluster("a")]), OUT):
        raise RuntimeError
    assert spark.sql("SHOW TABLES IN history LIKE 'clusterlens_run_*'").count() == 0


def test_a_failed_save_leaves_the_date_as_it_was(spark, schema, monkeypatch):
    def saved():
        return values(spark.table("history.swapped").orderBy("id"), "id", "as_of")

    save_report(spark.range(3), "swapped", OUT)
    before = saved()
    assert before == [(n, OUT.as_of) for n in range(3)]
    wrong = spark.range(4).select(F.when(F.col("id") < 3, F.col("id")).otherwise(F.raise_error(F.lit("broken"))).cast("bigint").alias("id"))
    with pytest.raises(Exception, match="broken"):
        save_report(wrong, "swapped", OUT)
    assert saved() == before

    monkeypatch.setattr(sink, "_sums", lambda columns: [F.lit(uuid4().hex).alias("n_rows"), F.count(F.lit(1)).alias("checksum")])
    with pytest.raises(RuntimeError, match="was written"):
        save_report(spark.range(4), "swapped", OUT)
    assert saved() == before
    monkeypatch.undo()

    reader = spark.table("history.swapped")
    for rows in (5, 6, 7):
        save_report(spark.range(rows), "swapped", OUT)
        later = replace(OUT, as_of=OUT.as_of + timedelta(days=1))
        save_report(spark.range(1), "swapped", later)
    assert report_history(spark, "swapped", OUT).groupBy("as_of").count().orderBy("as_of").collect() == [(OUT.as_of, 7), (later.as_of, 1)]
    assert reader.schema == spark.table("history.swapped").schema
    [location] = [r.data_type for r in spark.sql("DESCRIBE TABLE EXTENDED history.swapped").collect() if r.col_name == "Location"]
    runs = sorted(p.name[:10] for p in Path(location.removeprefix("file:"), "_runs").iterdir())
    assert runs == [str(OUT.as_of)] * 2 + [str(later.as_of)] * 2
    save_report(spark.range(0), "swapped", OUT)
    assert saved() == [(0, later.as_of)]


def test_reports_are_saved_at_the_same_time(spark, schema, monkeypatch):
    meeting = threading.Barrier(3)

    def met(report, name, cfg):
        meeting.wait(60)
        return save_report(report, name, cfg)

    monkeypatch.setattr(sink, "save_report", met)
    t = tables(spark, clusters=[cluster("a"), cluster("b")])
    reports = {name: runtime_distribution(t, OUT).where("cluster_count = 2").withColumn("n", F.lit(n)) for n, name in enumerate("xyz")}
    assert save_reports(reports, OUT) == [history_table(name, OUT) for name in "xyz"]
    assert [[row.n for row in report_history(spark, name, OUT).collect()] for name in "xyz"] == [[0], [1], [2]]
    assert save_reports({}, OUT) == []


def test_others_are_saved_if_one_report_fails(spark, schema):
    good = runtime_distribution(tables(spark, clusters=[cluster("a")]), OUT)
    bad = good.withColumn("status", F.raise_error(F.lit("broken")).cast("string"))
    with pytest.raises(Exception, match="broken"):
        save_reports({"bad": bad, "good": good}, OUT, at_once=1)
    assert report_history(spark, "good", OUT).count() == 1


def test_a_new_table_is_made_by_one_empty_task(spark, schema, monkeypatch):
    monkeypatch.setattr(sink, "_swap_in", lambda *_: None)
    report, tracker = runtime_distribution(tables(spark, clusters=[cluster("a")]), OUT), spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("new-table", "")
    save_report(report, "made", OUT)
    spark.sparkContext._jsc.clearJobGroup()
    stages = [stage for job in tracker.getJobIdsForGroup("new-table") for stage in tracker.getJobInfo(job).stageIds]
    assert sum(tracker.getStageInfo(stage).numTasks for stage in stages) <= 1
    assert spark.table("history.made").columns == [*report.columns, "as_of"]
