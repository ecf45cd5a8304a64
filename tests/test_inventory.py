from dataclasses import replace

from clusterlens.operators.inventory import live_clusters, workspace_ids
from tests.frames import CFG, at, cluster, tables, values


def live(spark, rows, cfg=CFG, **options):
    t = tables(spark, clusters=rows)
    return sorted(values(live_clusters(t.clusters, cfg, **options), "cluster_id", "change_time"))


def test_window_starts_at_midnight_and_is_inclusive(spark):
    rows = [
        cluster("before", change_time=at("10-31 23:59")),
        cluster("start", change_time=at("11-01")),
        cluster("later", change_time=at("12-05")),
    ]
    assert [c for c, _ in live(spark, rows)] == ["later", "start"]


def test_deleted_and_other_workspaces(spark):
    rows = [
        cluster("deleted", delete_time=at("11-30")),
        cluster("other", workspace_id="ws-2"),
        cluster("none", workspace_id=None),
        cluster("mine"),
    ]
    assert [c for c, _ in live(spark, rows)] == ["mine", "none", "other"]
    assert [c for c, _ in live(spark, rows, replace(CFG, workspace_filter="ws-1"))] == ["mine"]
    assert live(spark, rows, replace(CFG, workspace_filter="ws' OR '1'='1")) == []


def test_change_records_are_kept_unless_only_the_latest_is_wanted(spark):
    rows = [
        cluster("twice", change_time=at("11-10")),
        cluster("twice", change_time=at("11-20")),
        cluster("gone", change_time=at("11-10")),
        cluster("gone", change_time=at("11-20"), delete_time=at("11-20")),
        cluster("tie", change_time=at("11-15"), owned_by="a"),
        cluster("tie", change_time=at("11-15"), owned_by="b"),
    ]
    assert len(live(spark, rows)) == 5
    assert live(spark, rows, latest_only=True) == [("tie", at("11-15")), ("twice", at("11-20"))]


def test_a_deletion_wins_ties_and_missing_ids_are_kept_apart(spark):
    rows = [
        cluster("gone", change_time=at("11-20"), dbr_version="9.1.x", delete_time=at("11-20")),
        cluster("gone", change_time=at("11-20"), dbr_version="9.9.x"),
        cluster("back", change_time=at("11-20"), delete_time=at("11-20")),
        cluster("back", change_time=at("11-21")),
        cluster(None, change_time=at("11-10")),
        cluster(None, change_time=at("11-11")),
        cluster(None, change_time=at("11-12"), delete_time=at("11-12")),
    ]
    t = tables(spark, clusters=rows)
    found = values(live_clusters(t.clusters, CFG, latest_only=True), "cluster_id", "change_time")
    assert sorted(found, key=str) == sorted([("back", at("11-21")), (None, at("11-10")), (None, at("11-11"))], key=str)


def test_workspace_ids(spark):
    rows = [cluster(workspace_id=w, delete_time=d) for w, d in [("b", None), ("a", at("01-01")), ("b", None), (None, None)]]
    assert values(workspace_ids(tables(spark, clusters=rows).clusters), "workspace_id") == [("a",), ("b",)]
