"""Reports over random dirty inputs, by each join path, against the SQL that the test data is checked with."""

import random
from datetime import datetime, timedelta
from decimal import Decimal

import duckdb
import pyarrow as pa
import pytest

import __spark_entry__ as contract
import oracle_queries
from tests.frames import CFG, SMALL, cluster, price, sample, tables, used
from tests.test_oracle import normal

INPUTS = frozenset({"clusters", "node_types", "list_prices", "usage", "samples"})
NAMES = sorted(contract.REPORTS)

IDS = ["hot", "hot", "hot", "a", "b", "c", "d", "e", None]
VERSIONS = ["17.3.x", "15.4.x-ml", "14.3.x", "13.3.x-gpu", "12.2", "16.4.x", "15.1.x", "custom", "99.99-ML", "", None]
NODE_TYPES = [
    "Standard_D4ds_v5", "Standard_DS3_v2", "Standard_E8ds_v4", "Standard_F8s_v1", "Standard_L8s_v3", "Standard_M64ms",
    "Standard_NC24_v0", "Standard_B2_v5", "Standard_B2_v4", "m5.xlarge", "unknown_v1", "", None,
]


def instants(pick, n):
    first = datetime(2026, 10, 20)
    return [first + timedelta(hours=pick.randrange(0, 24 * 48)) for _ in range(n)]


def inputs(seed):
    pick = random.Random(seed)
    some = pick.choice
    clusters = [
        cluster(
            some(IDS),
            workspace_id=some(["w1", "w2", None]),
            dbr_version=some(VERSIONS),
            driver_node_type=some(NODE_TYPES),
            worker_node_type=some(NODE_TYPES),
            change_time=when.replace(hour=when.hour // 12 * 12),  # several records of one instant
            delete_time=some([None, None, None, when]),
        )
        for when in instants(pick, 150)
    ]
    usage = []
    for when in instants(pick, 300):
        row = used(some([*IDS, "elsewhere"]), f"{pick.randrange(0, 90000)}E-4", some(["S", "S", "T", "U", None]))
        row["usage_start_time"] = some([when, when, when.replace(hour=0)])
        row["usage_quantity"] = some([row["usage_quantity"], row["usage_quantity"], None])
        usage.append(row)
    prices = []
    for start, end in zip(instants(pick, 20), instants(pick, 20), strict=True):
        row = price(None, None, f"{pick.randrange(1, 9000)}E-4", some(["S", "T", "V", None]))
        row["pricing"] = some([row["pricing"], row["pricing"], {"default": None}])
        row["price_start_time"] = some([start.replace(hour=0), start, datetime(2020, 1, 1), None])
        row["price_end_time"] = some([end.replace(hour=0), end, None])
        prices.append(row)

    def quarters(low, high):
        """Exact in binary, so that sums do not depend on their order; or NULL."""
        return some([pick.randrange(low * 4, high * 4) / 4, pick.randrange(low * 4, high * 4) / 4, None])

    samples = []
    for when in instants(pick, 300):
        who = some(IDS)
        cpu, io, mem, swap = {"hot": (40, 0, 0, 0), "a": (80, 0, 0, 0), "b": (60, 12, 0, 0), "c": (0, 25, 80, 0)}.get(who, (0, 0, 0, 1))
        row = sample(who, cpu=quarters(cpu, cpu + 20), system=quarters(0, 9), io=quarters(io, io + 5), mem=quarters(mem, mem + 20))
        row["mem_swap_percent"] = quarters(swap, swap + 1)
        row["start_time"], row["driver"] = when, some([False, False, True, None])
        samples.append(row)
    nodes = [
        (name, some([4.0, 16.0, 17.0, 33.0, None]), some([16384, 65536, 65537, 262144]))
        for name in pick.sample(NODE_TYPES[:-1], 9) + pick.sample(NODE_TYPES[:-1], 3)
    ]
    return {"clusters": clusters, "usage": usage, "prices": prices, "samples": samples, "nodes": nodes}


def views(made, t):
    """The inputs in the shape that the SQL steps give them."""
    connection = duckdb.connect()
    nodes = [dict(zip(t.node_types.columns, node, strict=True)) for node in made["nodes"]]
    for name, rows in (
        ("clusters", made["clusters"]),
        ("raw_usage", made["usage"]),
        ("raw_prices", made["prices"]),
        ("timeline", made["samples"]),
        ("node_types", nodes),
    ):
        connection.register(f"{name}_rows", pa.Table.from_pylist(rows))
        connection.execute(f"CREATE TABLE {name} AS SELECT * FROM {name}_rows")
    connection.execute(
        """CREATE VIEW usage AS
           SELECT sku_name AS sku, usage_start_time AS began, CAST(usage_quantity AS DECIMAL(18,4)) AS quantity,
                  usage_metadata.cluster_id AS cluster_id FROM raw_usage"""
    )
    connection.execute(
        """CREATE VIEW list_prices AS
           SELECT sku_name AS sku, price_start_time AS starts, price_end_time AS ends,
                  CAST(pricing['default'] AS DECIMAL(18,4)) AS price FROM raw_prices"""
    )
    connection.execute(
        """CREATE VIEW samples AS
           SELECT cluster_id, CAST(start_time AS DATE) AS day, cpu_user_percent + cpu_system_percent AS cpu,
                  cpu_wait_percent AS io_wait, mem_used_percent AS memory, mem_swap_percent AS swap
           FROM timeline
           WHERE start_time >= TIMESTAMP '2026-11-01 00:00:00' AND NOT driver AND cluster_id IS NOT NULL"""
    )
    return connection


@pytest.fixture(scope="module", params=[(1, SMALL), (2, frozenset())], ids=["broadcast", "shuffled"])
def both(request, spark):
    seed, small = request.param
    made = inputs(seed)
    t = tables(spark, small=small, **made)
    connection = views(made, t)
    yield t, connection
    connection.close()


@pytest.mark.parametrize("name", NAMES)
def test_report(both, name):
    t, connection = both
    df = contract._comparable(contract.REPORTS[name](t, CFG))
    expected = connection.execute(oracle_queries.all_queries(INPUTS)[name])
    columns = [d[0] for d in expected.description]
    rows = expected.fetchall()
    assert rows
    assert normal(df.columns, df.collect()) == normal(columns, rows)


def test_inputs_are_dirty():
    made = inputs(1)
    assert any(row["cluster_id"] is None for row in made["clusters"])
    assert any(row["usage_quantity"] is None for row in made["usage"])
    assert isinstance(made["usage"][0]["usage_quantity"] or Decimal(0), Decimal)
