"""Exact top-k against brute force."""

import random

import duckdb
import pytest
from pyspark.sql import functions as F

from clusterlens.llm import queries, topk


def brute(rows, k, every):
    usable = [(name, vector) for name, vector in rows if name is not None and vector is not None]
    found = []
    for q in sorted({name for name, _ in usable}):
        if q % every == 0:
            scored = sorted(
                (-sum(x * y for x, y in zip(own, v)), n) for name, own in usable if name == q for n, v in usable if n != q
            )
            found += [(q, rank, n, -s) for rank, (s, n) in enumerate(scored[:k], start=1)]
    return found


@pytest.mark.parametrize("largest", [1, 40, 2**29])
def test_against_brute_force(spark, monkeypatch, largest):
    monkeypatch.setattr(topk, "SHARD", 70)
    monkeypatch.setattr(topk, "QUERY_GROUP", 7)
    pick = random.Random(largest)
    rows = [(n, [pick.randint(-largest, largest) for _ in range(6)]) for n in range(-20, 400)]
    rows += [(None, [1] * 6), (900, None), (17, [0] * 6), (17, [0] * 6)]
    # candidates and queries that repeat an id, with other vectors and with the same
    rows += [(n, [pick.randint(-largest, largest) for _ in range(6)]) for n in (3, 3, 20, 40, 40)]
    rows += [rows[25]] * 5 + [rows[60]] * 2 + [(7, [largest] * 6)] * 30
    vectors = spark.createDataFrame(rows, "id long, vector array<long>")
    found = topk.top_k(vectors, F.col("id") % 10 == 0, k=9).collect()
    assert sorted(map(tuple, found)) == brute(rows, 9, 10)


def test_blocks_below_the_bound_are_skipped():
    import numpy as np

    ids = [np.arange(n, n + 10) for n in range(0, 100, 10)]
    blocks = [np.full((10, 4), 100 - n, dtype=np.int64) for n in range(10)]
    [(own, near, scores, visited)] = topk.search(ids, blocks, np.array([-1]), np.ones((1, 4), dtype=np.int64), 5)
    assert (own, near.tolist(), visited) == (-1, [0, 1, 2, 3, 4], 1)


def test_few_empty_and_unequal_vectors(spark):
    rows = [(0, [1, 2]), (20, [3]), (21, []), (40, [1, 1, 5])]
    found = topk.top_k(spark.createDataFrame(rows, "id long, vector array<long>"), F.col("id") % 20 == 0)
    assert sorted(map(tuple, found.collect()))[:3] == [(0, 1, 20, 3), (0, 2, 40, 3), (0, 3, 21, 0)]
    assert topk.top_k(spark.createDataFrame([], "id long, vector array<long>"), F.col("id") % 20 == 0).count() == 0


def test_scaling(spark):
    inf, nan = float("inf"), float("nan")
    rows = [([0.5, -0.01],), ([1.0, None],), ([nan],), ([inf],), ([-inf, 1.0],), (None,), ([],)]
    found = spark.createDataFrame(rows, "v array<float>").select(topk.scaled(F.col("v"), 64.0).alias("s")).collect()
    assert [r.s for r in found] == [[32, -1], None, None, None, None, None, []]


def test_the_query_equals_its_sql(spark):
    sf_dir = "/root/testdata/sf0.001"
    connection = duckdb.connect()
    connection.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{sf_dir}/embeddings.parquet'")
    expected = connection.execute(f"SELECT query_id, rank, vec_id, score FROM ({queries.ORACLE_SQL['op9_topk']})").fetchall()
    assert sorted(map(tuple, queries.op9_topk(spark, sf_dir).collect())) == sorted(expected)


def test_repeated_ids_equal_the_sql(spark):
    rows = [(1, [5.0, 0.0]), (1, [3.0, 0.0]), (2, [1.0, 0.0]), (2, [1.0, 0.0]), (20, [1.0, 1.0]), (20, [2.0, 0.5]), (20, [1.0, 1.0]), (40, [0.0, 1.0])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    scaled = vectors.select(F.col("vec_id").alias("id"), topk.scaled(F.col("embedding"), 64.0).alias("vector"))
    embeddings = vectors.toPandas()  # noqa: F841
    expected = duckdb.connect().execute(f"SELECT query_id, rank, vec_id, score FROM ({queries.ORACLE_SQL['op9_topk']})").fetchall()
    assert sorted(map(tuple, topk.top_k(scaled, F.col("id") % 20 == 0).collect())) == sorted(expected)
