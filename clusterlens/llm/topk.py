"""Exact top-k inner products by block-at-a-time pruning.

Vectors of integers are laid out in blocks of consecutive ids. A block carries its forward index (the matrix of its
vectors) and the largest and smallest value of every term (dimension), which bound the score that any of its vectors can
reach with a query. A query visits the blocks by falling bound and stops when the next bound is below its k-th score.

Queries and vectors meet in a grid: vectors are dealt into shards by ranges of ids and queries into groups, both of
fixed size. Every pair of a shard and a group is one unit of work and returns k rows per query, so memory is bounded by
one shard and one group however large the table. The work is the product of queries and vectors less what the bounds
save; the k best of all shards come from a window over k rows per query and shard.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clusterlens.llm.common import settle

K = 20
BLOCK, SHARD, QUERY_GROUP = 256, 8_192, 4_096


def scaled(vector: Column, factor: float) -> Column:
    """Components times ``factor``, rounded down; NULL for a vector that is NULL or holds NULL or non-finite values."""
    wide = vector.cast("array<double>")
    usable = F.forall(wide, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.when(usable, F.transform(wide, lambda x: F.floor(x * F.lit(factor))))


def _matrix(vectors: list[np.ndarray], width: int) -> np.ndarray:
    """Rows padded with zeros to ``width``."""
    matrix = np.zeros((len(vectors), width), dtype=np.int64)
    for i, vector in enumerate(vectors):
        matrix[i, : len(vector)] = vector
    return matrix


def _exact_type(left: np.ndarray, right: np.ndarray) -> type:
    """Floating point where all partial sums are whole numbers below 2**53, else Python's integers."""
    most = float(np.abs(left.astype(float)).max(initial=0)) * float(np.abs(right.astype(float)).max(initial=0))
    return np.float64 if most * max(1, left.shape[1]) < 2**53 else object


def search(
    block_ids: list[np.ndarray],
    blocks: list[np.ndarray],
    query_ids: np.ndarray,
    queries: np.ndarray,
    k: int,
    block_copies: list[np.ndarray] | None = None,
    query_copies: np.ndarray | None = None,
) -> Iterator[tuple[int, np.ndarray, np.ndarray, int]]:
    """For each query: its id, the ids and scores of its ``k`` best vectors in these blocks (ties to the smaller id),
    and how many blocks were scored. A query's own id is no candidate. With numbers of copies, an id comes as often as
    there are rows of it and of the query, ``k`` times at most."""
    copies = block_copies or [np.ones(len(ids), np.int64) for ids in block_ids]
    own_copies = np.ones(len(query_ids), np.int64) if query_copies is None else query_copies
    kind = _exact_type(queries, np.concatenate(blocks))
    forward = [b.astype(kind) for b in blocks]
    q = queries.astype(kind)
    upper = np.array([b.max(axis=0) for b in blocks]).astype(kind)
    lower = np.array([b.min(axis=0) for b in blocks]).astype(kind)
    zero = kind(0) if kind is not object else 0
    bounds = np.maximum(q, zero) @ upper.T + np.minimum(q, zero) @ lower.T
    order = np.argsort(-bounds.astype(float), axis=1, kind="stable")
    for i, own in enumerate(query_ids.tolist()):
        ids, scores, times, visited = np.zeros(0, np.int64), np.zeros(0, kind), np.zeros(0, np.int64), 0
        for b in order[i].tolist():
            if len(ids) == k and bounds[i, b] < scores[-1]:
                break
            visited += 1
            found = forward[b] @ q[i]
            near = block_ids[b] != own
            if len(ids) == k:  # an equal score may still win by its id
                near &= found >= scores[-1]
            if not near.any():
                continue
            ids, scores = np.concatenate([ids, block_ids[b][near]]), np.concatenate([scores, found[near]])
            times = np.concatenate([times, copies[b][near]])
            best = sorted(range(len(ids)), key=lambda j: (-scores[j], ids[j]))[:k]
            ids, scores, times = ids[best], scores[best], times[best]
        shown = np.minimum(np.minimum(times, k) * min(int(own_copies[i]), k), k)
        yield own, np.repeat(ids, shown)[:k], np.repeat(scores, shown)[:k], visited


def _cogroup(k: int):  # noqa: ANN202
    def run(vectors: pa.Table, queries: pa.Table) -> pa.Table:
        if not vectors.num_rows or not queries.num_rows:
            return _SCHEMA.empty_table()
        vectors = vectors.sort_by([("id", "ascending")])
        ids, rows = vectors.column("id").to_numpy(), _lists(vectors.column("vector"))
        wanted = _lists(queries.column("vector"))
        width = max(map(len, [*rows, *wanted]))
        starts = range(0, len(ids), BLOCK)
        block_ids = [ids[at : at + BLOCK] for at in starts]
        blocks = [_matrix(rows[at : at + BLOCK], width) for at in starts]
        copies = vectors.column("copies").to_numpy()
        of_blocks, of_queries = [copies[at : at + BLOCK] for at in starts], queries.column("copies").to_numpy()
        query_ids, wanted = queries.column("id").to_numpy(), _matrix(wanted, width)
        parts = []
        for own, near, scores, _ in search(block_ids, blocks, query_ids, wanted, k, of_blocks, of_queries):
            whole = np.array([max(-(2**63), min(2**63 - 1, int(s))) for s in scores.tolist()], dtype=np.int64)
            parts.append(pa.table([np.full(len(near), own, np.int64), near, whole], schema=_SCHEMA))
        return pa.concat_tables(parts)

    return run


_SCHEMA = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])


def _lists(column: pa.ChunkedArray) -> list[np.ndarray]:
    whole = column.combine_chunks()
    values, offsets = whole.values.to_numpy(), whole.offsets.to_numpy()
    return [values[a:b] for a, b in zip(offsets[:-1], offsets[1:], strict=True)]


def top_k(vectors: DataFrame, is_query: Column, *, k: int = K) -> DataFrame:
    """``query_id``, ``rank`` (from 1), ``vec_id`` and ``score`` of each query's ``k`` best vectors, all if fewer.

    ``vectors`` has ``id`` (BIGINT) and ``vector`` (array of BIGINT); rows where either is NULL take no part. ``is_query``
    is evaluated on them, and NULL means no. Every row is a candidate but those with the query's own id; ties go to the
    smaller id. Rows that repeat an id are candidates of their own, and queries that repeat one share its ranks. Vectors
    of unequal length are padded with zeros. Scores beyond BIGINT are cut to its ends.

    Equal rows are searched once and counted, so neither copies nor an id with very many rows fill one shard.
    """
    usable = vectors.where(F.col("id").isNotNull() & F.col("vector").isNotNull())
    usable = settle(usable.groupBy("id", "vector").agg(F.count(F.lit(1)).alias("copies")))
    sizes = usable.agg(F.count(F.lit(1)).alias("n"), F.count(F.when(is_query, 1)).alias("q")).first()
    n_shards, n_groups = max(1, -(-sizes.n // SHARD)), max(1, -(-sizes.q // QUERY_GROUP))

    ranged = usable.repartitionByRange(n_shards, "id", F.xxhash64("vector"))
    sharded = settle(ranged.withColumn("part", F.spark_partition_id()))
    n_parts = (sharded.agg(F.max("part")).first()[0] or 0) + 1
    n_shards = min(n_shards, n_parts)
    # ranges may have come out in more partitions than asked for; neighbours make up a shard then
    sharded = sharded.withColumn("shard", F.floor(F.col("part") * n_shards / n_parts).cast("int"))
    group = F.pmod(F.xxhash64("id", "vector"), F.lit(n_groups)).cast("int").alias("group")
    queries = sharded.where(is_query).select("id", "vector", "copies", group)
    every_group = F.explode(F.sequence(F.lit(0), F.lit(n_groups - 1))).alias("group")
    left = sharded.select("shard", every_group, "id", "vector", "copies")
    every_shard = F.explode(F.sequence(F.lit(0), F.lit(n_shards - 1))).alias("shard")
    right = queries.select(every_shard, "group", "id", "vector", "copies")
    schema = "query_id bigint, vec_id bigint, score bigint"
    found = left.groupBy("shard", "group").cogroup(right.groupBy("shard", "group")).applyInArrow(_cogroup(k), schema)
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("vec_id"))
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
