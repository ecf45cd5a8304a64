"""Near duplicates by SimHash: fingerprints are split into blocks, close pairs meet in a block, and are then verified.

``classes`` works at a small Hamming radius, and exactly. With 64 bits in five blocks, two fingerprints that differ in
at most two bits agree in at least three whole blocks, so they share one of ten keys of 38 or 39 bits. Keys held by few
fingerprints are joined and verified. A key held by many, as by a large group of near copies, would give pairs in the
square of its size; its fingerprints are spelled out into their 65 neighbours at distance 0 and 1 instead. Two
fingerprints are within two bits if and only if they share such a neighbour, so linking all holders of a neighbour to
the smallest one loses no link and stays linear.

``near_classes`` works at a Jaccard similarity of word shingles, where the radius is far too wide for whole blocks to be
certain. It takes a longer fingerprint, draws many keys from it, and links those whose Hamming distance fits the
similarity. Within a key no such link is lost: a search goes from fingerprint to fingerprint and compares each with all
that it has not reached yet. A group of near copies is reached in a few steps, linear in its size; holders that have
nothing to do with each other are all compared. Keys held by more than a task should compare are first reduced by the
triangle inequality and then dealt out in cells of two blocks, so that any two holders meet in a cell.

Equal fingerprints become one node first, so exact copies never form pairs.
"""

from __future__ import annotations

import math
import operator
from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clusterlens.llm.common import fits_broadcast, settle, spread_join
from clusterlens.llm.components import connected_components

SEED = 42
RADIUS = 2
BLOCKS = 5
# Keys held by at most so many fingerprints are joined pair by pair; larger ones take the linear way.
PAIRED_HOLDERS = 16

WORDS, SIMILARITY = 5, 0.8
# Of the longer fingerprint: 64-bit words, bits in a key, shuffles of the bits from which keys are cut.
LONG_WORDS, KEY_BITS, SHUFFLES = 8, 24, 6
# Holders of a key that one task compares; keys with more are dealt out in cells of two blocks of about this size.
COMPARED_HOLDERS = 4096

_CHUNK = 8192


def shingle_digests(text: str, size: int) -> bytes:
    """XXH64 of every run of ``size`` words, eight big-endian bytes each, after lower-casing A-Z.

    Words are separated by ASCII white space. Fewer words make one shingle, none make none.
    """
    words = text.encode().lower().split()
    joined = b" ".join(words)
    if len(words) <= size:
        return xxhash.xxh64_digest(joined, SEED) if words else b""
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    spans = zip(starts[: len(words) - size + 1].tolist(), ends[size - 1 :].tolist(), strict=True)
    digest = xxhash.xxh64_digest
    return b"".join([digest(joined[start:end], SEED) for start, end in spans])


def _mixed(hashes: np.ndarray, words: int) -> np.ndarray:
    """``words`` 64-bit values per hash: the hash itself, and multiplicative mixes of it."""
    columns = [hashes]
    for i in range(1, words):
        x = hashes + np.uint64((0x9E3779B97F4A7C15 * i) & 0xFFFFFFFFFFFFFFFF)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        columns.append(x ^ (x >> np.uint64(31)))
    return np.stack(columns, axis=1)


def fingerprint(text: str, size: int, words: int = 1, distinct: bool = False) -> np.ndarray:
    """The fingerprint as unsigned 64-bit words: a bit is 1 if it is set in over half of the shingles' hashes.

    Repeated shingles count as often as they occur, or once with ``distinct``.
    """
    hashes = np.frombuffer(shingle_digests(text, size), dtype=">u8").astype(np.uint64)
    if distinct:
        hashes = np.unique(hashes)
    counts = np.zeros(64 * words, dtype=np.int64)
    for at in range(0, len(hashes), _CHUNK):
        values = _mixed(hashes[at : at + _CHUNK], words).astype(">u8")
        bits = np.unpackbits(values.view(np.uint8).reshape(len(values), -1), axis=1)
        counts += np.add.reduce(bits, axis=0, dtype=np.uint32)
    return np.packbits(2 * counts > len(hashes)).view(">u8").astype(np.uint64)


def fingerprints(docs: DataFrame, *, size: int, words: int, doc_id: str, text: str, distinct: bool = False) -> DataFrame:
    """``doc_id``, ``text_hash``, ``node`` (the first word of the fingerprint, signed) and ``rest`` (the other words)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = [fingerprint(body, size, words, distinct) for body in batch.column(2).to_pylist()]
            matrix = np.array(prints, dtype=np.uint64).reshape(-1, words).view(np.int64)
            rest = pa.FixedSizeListArray.from_arrays(pa.array(matrix[:, 1:].ravel()), words - 1) if words > 1 else None
            lists = pa.array([[]] * len(prints), pa.list_(pa.int64())) if rest is None else rest.cast(pa.list_(pa.int64()))
            first = pa.array(np.ascontiguousarray(matrix[:, 0]))
            columns = [batch.column(0), batch.column(1), first, lists]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "text_hash", "node", "rest"])

    body = F.coalesce(F.col(text), F.lit(""))
    texts = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.xxhash64(body).alias("text_hash"), body.alias("text"))
    return texts.mapInArrow(run, "doc_id bigint, text_hash bigint, node bigint, rest array<bigint>")


def _masks() -> list[int]:
    """A mask for each choice of the blocks that two close fingerprints are sure to share."""
    bounds = [64 * i // BLOCKS for i in range(BLOCKS + 1)]
    blocks = [(1 << high) - (1 << low) for low, high in zip(bounds[:-1], bounds[1:], strict=True)]
    masks = [sum(chosen) for chosen in combinations(blocks, BLOCKS - RADIUS)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def _distance(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def close_pairs(nodes: DataFrame) -> DataFrame:
    """Edges ``a``, ``b`` between distinct 64-bit ``node`` values that connect all those within two bits.

    Every edge is within two bits, and any two nodes within two bits are connected by such edges.
    """
    node = F.col("node")
    keys = nodes.select(
        "node", F.explode(F.array(*[F.xxhash64(F.lit(i), node.bitwiseAND(F.lit(m))) for i, m in enumerate(_masks())]))
    ).withColumnRenamed("col", "key")
    held = keys.groupBy("key").agg(F.count(F.lit(1)).alias("holders")).where("holders > 1")
    members = settle(spread_join(keys.withColumn("_key", F.col("key")), held, "key").drop("key"))

    few = members.where(F.col("holders") <= PAIRED_HOLDERS).select("_key", "node")
    left, right = few.select("_key", F.col("node").alias("a")), few.select("_key", F.col("node").alias("b"))
    paired = left.join(right, "_key").where(
        (F.col("a") < F.col("b")) & (_distance(F.col("a"), F.col("b")) <= RADIUS)
    )

    many = members.where(F.col("holders") > PAIRED_HOLDERS).select("node").distinct()
    flips = [F.lit((1 << i) - (1 << 64) if i == 63 else 1 << i) for i in range(64)]
    ball = many.select("node", F.explode(F.array(node, *[node.bitwiseXOR(f) for f in flips])).alias("near"))
    first = ball.groupBy("near").agg(F.min("node").alias("b"), F.count(F.lit(1)).alias("n")).where("n > 1")
    starred = spread_join(ball, first, "near").where(node != F.col("b"))
    return paired.select("a", "b").unionByName(starred.select(F.col("node").alias("a"), "b"))


def _with_component(rows: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Give each row the smallest id of its component; ``nodes`` has the smallest id of each node."""
    roots = settle(connected_components(edges))
    linked = nodes.join(roots.select("node", "root"), "node", "left")
    root = F.coalesce("root", "node")
    named = settle(linked.select("node", "first_id", root.alias("root")))
    least = named.groupBy("root").agg(F.min("first_id").alias("component_id"))
    of_node = spread_join(named, least, "root").select("node", "component_id")
    return spread_join(rows.select("doc_id", "text_hash", F.col("node").alias("_node"), "node"), of_node, "node").select(
        "doc_id", "text_hash", F.col("_node").alias("node"), "component_id"
    )


def classes(docs: DataFrame, *, size: int = 3, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id``, ``text_hash``, ``node`` (the 64-bit fingerprint) and ``component_id`` for every row of ``docs``.

    ``component_id`` is the smallest id reachable over links of at most two bits, the row's own included; NULL ids are
    never the smallest, and a component without any id has NULL. A NULL text counts as empty. Texts without words have
    fingerprint zero and are linked like any other. Repeated rows get equal results, and other columns play no part.
    """
    rows = settle(fingerprints(docs, size=size, words=1, doc_id=doc_id, text=text).drop("rest"))
    nodes = settle(rows.groupBy("node").agg(F.min("doc_id").alias("first_id")))
    return _with_component(rows, nodes, close_pairs(nodes.select("node")))


def allowed_distance(similarity: float, bits: int) -> int:
    """Hamming distance expected at a Jaccard similarity of sets of equal size, plus one standard deviation."""
    share = math.acos(2 * similarity / (1 + similarity)) / math.pi
    return int(bits * share + math.sqrt(bits * share * (1 - share)))


def _key_rows(nodes: DataFrame, words: int) -> DataFrame:
    """Every node under each of its keys: cuts of ``KEY_BITS`` bits from fixed shuffles of the fingerprint."""
    bits = 64 * words
    cuts = bits // KEY_BITS
    generator = np.random.default_rng(SEED)
    orders = np.concatenate([generator.permutation(bits)[: cuts * KEY_BITS] for _ in range(SHUFFLES)])
    weights = 1 << np.arange(KEY_BITS, dtype=np.int64)
    prefixes = np.arange(cuts * SHUFFLES, dtype=np.int64) << KEY_BITS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                node = part.column(0).to_numpy()
                values = part.column(1).flatten().to_numpy().reshape(len(node), words).astype(">i8")
                bit = np.unpackbits(values.view(np.uint8).reshape(len(node), -1), axis=1)
                cut = bit[:, orders].reshape(len(node), cuts * SHUFFLES, KEY_BITS)
                keys = cut.astype(np.int64) @ weights + prefixes
                columns = [pa.array(keys.ravel()), pa.array(np.repeat(node, cuts * SHUFFLES))]
                yield pa.RecordBatch.from_arrays(columns, names=["key", "node"])

    return nodes.select("node", "bits").mapInArrow(run, "key bigint, node bigint")


def _shared(keys: DataFrame) -> DataFrame:
    """The rows whose key is held by more than one node."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = node = None
        known = False  # whether the open row has been found to share its key
        for batch in batches:
            if not batch.num_rows:
                continue
            keys, nodes = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            if key is not None:
                keys, nodes = np.concatenate([[key], keys]), np.concatenate([[node], nodes])
            same = keys[1:] == keys[:-1]
            kept = np.concatenate([[known], same]) | np.concatenate([same, [False]])
            key, node, known = keys[-1], nodes[-1], bool(kept[-1])
            kept[-1] = False  # the last row stays open, as the next batch may go on with its key
            yield pa.RecordBatch.from_arrays([pa.array(keys[kept]), pa.array(nodes[kept])], names=["key", "node"])
        if known:
            yield pa.RecordBatch.from_arrays([pa.array([key], pa.int64()), pa.array([node], pa.int64())], names=["key", "node"])

    return keys.repartition("key").sortWithinPartitions("key", "node").mapInArrow(run, "key bigint, node bigint")


def _forest(bits: np.ndarray, most: int) -> np.ndarray:
    """Pairs of rows of ``bits`` (64-bit words) within ``most`` bits that connect all rows so close."""
    pool, at = np.ascontiguousarray(bits.T), np.arange(len(bits))
    pairs: list[np.ndarray] = []
    reached: list[int] = []
    while len(at):
        if not reached:
            reached, pool, at = [int(at[0])], pool[:, 1:], at[1:]
        one = reached.pop()
        near = np.bitwise_count(pool ^ bits[one][:, None]).sum(axis=0, dtype=np.uint32) <= most
        if near.any():
            found = at[near]
            pairs.append(np.stack([np.full(len(found), one), found], axis=1))
            reached += found.tolist()
            pool, at = pool[:, ~near], at[~near]
    return np.concatenate(pairs) if pairs else np.empty((0, 2), np.int64)


def _compared(rows: DataFrame, words: int, most: int) -> DataFrame:
    """Links between nodes under one ``key`` that connect all those within ``most`` bits of their whole fingerprints."""

    def links(held: np.ndarray) -> pa.RecordBatch:
        """``held``: the node and the words of its fingerprint."""
        ends = held[:, 0].view(np.int64)[_forest(held[:, 1:], most)]
        return pa.RecordBatch.from_arrays([pa.array(ends.max(axis=1)), pa.array(ends.min(axis=1))], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, np.empty((0, 1 + words), np.uint64)
        for batch in batches:
            if not batch.num_rows:
                continue
            found = batch.column(2).flatten().to_numpy().reshape(batch.num_rows, words)
            rows_ = np.concatenate([batch.column(1).to_numpy()[:, None], found], axis=1).view(np.uint64)
            keys = np.concatenate([np.full(len(held), key, np.int64), batch.column(0).to_numpy()]) if len(held) else batch.column(0).to_numpy()
            rows_ = np.concatenate([held, rows_])
            starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
            found = [links(rows_[start:end]) for start, end in zip(starts[:-1], starts[1:], strict=True)]
            yield from pa.Table.from_batches(found).combine_chunks().to_batches() if found else []
            key, held = keys[-1], rows_[starts[-1] :]
        if len(held):
            yield links(held)

    ordered = rows.select("key", "node", "bits").repartition("key").sortWithinPartitions("key", "node")
    return ordered.mapInArrow(run, "a bigint, b bigint")


def _apart(bits: Column, other: Column, words: int) -> Column:
    """Hamming distance of whole fingerprints."""
    return reduce(operator.add, [_distance(bits[i], other[i]) for i in range(words)])


def _in_cells(members: DataFrame, words: int, most: int) -> DataFrame:
    """Like ``_compared``, for keys with very many holders: no task sees more than about two blocks of a key.

    All holders are compared with one of their key, the pivot. A holder x of distance e from it can have a link that its
    link to the pivot does not replace only to a y farther than ``most`` from the pivot, and y is at most e + ``most``
    away from it. Holders with e + ``most`` below the nearest such y are settled; the others meet pairwise in cells.
    """
    pivots = members.groupBy("key").agg(F.min(F.struct("node", "bits")).alias("pivot"))
    placed = spread_join(members, pivots, "key")
    apart = _apart(F.col("bits"), F.col("pivot.bits"), words)
    placed = settle(placed.select("key", "node", "bits", F.col("pivot.node").alias("_pivot"), apart.alias("_apart")))
    star = placed.where((F.col("_apart") <= most) & (F.col("node") != F.col("_pivot")))
    star = star.select(F.greatest("node", "_pivot").alias("a"), F.least("node", "_pivot").alias("b"))

    beyond = placed.where(F.col("_apart") > most).groupBy("key").agg(F.min("_apart").alias("_nearest"))
    left = spread_join(placed, beyond, "key").where(F.col("_apart") >= F.col("_nearest") - most)
    left = settle(left.select("key", "node", "bits"))
    blocks = left.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / F.lit(COMPARED_HOLDERS)).cast("int").alias("_blocks"))
    mine = F.pmod(F.xxhash64("node"), F.col("_blocks").cast("bigint")).cast("int")
    dealt = spread_join(left, blocks, "key").withColumn("_mine", mine)
    dealt = dealt.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    # two cells that share a hash are compared as one
    cell = F.xxhash64("key", F.least("_mine", "_other"), F.greatest("_mine", "_other"))
    return star.unionByName(_compared(dealt.select(cell.alias("key"), "node", "bits"), words, most))


def _near_links(nodes: DataFrame, words: int, most: int) -> DataFrame:
    """Edges within ``most`` bits that connect all ``node`` with ``bits`` so close that share a key."""
    shared = settle(_shared(_key_rows(nodes, words)))
    held = settle(shared.groupBy("key").agg(F.count(F.lit(1)).alias("holders")))
    members = spread_join(shared, held, "key").join(nodes.select("node", "bits"), "node")
    links = _compared(members.where(F.col("holders") <= COMPARED_HOLDERS), words, most)
    if not held.where(F.col("holders") > COMPARED_HOLDERS).isEmpty():
        many = settle(members.where(F.col("holders") > COMPARED_HOLDERS).select("key", "node", "bits"))
        links = links.unionByName(_in_cells(many, words, most))
    return links.distinct()


def near_classes(
    docs: DataFrame,
    *,
    size: int = WORDS,
    similarity: float = SIMILARITY,
    words: int = LONG_WORDS,
    doc_id: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """Like ``classes``, for sets of shingles of ``size`` words and a Jaccard similarity of about ``similarity`` or more.

    Shingles that repeat within a text count once, unlike in ``classes``, as the similarity is one of sets.
    The similarity is read off the Hamming distance of ``64 * words`` bits, whose standard error at 0.8 is 0.04 for 512
    bits. A pair at 0.8 shares one of the 126 keys with probability 0.92, at 0.85 with 0.99, and all that share a key are
    linked, however many hold it. Texts whose fingerprints agree in all bits are one node, known by a hash of these.
    """
    found = fingerprints(docs, size=size, words=words, doc_id=doc_id, text=text, distinct=True)
    bits = F.concat(F.array("node"), "rest")
    rows = settle(found.select("doc_id", "text_hash", F.xxhash64(bits).alias("node"), bits.alias("bits")))
    nodes = settle(rows.groupBy("node").agg(F.min("doc_id").alias("first_id"), F.min("bits").alias("bits")))
    edges = _near_links(nodes, words, allowed_distance(similarity, 64 * words))
    return _with_component(rows.drop("bits"), nodes.drop("bits"), edges)


def drop_near_copies(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` without near copies: of each class the row with the smallest id stays.

    Rows without an id stay, and rows that repeat an id are told apart by their text. What is dropped carries no text:
    it is broadcast if measured small, and shuffled otherwise.
    """
    found = near_classes(docs, doc_id=doc_id, text=text)
    gone = found.where(F.col("doc_id") != F.col("component_id"))
    gone = settle(gone.select(F.col("doc_id").alias("_gone"), F.col("text_hash").alias("_gone_hash")).distinct())
    if fits_broadcast(gone.count(), 64):
        gone = F.broadcast(gone)
    same_text = F.xxhash64(F.coalesce(F.col(f"_d.`{text}`"), F.lit(""))) == F.col("_c._gone_hash")
    same_id = F.col(f"_d.`{doc_id}`") == F.col("_c._gone")
    return docs.alias("_d").join(gone.alias("_c"), same_id & same_text, "left_anti")
