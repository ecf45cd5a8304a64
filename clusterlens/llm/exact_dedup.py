"""Exact duplicates by progressive refinement: length, then a hash of the prefix, then a hash of the whole text.

Texts are equal when they are identical after lower-casing A-Z; NULL counts as empty. Only built-in functions are used.

1. A first scan counts the documents of every length in bytes.
2. A second one hashes the first characters of documents whose length another one has, and counts these pairs.
3. A third one marks the documents whose pair another one has, and hashes the full text of those alone.

``copies`` shuffles no text, ``drop_copies`` only the rows of documents that have a copy and stay. Surviving lengths and
pairs are counted first: while they fit the broadcast bound they are broadcast, so the next scan knows which texts to
hash; beyond it the scan hashes every text, and the hashes meet the survivors in a shuffled join instead of the text.
Hot groups of copies are combined before each shuffle.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clusterlens.llm import common

PREFIX_CHARS = 128
_LENGTH_BYTES, _PAIR_BYTES, _GROUP_BYTES = 32, 48, 160


def normalised(text: Column) -> Column:
    return common.ascii_lower(F.coalesce(text, F.lit("")))


def _length(text: Column) -> Column:
    return F.octet_length(F.coalesce(text, F.lit("")))


def _pair(text: Column, prefix_chars: int) -> Column:
    """Length and prefix hash in one BIGINT key."""
    prefix = normalised(F.substring(text, 1, prefix_chars))
    return F.xxhash64(_length(text), prefix)


def surviving_pairs(docs: DataFrame, text: str, prefix_chars: int, *, broadcast: bool | None = None) -> DataFrame:
    """Pairs of length and prefix hash that more than one document has, among lengths that more than one has."""
    texts = docs.select(_length(F.col(text)).alias("_length"), F.col(text).alias("_text"))
    lengths = texts.groupBy("_length").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("_length")
    lengths = common.settle(lengths)
    small = common.fits_broadcast(lengths.count(), _LENGTH_BYTES) if broadcast is None else broadcast
    pair = _pair(F.col("_text"), prefix_chars).alias("_pair")
    if small:
        hashed = texts.join(F.broadcast(lengths), "_length", "left_semi").select("_length", pair)
    else:
        hashed = texts.select("_length", pair)
    pairs = hashed.groupBy("_length", "_pair").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
    return pairs.join(lengths, "_length", "left_semi").select("_pair")


def copies(
    docs: DataFrame,
    *,
    doc_id: str = "doc_id",
    text: str = "text",
    carry: Mapping[str, Column] | None = None,
    prefix_chars: int = PREFIX_CHARS,
    broadcast: bool | None = None,
) -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, ``keep_id``, ``group_size``, ``kept`` and the ``carry`` expressions.

    ``keep_id`` is the largest id among equal texts, NULL if none of them has an id. ``kept`` is true where the row's id
    is ``keep_id`` (NULL ids: where ``keep_id`` is NULL too). Rows that repeat an id and its text are one document: all
    repetitions are marked alike. An empty table gives no rows; other columns of ``docs`` play no part, whatever their
    names. ``broadcast`` overrides the measurement, for tests.
    """
    carry = dict(carry or {})
    body, full = F.col(text), F.sha2(normalised(F.col(text)).cast("binary"), 256)
    pairs = common.settle(surviving_pairs(docs, text, prefix_chars, broadcast=broadcast))
    small = common.fits_broadcast(pairs.count(), _PAIR_BYTES) if broadcast is None else broadcast
    base = [F.col(doc_id).alias("doc_id"), _pair(body, prefix_chars).alias("_pair")]
    carried = [value.alias(name) for name, value in carry.items()]
    marks = pairs.select("_pair", F.lit(True).alias("_survives"))
    if small:
        scanned = docs.select(*base, body.alias("_text"), *carried).join(F.broadcast(marks), "_pair", "left")
        digest = F.when(F.col("_survives"), F.sha2(normalised(F.col("_text")).cast("binary"), 256))
        rows = scanned.select("doc_id", digest.alias("_digest"), *carry)
    else:
        hashed = docs.select(*base, full.alias("_full"), *carried)
        scanned = common.spread_join(hashed, marks, "_pair", "left")
        rows = scanned.select("doc_id", F.when(F.col("_survives"), F.col("_full")).alias("_digest"), *carry)
    rows = common.settle(rows)
    groups = (
        rows.where(F.col("_digest").isNotNull())
        .groupBy("_digest")
        .agg(F.max("doc_id").alias("_keep"), F.count(F.lit(1)).alias("_size"))
        .where("_size > 1")
        # a new name for the digest: the join below then shuffles both sides and can split a hot group
        .select(F.concat(F.lit("="), "_digest").alias("_group"), "_keep", "_size")
    )
    grouped = rows.withColumn("_group", F.concat(F.lit("="), "_digest")).join(groups, "_group", "left")
    alone = F.col("_size").isNull()
    keep = F.when(alone, F.col("doc_id")).otherwise(F.col("_keep"))
    return grouped.select(
        "doc_id",
        keep.alias("keep_id"),
        F.coalesce(F.col("_size"), F.lit(1)).cast("bigint").alias("group_size"),
        keep.eqNullSafe(F.col("doc_id")).alias("kept"),
        *carry,
    )


def drop_copies(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` without copies: of equal texts the row with the largest id stays, and exactly one such row.

    Rows without a copy go straight from the scan to the result. The others meet their group on the digest of the text;
    the survivor of each group is one row, also where an id is repeated or NULL. Other columns of the row that stays
    come from one of the rows with that id and text.
    """
    body = F.col(f"`{text}`")
    pairs = common.settle(surviving_pairs(docs, text, PREFIX_CHARS))
    marks = pairs.select("_pair", F.lit(True).alias("_survives"))
    if common.fits_broadcast(pairs.count(), _PAIR_BYTES):
        marks = F.broadcast(marks)
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")
    marked = docs.select(row, _pair(body, PREFIX_CHARS).alias("_pair")).join(marks, "_pair", "left")
    alone = marked.where(F.col("_survives").isNull()).select("_row")
    identity = F.col("_row").getField(doc_id)
    digest = F.sha2(normalised(F.col("_row").getField(text)).cast("binary"), 256)
    shared = marked.where("_survives").select("_row", F.concat(F.lit("="), digest).alias("_group"))
    groups = common.settle(shared.groupBy("_group").agg(F.max(identity).alias("_keep")))
    if common.fits_broadcast(groups.count(), _GROUP_BYTES):
        groups = F.broadcast(groups)
    holders = shared.join(groups, "_group").where(identity.eqNullSafe(F.col("_keep")))
    one = holders.groupBy("_group").agg(F.first("_row").alias("_row"))
    return alone.unionByName(one.select("_row")).select("_row.*")
