"""Bounded samples of rows for fitting models."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_MOST = (1 << 63) - 1
_LOW_BITS = 20


def group_sizes(rows: DataFrame, group: Column) -> dict:
    """Rows per value of ``group``: one row per value comes to the driver."""
    return {r[0]: r[1] for r in rows.groupBy(group.alias("g")).agg(F.count(F.lit(1))).collect()}


def limits(sizes: Mapping, most: int) -> dict:
    """Per group, the largest 63-bit number drawn: such a part of all numbers as ``most``, shared by the groups, is of it."""
    each = most / len(sizes)
    return {g: _MOST if each >= n else int((1 << 63) * (each / n)) for g, n in sizes.items()}


def drawn_number(doc_id: str, salt: int) -> Column:
    """63 bits of a hash of the id."""
    hashed = F.xxhash64(doc_id, F.lit(salt))
    low = hashed.bitwiseAND(F.lit((1 << _LOW_BITS) - 1))
    return F.shiftleft(low, 63 - _LOW_BITS).bitwiseOR(F.shiftrightunsigned(hashed, _LOW_BITS + 1))


def draw(
    rows: DataFrame, most: int, *, doc_id: str = "doc_id", by: Column | None = None, salt: int = 0
) -> DataFrame:
    """About ``most`` rows (per value of ``by``: an equal part of it), chosen by a hash of the id; all, if there are no
    more. The same rows are chosen every time. One count decides the share, to 63 bits, so the sample of a group does not
    run empty however large the group is; the draw itself moves nothing. Rows with one id are drawn together. A draw from
    rows that were drawn before needs another ``salt``.
    """
    group = F.lit(0) if by is None else by
    sizes = group_sizes(rows, group)
    if not sizes:
        return rows.limit(0)
    shares = [F.when(group.eqNullSafe(F.lit(g)), F.lit(limit)) for g, limit in limits(sizes, most).items()]
    return rows.where(drawn_number(doc_id, salt) <= F.coalesce(*shares))
