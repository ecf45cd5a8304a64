"""Joining instants to validity intervals by ranges of equal weight.

The instants at which the intervals of a key begin are cut into ranges, so that an instant is compared with the intervals
of its range alone. An interval is repeated for every range that it reaches into. A cut is therefore made only where at
least as many intervals have begun since the cut before as reach across it: all cuts together then repeat intervals no
oftener than there are intervals, however long they are.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Keys with fewer intervals have one range; ranges begin with at least as many.
MIN_WEIGHT = 64
# About so many places for cuts are looked at, over all keys. They are read by the driver and broadcast.
MAX_PLACES = 4096
_BLOCK = 64


@dataclass(frozen=True)
class Ranges:
    """Where the ranges of each key are cut, in microseconds since the epoch; keys without cuts are left out."""

    cuts: Mapping[str, tuple[int, ...]] = field(default_factory=dict)

    def frame(self, spark: SparkSession) -> DataFrame:
        """``_cut_key``, the ``cuts`` in order, and every ``_BLOCK``-th of them."""
        rows = [(key, list(cuts), list(cuts[::_BLOCK])) for key, cuts in self.cuts.items()]
        return spark.createDataFrame(rows, "_cut_key string, cuts array<bigint>, blocks array<bigint>")

    def added_to(self, rows: DataFrame, key: str, **places: tuple[Column, bool]) -> DataFrame:
        """Add a column per entry of ``places``: how many cuts of the row's key lie before an instant (or on it, if the flag
        is set); 0 without cuts, and all cuts for a NULL instant."""
        if not self.cuts:
            return rows.withColumns({name: F.lit(0) for name in places})
        cut = rows.join(F.broadcast(self.frame(rows.sparkSession)), F.col(key) == F.col("_cut_key"), "left")
        found = {name: F.coalesce(_place(F.unix_micros(at), inclusive), F.lit(0)) for name, (at, inclusive) in places.items()}
        return cut.withColumns(found).drop("_cut_key", "cuts", "blocks")


def _place(micros: Column, inclusive: bool) -> Column:
    """Search in blocks of cuts, then in one block."""

    def before(cut: Column) -> Column:
        return cut <= micros if inclusive else cut < micros

    blocks = F.size(F.filter("blocks", before))
    first = (blocks - 1) * _BLOCK
    within = first + F.size(F.filter(F.slice("cuts", F.greatest(first, F.lit(0)) + 1, F.lit(_BLOCK)), before))
    return F.when(micros.isNull(), F.greatest(F.size("cuts"), F.lit(0))).when(blocks == 0, 0).otherwise(within)


def chosen_cuts(weights: list[tuple[int, int, int]], min_weight: int = MIN_WEIGHT) -> tuple[int, ...]:
    """From (instant, intervals that began since the place before, intervals that reach across), the instants to cut at."""
    cuts, begun = [], 0
    for instant, since, across in weights:
        begun += since
        if begun >= max(min_weight, across):
            cuts.append(instant)
            begun = 0
    return tuple(cuts)


def sampled_ranges(rows: DataFrame, key: str, start: Column, *, min_weight: int = MIN_WEIGHT, places: int = MAX_PLACES) -> Ranges:
    """About ``places`` cuts over all keys, at a hash sample of the distinct instants of keys with more than ``min_weight``
    rows, so that the ranges of a key hold about equally many instants."""
    rows = rows.select(F.col(key).alias("_key"), start.alias("start"))
    heavy = rows.groupBy("_key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > min_weight)
    starts = rows.select("_key", F.unix_micros("start").alias("at")).distinct().join(heavy.drop("n"), "_key")
    total = starts.count()
    if not total:
        return Ranges()
    most = (1 << 63) - 1
    share = most if places >= total else int((1 << 63) * (places / total))
    drawn = starts.where(F.xxhash64("_key", "at").bitwiseAND(F.lit(most)) <= share).select("_key", "at").collect()
    found = defaultdict(list)
    for name, at in sorted(drawn):
        found[name].append(at)
    return Ranges({name: tuple(cuts) for name, cuts in found.items()})


def equal_ranges(
    intervals: DataFrame, key: str, start: Column, end: Column, *, min_weight: int = MIN_WEIGHT, places: int = MAX_PLACES
) -> Ranges:
    """Ranges of valid intervals (``start`` before ``end``, or no end), from ``sampled_ranges`` of their starts and one
    count, which is of all intervals and exact."""
    drafted = sampled_ranges(intervals, key, start, min_weight=min_weight, places=places)
    if not drafted.cuts:
        return drafted
    rows = intervals.select(F.col(key).alias("_key"), start.alias("start"), end.alias("end"))
    placed = drafted.added_to(rows, "_key", first=(F.col("start"), True), last=(F.col("end"), False))
    begins = F.struct(F.col("first").alias("place"), F.lit(1).alias("since"), F.lit(1).alias("across"))
    ends = F.struct(F.col("last").alias("place"), F.lit(0).alias("since"), F.lit(-1).alias("across"))
    sampled = placed.join(F.broadcast(drafted.frame(rows.sparkSession)), F.col("_key") == F.col("_cut_key"), "left_semi")
    changes = sampled.select("_key", F.inline(F.array(begins, ends)))
    sums = changes.groupBy("_key", "place").agg(F.sum("since"), F.sum("across"))
    by_place: dict[str, dict[int, tuple[int, int]]] = defaultdict(dict)
    for name, place, since, across in sums.collect():
        by_place[name][place] = since, across
    cuts = {}
    for name, instants in drafted.cuts.items():
        weights, across = [], 0
        for place, instant in enumerate(instants):
            since, change = by_place[name].get(place, (0, 0))
            across += change
            weights.append((instant, since, across))
        cuts[name] = chosen_cuts(weights, min_weight)
    return Ranges({name: chosen for name, chosen in cuts.items() if chosen})
