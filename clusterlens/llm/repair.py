"""Repair of conversation structure as the lightest derivation of a weighted deduction system.

A repaired conversation is empty, or an optional system turn followed by pairs of a user and an assistant turn. Items say
how many rows have been read and in which state the output is; rules keep, rename, delete or insert a turn:

    P(i, q), Row(i) |- P(i + 1, q')    keep, rerole or delete row i
    P(i, q)         |- P(i, q')        insert a turn
    P(n, q)         |- Goal            if the output may end in q

The value of an item is (cost, audit), the audit being the initials of its edits. A rule adds to the cost and appends to
the audit, so it is monotone and never lowers a value (the rows are axioms of value zero); hence Knuth's generalisation
of shortest paths applies: the agenda pops items by value, and a popped item is final. Two derivations of one item with
equal cost never have an audit that is the beginning of the other, as it would lack an insertion, so the order of
audits survives what is appended.

Rows of a conversation arrive sorted and are read in segments: all items at the end of a segment are made final, and are
the axioms of the next. So memory is bounded by a segment and the audits, not by the texts of a conversation; each item
carries the hash of its output. One conversation is still read by one task, as its hash is of one sequence.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from heapq import heappop, heappush
from itertools import groupby, islice
from operator import itemgetter
from os.path import commonprefix

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

KEEP, REROLE, DELETE, INSERT = "K", "R", "D", "I"
RENAME_COST, DELETE_COST, INSERT_COST, TRUNCATED_COST = 1, 2, 5, 5
SEGMENT_ROWS, SEGMENT_BYTES = 512, 4 * 1024 * 1024

FINE, BLANK, DUPLICATE, TRUNCATED = range(4)

# Output so far: nothing, a system turn, ends with a user turn, ends with an assistant turn.
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
_AFTER = {(NOTHING, "s"): SYSTEM, (NOTHING, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
_ENDS = (NOTHING, ASSISTANT)
_LEGAL = ("su", "ua", "au")
_ROLES = {"u": "user", "a": "assistant"}

_BLANKS = " \t\n\x0b\x0c\r"


def _wanted(state: int) -> str:
    """Initial of the only turn that may be renamed or inserted here."""
    return "a" if state == USER else "u"


@dataclass
class Row:
    role: str
    text: str
    fault: int


@dataclass
class Lane:
    """The best derivation of one state at the start of a segment, with what it has put out."""

    cost: int = 0
    audit: str = ""  # without the beginning that all lanes share
    output: object = field(default_factory=hashlib.sha256)
    any_output: bool = False


def edits(rows: list[Row], lanes: dict[int, tuple[int, str]], last: bool) -> dict[int, tuple[int, str, int]]:
    """Cost, audit and first state of the lightest derivation of each state after ``rows``; if ``last``, of the one
    final state that derives the goal most lightly.

    ``lanes`` holds cost and audit of each state before them.
    """
    agenda: list[tuple[int, str, int, int, int]] = []
    for state, (cost, audit) in lanes.items():
        heappush(agenda, (cost, audit, 0, state, state))
    final: set[tuple[int, int]] = set()
    found: dict[int, tuple[int, str, int]] = {}
    n = len(rows)
    while agenda:
        cost, audit, i, state, origin = heappop(agenda)
        if i > n:  # the goal
            return {state: (cost, audit, origin)}
        if (i, state) in final:
            continue
        final.add((i, state))
        wanted = _wanted(state)
        heappush(agenda, (cost + INSERT_COST, audit + INSERT, i, _AFTER[state, wanted], origin))
        if i == n:
            found[state] = cost, audit, origin
            if last and state in _ENDS:
                heappush(agenda, (cost, audit, n + 1, state, origin))
            continue
        row = rows[i]
        heappush(agenda, (cost + DELETE_COST, audit + DELETE, i + 1, state, origin))
        if row.fault in (BLANK, DUPLICATE):
            continue
        stays = cost + TRUNCATED_COST * (row.fault == TRUNCATED)
        heappush(agenda, (stays + RENAME_COST, audit + REROLE, i + 1, _AFTER[state, wanted], origin))
        kept = _AFTER.get((state, row.role[:1]))
        if kept is not None:
            heappush(agenda, (stays, audit + KEEP, i + 1, kept, origin))
    return found


def replay(rows: Iterable[Row], audit: str, state: int = NOTHING) -> Iterator[tuple[str, str, str]]:
    """Edit, role and text of each turn that the edits put out. Deleted rows put out nothing."""
    rows = iter(rows)
    for edit in audit:
        if edit == INSERT:
            role, text = _ROLES[_wanted(state)], ""
        else:
            row = next(rows)
            if edit == DELETE:
                continue
            role, text = (row.role if edit == KEEP else _ROLES[_wanted(state)]), row.text
        state = _AFTER[state, role[:1]]
        yield edit, role, text


def shortened(audits: list[str]) -> list[str]:
    """Short texts that compare like the audits of the lanes, whatever is appended: of what several of them share, and of
    what only one has after it has left the others, one character is kept.

    An audit that is the beginning of another is followed there by insertions only, and these are kept.
    """
    if "" in audits:
        return audits
    found = {}
    for first in {audit[0] for audit in audits}:
        group = [audit for audit in audits if audit[0] == first]
        shared = len(commonprefix(group))
        rest = shortened([audit[shared:] for audit in group]) if len(group) > 1 else [""]
        found |= {audit: first + tail for audit, tail in zip(group, rest, strict=True)}
    return [found[audit] for audit in audits]


class Repair:
    """Reads the rows of one conversation and finds its cheapest edits, segment by segment."""

    def __init__(self, segment_rows: int = SEGMENT_ROWS, segment_bytes: int = SEGMENT_BYTES) -> None:
        self.segment_rows, self.segment_bytes = segment_rows, segment_bytes
        self.settled: list[str] = []
        self.lanes = {NOTHING: Lane()}
        self.rows: list[Row] = []
        self.held = 0

    def add(self, row: Row) -> None:
        if len(self.rows) >= self.segment_rows or self.held >= self.segment_bytes:
            self._advance(last=False)
        self.rows.append(row)
        self.held += len(row.text)

    def _advance(self, last: bool) -> None:
        short = dict(zip(self.lanes, shortened([lane.audit for lane in self.lanes.values()]), strict=True))
        found = edits(self.rows, {state: (lane.cost, short[state]) for state, lane in self.lanes.items()}, last)
        lanes = {}
        for state, (cost, audit, origin) in found.items():
            before, new = self.lanes[origin], audit[len(short[origin]) :]
            output, any_output = before.output.copy(), before.any_output
            for _, role, text in replay(self.rows, new, origin):
                output.update(b"\n" * any_output + f"{role}:{text}".encode())
                any_output = True
            lanes[state] = Lane(cost, before.audit + new, output, any_output)
        shared = commonprefix([lane.audit for lane in lanes.values()])
        for lane in lanes.values():
            lane.audit = lane.audit[len(shared) :]
        self.settled.append(shared)
        self.lanes, self.rows, self.held = lanes, [], 0

    def finish(self) -> tuple[int, str, str]:
        """Cost, audit, and SHA-256 of the repaired turns, ``role:text`` joined by newlines."""
        self._advance(last=True)
        [lane] = self.lanes.values()
        return lane.cost, "".join(self.settled), lane.output.hexdigest()


def _trimmed(text: Column) -> Column:
    return F.rtrim(text, F.lit(_BLANKS))


def with_faults(rows: DataFrame) -> DataFrame:
    """Add ``fault``, the first that holds: blank, a repeat of an earlier row of the conversation, or truncated.

    Rows are in the order of their turn, NULLs first, then role and text. Only rows that exist count as earlier. After one
    shuffle by conversation, repeats are found by sorting, which spills.
    """
    earlier = Window.partitionBy("conv_id", "exists", "role", "text").orderBy("turn")
    trimmed = _trimmed(F.col("text"))
    fault = (
        F.when(trimmed == "", BLANK)
        .when(F.row_number().over(earlier) > 1, DUPLICATE)
        .when(~F.right(trimmed, F.lit(1)).isin(".", "!", "?"), TRUNCATED)
        .otherwise(FINE)
    )
    return rows.repartition("conv_id").withColumn("fault", fault)


_COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
_MOST = (1 << 63) - 1


def _stream(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(column.to_pylist() for column in batch.columns), strict=True)


def _batches(rows: Iterable[tuple], names: list[str], types: list[pa.DataType]) -> Iterator[pa.RecordBatch]:
    rows = iter(rows)
    while held := list(islice(rows, 1000)):
        columns = zip(zip(*held, strict=True), types, strict=True)
        yield pa.RecordBatch.from_arrays([pa.array(values, kind) for values, kind in columns], names)


def _report(rows: Iterable[tuple], segment_rows: int) -> tuple:
    """Counts, cost, audit and hash of the rows (turn, role, text, fault, exists) of one conversation."""
    repair = Repair(segment_rows)
    faults = [0] * 4
    lowest = highest = previous = None
    turns = illegal = 0
    initial = None
    for turn, role, text, fault, exists in rows:
        if not exists:
            continue
        faults[fault] += 1
        if turn is not None:
            turns += turn != previous
            lowest = turn if lowest is None else lowest
            highest = previous = turn
        illegal += initial is not None and initial + role[:1] not in _LEGAL
        initial = role[:1]
        repair.add(Row(role, text, fault))
    gaps = 0 if lowest is None else min(highest - lowest + 1 - turns, _MOST)
    return gaps, *faults[BLANK:], illegal, *repair.finish()


def _prepared(rows: DataFrame, exists: Column | None) -> DataFrame:
    """The columns in use; a NULL role or text is one space."""
    known = F.lit(True) if exists is None else F.coalesce(exists, F.lit(False))
    texts = [F.coalesce(F.col(name).cast("string"), F.lit(" ")).alias(name) for name in ("role", "text")]
    return rows.select("conv_id", F.col("turn").cast("bigint").alias("turn"), *texts, known.alias("exists"))


def repair(rows: DataFrame, *, exists: Column | None = None, segment_rows: int = SEGMENT_ROWS) -> DataFrame:
    """One row per ``conv_id`` of ``rows`` (``conv_id``, ``turn``, ``role``, ``text``), NULL being one conversation.

    ``gaps`` counts turn numbers missing between the least and the greatest, ``blank``, ``duplicate`` and ``truncated``
    rows by their first fault, ``illegal`` neighbours that no conversation may hold. ``cost`` and ``audit`` are those of the
    cheapest edits, of equal ones the least in the order of characters; ``repaired_sha256`` is the hash of what they leave.

    Rows are taken by turn, NULLs first, then role and text, so ties and repeated rows have one order. A role other than
    those of the pattern, an empty one included, cannot be kept as it is. Rows for which ``exists`` is false or NULL only
    name their conversation: without others it gets zeros, an empty audit and the hash of nothing. An empty table has no
    rows. Other columns play no part.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups = groupby(_stream(batches), key=itemgetter(0))
        yield from _batches(((c, *_report((row[1:] for row in group), segment_rows)) for c, group in groups), names, types)

    names = ["conv_id", *_COUNTS, "audit", "repaired_sha256"]
    key = rows.schema["conv_id"].dataType
    types = [to_arrow_type(key), *[pa.int64()] * len(_COUNTS), pa.string(), pa.string()]
    schema = f"conv_id {key.simpleString()}, {', '.join(f'{n} bigint' for n in _COUNTS)}, audit string, repaired_sha256 string"
    marked = with_faults(_prepared(rows, exists))
    ordered = marked.sortWithinPartitions("conv_id", "turn", "role", "text")
    return ordered.select("conv_id", "turn", "role", "text", "fault", "exists").mapInArrow(run, schema)


def repaired_turns(rows: DataFrame, report: DataFrame) -> DataFrame:
    """The repaired conversations themselves: ``conv_id``, ``position`` from 0, ``role``, ``text``, and the ``edit`` behind
    each turn (K, R or I). ``report`` is what ``repair`` found for the same rows.

    The audit of a conversation is sent ahead of its rows, so both are read once and nothing is held but the audit.
    """
    nothing = F.lit(None).cast("string")
    audits = report.select(
        "conv_id", F.lit(None).cast("bigint").alias("turn"), F.col("audit").alias("role"), nothing.alias("text"), F.lit(False).alias("exists")
    )
    both = audits.unionByName(_prepared(rows, None)).repartition("conv_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _batches(turns(groupby(_stream(batches), key=itemgetter(0))), names, types)

    def turns(groups: Iterator[tuple]) -> Iterator[tuple]:
        for conv_id, group in groups:
            audit = next(group)[2]
            rows_left = (Row(role, text, FINE) for _, _, role, text, _ in group)
            for position, (edit, role, text) in enumerate(replay(rows_left, audit)):
                yield conv_id, position, role, text, edit

    key = rows.schema["conv_id"].dataType
    names = ["conv_id", "position", "role", "text", "edit"]
    types = [to_arrow_type(key), pa.int64(), pa.string(), pa.string(), pa.string()]
    schema = f"conv_id {key.simpleString()}, position bigint, role string, text string, edit string"
    ordered = both.sortWithinPartitions("conv_id", "exists", "turn", "role", "text")
    return ordered.select("conv_id", "turn", "role", "text", "exists").mapInArrow(run, schema)


def damage(rows: DataFrame) -> DataFrame:
    """Conversations with faults by a hash of conversation and turn: of twenty, one row each is dropped (``exists`` is
    false), emptied, stripped of ends of sentences, repeated, or set to the role of the user. NULLs become one space.
    """
    shown = [F.coalesce(F.col(name).cast("string"), F.lit(" ")) for name in ("conv_id", "turn", "role", "text")]
    kind = F.crc32(F.concat(shown[0], F.lit(":"), shown[1]).cast("binary")) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.translate(shown[3], ".!?", "")).otherwise(shown[3])
    role = F.when(kind == 4, "user").otherwise(shown[2])
    copies = F.array_repeat(kind != 0, F.when(kind == 3, 2).otherwise(1))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(copies).alias("exists"))
