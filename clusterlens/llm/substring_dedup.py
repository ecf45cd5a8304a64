"""Substring dedup by sliding sentence spans.

Runs of consecutive sentences are hashed: from each sentence on, and up to each sentence, the shortest run of at least
``RUN`` sentences and ``MIN_WORDS`` words. Shorter runs are left alone: short phrases recur by chance. Hashes meet in one
aggregation over the whole corpus; of runs that occur more than once, all but the first are repeats, and the sentences
they cover are removed. Longer repeated passages are unions of overlapping runs. The first occurrence is the one with the
smallest document id, and the earliest there.

Sentences end at ``.``, ``!`` or ``?`` before white space, at their full-width forms, and at line ends. A sentence of more
than ``LONGEST`` words is cut where a hash of the last two words says so, so that the same words are cut at the same
places whatever stands before them, and ``LONGEST`` words after the last cut if none came. In scripts without spaces two
characters count as a word.

Occurrences of a run are combined before they are shuffled, the join that finds the repeats can split a hot run, and no
run gathers its occurrences anywhere. Texts move only if the list of cuts is too long to broadcast.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import accumulate
from zlib import crc32

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clusterlens.llm.common import fits_broadcast, settle, spread_join

RUN, LONGEST, MIN_WORDS = 2, 16, 10
# A long sentence is cut after one in so many words, or in twice as many characters of a script without spaces.
CUT_EVERY = 8
# Of a document's cuts in a broadcast table: key, headers and pointers, and each place.
_CUT_BYTES, _PLACE_BYTES = 104, 4

# Thai, Lao, Burmese, Khmer, kana and Han
_UNSPACED = "\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff"
_BREAK = re.compile(r"(?<=[.!?])\s+|\n\s*|(?<=[。！？｡])(?![。！？｡」』”’）])\s*")
_TOKEN = re.compile(rf"[{_UNSPACED}]|[^\s{_UNSPACED}]+")
_CHARACTER = re.compile(f"[{_UNSPACED}]")


def _half_words(text: str) -> int:
    """Twice the number of words, where a character of a script without spaces is half a word."""
    if text.isascii() or not _CHARACTER.search(text):
        return 2 * len(text.encode().split())
    return sum(1 if _CHARACTER.match(token) else 2 for token in _TOKEN.findall(text))


def _cuts(text: str, start: int, end: int) -> list[int]:
    """Where a sentence of more than ``LONGEST`` words is cut: at tokens, by the two before."""
    tokens = [(m.start(), m.group()) for m in _TOKEN.finditer(text, start, end)]
    spaced = text.isascii() or not _CHARACTER.search(text, start, end)
    sizes = [2] * len(tokens) if spaced else [1 if _CHARACTER.match(token) else 2 for _, token in tokens]
    if sum(sizes) <= 2 * LONGEST:
        return []
    cuts, since, before, due = [], 0, None, False
    for (at, token), size in zip(tokens, sizes, strict=True):
        if due or since + size > 2 * LONGEST:
            cuts.append(at)
            since = 0
        since += size
        word = token.encode().lower()
        due = before is not None and crc32(word, before) % (CUT_EVERY * 2 // size) == 0
        before = crc32(word)
    return cuts


def sentences(text: str) -> list[tuple[int, int]]:
    """Spans of the sentences of a text, white space after them included; together they are the whole text."""
    ends = [m.end() for m in _BREAK.finditer(text) if m.end() < len(text)]
    spans: list[tuple[int, int]] = []
    start = 0
    for end in [*ends, len(text)]:
        if end - start > 2 * LONGEST:
            for cut in _cuts(text, start, end):
                spans.append((start, cut))
                start = cut
        if end > start:
            spans.append((start, end))
        start = end
    return spans


def _runs(sizes: list[int], run: int) -> list[tuple[int, int]]:
    """The first and the end of every shortest run from or up to a sentence, in order; ``sizes`` in half words."""
    sums = [0, *accumulate(sizes)]
    found = set()
    end = 0
    for start in range(len(sizes)):
        end = max(end, start + run)
        while end <= len(sizes) and sums[end] - sums[start] < 2 * MIN_WORDS:
            end += 1
        if end > len(sizes):
            break
        found.add((start, end))
    start = len(sizes)
    for end in range(len(sizes), 0, -1):
        start = min(start, end - run)
        while start >= 0 and sums[end] - sums[start] < 2 * MIN_WORDS:
            start -= 1
        if start < 0:
            break
        found.add((start, end))
    return sorted(found)


def run_hashes(text: str, run: int = RUN) -> list[int]:
    """A signed 64-bit hash of each run, after lower-casing A-Z and joining words by single spaces."""
    pieces = [text[a:b] for a, b in sentences(text)]
    joined = [b" ".join(piece.encode().lower().split()) for piece in pieces]
    hashes: list[int] = []
    for start, end in _runs([_half_words(piece) for piece in pieces], run):
        value = xxhash.xxh64_intdigest(b" ".join(joined[start:end]))
        hashes.append(value - (1 << 64) if value >> 63 else value)
    return hashes


def without(text: str, repeated: list[int], run: int = RUN) -> tuple[str, int]:
    """The text without the sentences under these of its runs, and how many sentences that takes."""
    spans = sentences(text)
    runs = _runs([_half_words(text[a:b]) for a, b in spans], run)
    gone = {i for at in repeated for i in range(*runs[at])}
    return "".join([text[a:b] for i, (a, b) in enumerate(spans) if i not in gone]), len(gone)


def _text_hash(text: str) -> Column:
    return F.xxhash64(F.coalesce(F.col(f"`{text}`"), F.lit("")))


def repeats(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``cut_id``, ``cut_hash`` (of the text) and ``at``: the numbers of the non-first runs of each document that has any.

    Rows that repeat an id and its text are one document here. NULL ids come after all others. NULL and empty texts have
    no runs.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes = pa.array([run_hashes(t) for t in batch.column(2).to_pylist()], pa.list_(pa.int64()))
            columns = [batch.column(0), batch.column(1), hashes]
            yield pa.RecordBatch.from_arrays(columns, names=["cut_id", "cut_hash", "runs"])

    texts = docs.select(
        F.col(f"`{doc_id}`").cast("bigint").alias("cut_id"), _text_hash(text).alias("cut_hash"), F.col(f"`{text}`").alias("body")
    ).where(F.octet_length("body") > 0)
    hashed = settle(texts.mapInArrow(run, "cut_id bigint, cut_hash bigint, runs array<bigint>"))
    runs = hashed.select("cut_id", "cut_hash", F.posexplode("runs").alias("at", "run"))
    place = F.struct(F.col("cut_id").isNull().alias("last"), "cut_id", "cut_hash", "at")
    first = runs.groupBy("run").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("run", "first")
    later = spread_join(runs, first, "run").where(place != F.col("first"))
    return later.groupBy("cut_id", "cut_hash").agg(F.sort_array(F.collect_set("at")).alias("at"))


def drop_repeats(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", removed: str | None = None) -> DataFrame:
    """``docs`` with the repeated sentences taken out of ``text``; every row stays, with an empty text if need be.

    A column ``n_chars``, if there is one, is brought up to date where the text changes. ``removed`` names an extra
    column for the number of sentences taken out. A NULL text stays NULL.
    """
    cuts = settle(repeats(docs, doc_id=doc_id, text=text))
    n, places = cuts.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size("at")), F.lit(0))).first()
    if fits_broadcast(1, n * _CUT_BYTES + places * _PLACE_BYTES):
        cuts = F.broadcast(cuts)
    same = F.col(f"_d.{doc_id}").cast("bigint").eqNullSafe(F.col("_c.cut_id")) & (F.col("_hash") == F.col("_c.cut_hash"))
    joined = docs.withColumn("_hash", _text_hash(text)).alias("_d").join(cuts.alias("_c"), same, "left")

    @F.pandas_udf("text string, n int")
    def cut(texts, places):  # noqa: ANN001, ANN202
        import pandas as pd

        return pd.DataFrame([without(t, p.tolist()) for t, p in zip(texts, places, strict=True)], columns=["text", "n"])

    changed = F.col("_c.at").isNotNull()
    touched = joined.where(changed).withColumn("_cut", cut(F.col(f"_d.`{text}`"), F.col("_c.at")))
    whole = joined.where(~changed)

    def columns(new_text: Column | None, count: Column) -> list[Column]:
        result = []
        for name in docs.columns:
            value = F.col(f"_d.`{name}`")
            if new_text is not None and name == text:
                value = new_text
            elif new_text is not None and name == "n_chars":
                value = F.char_length(new_text).cast(docs.schema[name].dataType)
            result.append(value.alias(name))
        return result if removed is None else [*result, count.alias(removed)]

    return whole.select(columns(None, F.lit(0))).unionByName(touched.select(columns(F.col("_cut.text"), F.col("_cut.n"))))
