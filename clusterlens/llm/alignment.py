"""Alignment of two tokenizers over the same bytes.

Both tokenizers begin anew at a single space between two other characters, so a text is a sequence of words that are
encoded and aligned once and remembered; what is new to a batch is encoded as one text. Where the words cannot be told,
both tokenizers encode the whole text. Where a token of either ends at the same byte and the next token of either begins
with a space, the document is split: such verified anchors cut it into windows of a few tokens, whose alignment depends
on their ids alone and is remembered by them; texts are taken many at a time, so a window that repeats is looked up once. Tokens whose bytes overlap are linked; places where both end form groups.

The links of a document are kept as distinct pairs of ids with their number, in a table in the shared folder. How many
documents hold a pair is then a plain aggregate over that table. Pairs held by many documents, at most
``FREQUENT_PAIRS`` of them, are broadcast back to the documents; all others are rare, and meet them in a shuffle that no
single key can dominate.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clusterlens.llm.common import settle, shared_folder

BYTE_VOCABULARY, PIECE_VOCABULARY = "byte_bpe_50k.tiktoken", "piece_bpe_32k.model"
FREQUENT_PAIRS = 1 << 19
_CODE_BITS = 15  # of the second id in the code of a pair, which fits 31 bits
_MEMO_WINDOWS = 150_000
_MEMO_TOKENS = 64  # longer windows are aligned anew each time
_BATCH_CHARACTERS = 2_000_000
# A single space between two other characters begins a token on both sides, whatever else is in the text.
_CUT = re.compile(r"(?<=\S) (?=\S)")

Key = tuple[int, ...]  # ids of the first side, -1, ids of the second
Window = tuple[str, int, bytes]  # text of the groups, their number, and the codes of the links as 32-bit numbers


@dataclass
class Tokenizers:
    """Encoders of text into ids, and the bytes of every id, for both sides."""

    encode_a: object
    encode_b: object
    bytes_a: list[bytes]
    bytes_b: list[bytes]

    def __post_init__(self) -> None:
        if len(self.bytes_b) > 1 << _CODE_BITS or len(self.bytes_a) > 1 << (31 - _CODE_BITS):
            raise ValueError("the vocabularies are too large for the code of a pair")
        self.lengths_a = np.array([len(token) for token in self.bytes_a], np.int64)
        self.lengths_b = np.array([len(token) for token in self.bytes_b], np.int64)
        self.flat_a, self.flat_b = (np.frombuffer(b"".join(table), np.uint8) for table in (self.bytes_a, self.bytes_b))
        self.begins_a, self.begins_b = np.cumsum(self.lengths_a) - self.lengths_a, np.cumsum(self.lengths_b) - self.lengths_b
        # every id as text with what follows it: inside and at the end of its side of a group
        sides = ((len(self.bytes_a), ",|"), (len(self.bytes_b), ",;"))
        self.parts = [f"{token}{mark}" for size, marks in sides for token in range(size) for mark in marks]
        # merges of the second side stay inside a word if no piece has a space after another character
        self.by_words = not any(b" " in token.lstrip(b" ") for token in self.bytes_b)
        self.marked_a = np.array([token.startswith(b" ") for token in self.bytes_a])
        self.marked_b = np.array([token.startswith(b" ") for token in self.bytes_b])


def _covers(ids: np.ndarray, lengths: np.ndarray, begins: np.ndarray, flat: np.ndarray, expected: np.ndarray) -> bool:
    """Whether the bytes of the ids are the expected ones."""
    sizes = lengths[ids]
    if sizes.sum() != len(expected):
        return False
    return bool((flat[np.repeat(begins[ids], sizes) + _in_window(sizes)] == expected).all())


def _piece_bytes(model: sentencepiece.SentencePieceProcessor, piece: int) -> bytes:
    text = model.id_to_piece(piece)
    return bytes([int(text[1:-1], 16)]) if model.is_byte(piece) else text.replace("▁", " ").encode()


_loaded: dict[tuple[str, str], Tokenizers] = {}


def load(path_a: str, path_b: str) -> Tokenizers:
    """Byte-level BPE from a file of base64 byte strings and ranks, and a SentencePiece model; special strings are text."""
    if (path_a, path_b) not in _loaded:
        with open(path_a, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        bpe = tiktoken.Encoding("a", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        model = sentencepiece.SentencePieceProcessor(model_file=path_b)
        bytes_a = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            bytes_a[rank] = token
        bytes_b = [_piece_bytes(model, piece) for piece in range(model.get_piece_size())]
        _loaded[path_a, path_b] = Tokenizers(bpe.encode_to_numpy, model.encode, bytes_a, bytes_b)
    return _loaded[path_a, path_b]


def align_windows(keys: list[Key], t: Tokenizers) -> list[Window]:
    """Alignment of each window; both sides of a window cover the same bytes.

    Between two neighbouring ends of tokens of either side lies a part of one token of each, which are linked. Ends of
    both sides end a group.
    """
    sizes = np.fromiter(map(len, keys), np.int64, len(keys))
    flat = np.fromiter(chain.from_iterable(keys), np.int64, sizes.sum())
    middle = np.flatnonzero(flat < 0)
    size_a = middle - (np.cumsum(sizes) - sizes)
    second = _in_window(sizes) > np.repeat(size_a, sizes)
    ids_a, ids_b = flat[~second & (flat >= 0)], flat[second]
    ends_a, ends_b = np.cumsum(t.lengths_a[ids_a]), np.cumsum(t.lengths_b[ids_b])
    ends, shared = np.union1d(ends_a, ends_b), np.intersect1d(ends_a, ends_b, assume_unique=True)
    links = ids_a[np.searchsorted(ends_a, ends)] << _CODE_BITS | ids_b[np.searchsorted(ends_b, ends)]
    codes = links.astype(np.int32).tobytes()

    # the text of a group: its ids of one side and then of the other, each with what follows it
    group_a, group_b = np.searchsorted(shared, ends_a), np.searchsorted(shared, ends_b)
    parts = np.empty(len(ids_a) + len(ids_b), np.int64)
    parts[np.arange(len(ids_a)) + np.searchsorted(group_b, group_a)] = 2 * ids_a + (ends_a == shared[group_a])
    last_b = 2 * (len(t.bytes_a) + ids_b) + (ends_b == shared[group_b])
    parts[np.arange(len(ids_b)) + np.searchsorted(group_a, group_b, "right")] = last_b
    texts = list(map(t.parts.__getitem__, parts.tolist()))

    window_ends = ends_a[np.cumsum(size_a) - 1]
    upto_text = np.cumsum(sizes - 1).tolist()
    upto_code = (4 * np.searchsorted(ends, window_ends, "right")).tolist()
    upto_group = np.searchsorted(shared, window_ends, "right")
    n_groups = np.diff(upto_group, prepend=0).tolist()
    cuts = zip([0, *upto_text], upto_text, [0, *upto_code], upto_code, n_groups, strict=False)
    return [("".join(texts[i:k])[:-1], n, codes[j:m]) for i, k, j, m, n in cuts]


@dataclass
class Memo:
    """Alignments by the ids of their windows, in two generations: what is met again outlives the next, and no more than
    ``2 * size`` are held. A worker keeps it over its tasks."""

    size: int = _MEMO_WINDOWS
    young: dict[Key, Window] = field(default_factory=dict)
    old: dict[Key, Window] = field(default_factory=dict)
    words: dict[str, Key] = field(default_factory=dict)
    old_words: dict[str, Key] = field(default_factory=dict)

    def aligned(self, keys: list[Key], t: Tokenizers) -> list[Window]:
        found = list(map(self.young.get, keys))
        unknown = [n for n, window in enumerate(found) if window is None]
        for n in unknown:
            found[n] = self.old.get(keys[n])
        missing = [n for n in unknown if found[n] is None]
        for n, window in zip(missing, align_windows([keys[n] for n in missing], t) if missing else [], strict=True):
            found[n] = window
        for n in unknown:
            if len(keys[n]) <= _MEMO_TOKENS:
                if len(self.young) >= self.size:
                    self.young, self.old = {}, self.young
                self.young[keys[n]] = found[n]
        return found

    def keys_of(self, words: list[str], t: Tokenizers) -> list[Key]:
        """``word_keys``, remembered likewise."""
        found = list(map(self.words.get, words))
        unknown = [n for n, key in enumerate(found) if key is None]
        for n in unknown:
            found[n] = self.old_words.get(words[n])
        missing = [n for n in unknown if found[n] is None]
        for n, key in zip(missing, word_keys([words[n] for n in missing], t), strict=True):
            found[n] = key
        for n in unknown:
            if len(words[n]) <= _MEMO_TOKENS:
                if len(self.words) >= self.size:
                    self.words, self.old_words = {}, self.words
                self.words[words[n]] = found[n]
        return found


@dataclass
class Aligned:
    n_a: int = 0
    n_b: int = 0
    n_groups: int = 0
    n_links: int = 0
    groups: str = ""
    codes: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int32))
    times: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int32))


def encoded(text: str | None, t: Tokenizers) -> tuple[np.ndarray, np.ndarray] | None:
    """Ids of both sides; None if the text is empty or the bytes of either side are not those of space and text."""
    if not text:
        return None
    whole = " " + text
    ids_a, ids_b = t.encode_a(whole).astype(np.int32), np.array(t.encode_b(text), np.int32)
    expected = np.frombuffer(whole.encode(), np.uint8)
    if not _covers(ids_b, t.lengths_b, t.begins_b, t.flat_b, expected):
        return None
    return (ids_a, ids_b) if _covers(ids_a, t.lengths_a, t.begins_a, t.flat_a, expected) else None


@dataclass
class Windows:
    """Windows over the ids of several texts: where each begins and how many ids it has, on both sides."""

    ids_a: np.ndarray
    ids_b: np.ndarray
    from_a: np.ndarray
    from_b: np.ndarray
    size_a: np.ndarray
    size_b: np.ndarray

    def keys(self, chosen: np.ndarray) -> list[Key]:
        size_a, size_b = self.size_a[chosen], self.size_b[chosen]
        ends = np.cumsum(size_a + 1 + size_b)
        begins = ends - size_a - 1 - size_b
        flat = np.full(ends[-1], -1, np.int32)
        in_a, in_b = _in_window(size_a), _in_window(size_b)
        flat[np.repeat(begins, size_a) + in_a] = self.ids_a[np.repeat(self.from_a[chosen], size_a) + in_a]
        flat[np.repeat(ends - size_b, size_b) + in_b] = self.ids_b[np.repeat(self.from_b[chosen], size_b) + in_b]
        ids = flat.tolist()
        return [tuple(ids[i:k]) for i, k in zip(begins.tolist(), ends.tolist(), strict=True)]


def windows(ids_a: np.ndarray, ids_b: np.ndarray, t: Tokenizers) -> Windows:
    """Cut where tokens of both sides begin with a space at the same byte, as the first ones of every text do."""
    starts, places = [], []
    for ids, lengths, marked in ((ids_a, t.lengths_a, t.marked_a), (ids_b, t.lengths_b, t.marked_b)):
        found = np.flatnonzero(marked[ids])
        sizes = lengths[ids]
        places.append(found)
        starts.append((np.cumsum(sizes) - sizes)[found])
    _, at_a, at_b = np.intersect1d(*starts, assume_unique=True, return_indices=True)
    from_a, from_b = places[0][at_a], places[1][at_b]
    return Windows(ids_a, ids_b, from_a, from_b, np.diff(from_a, append=len(ids_a)), np.diff(from_b, append=len(ids_b)))


_MIX = np.random.default_rng(42).integers(1, 1 << 63, 8192, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _in_window(sizes: np.ndarray) -> np.ndarray:
    """Position of every id in its window."""
    return np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)


def _same(ids: np.ndarray, begins: np.ndarray, sizes: np.ndarray, of: np.ndarray) -> np.ndarray:
    """Whether each window has the ids of the window ``of`` it."""
    others = np.minimum(np.arange(len(ids)) + np.repeat(begins[of] - begins, sizes), len(ids) - 1)
    return (sizes == sizes[of]) & np.logical_and.reduceat(ids == ids[others], begins)


def distinct_windows(w: Windows) -> tuple[np.ndarray, np.ndarray]:
    """One window of each kind, and the kind of every window. Windows meet by a hash, and their ids are then compared."""
    hashes = w.size_a.astype(np.uint64) * _MIX[0] + w.size_b.astype(np.uint64) * _MIX[1]
    for ids, begins, sizes, shift in ((w.ids_a, w.from_a, w.size_a, 2), (w.ids_b, w.from_b, w.size_b, 4096)):
        mixed = (ids.astype(np.uint64) + np.uint64(1)) * _MIX[shift + _in_window(sizes) % 4000]
        hashes += np.add.reduceat(mixed ^ (mixed >> np.uint64(32)), begins)
    _, chosen, kinds = np.unique(hashes, return_index=True, return_inverse=True)
    of = chosen[kinds]
    unlike = np.flatnonzero(~(_same(w.ids_a, w.from_a, w.size_a, of) & _same(w.ids_b, w.from_b, w.size_b, of)))
    kinds[unlike] = len(chosen) + np.arange(len(unlike))
    return np.concatenate([chosen, unlike]), kinds


def word_keys(words: list[str], t: Tokenizers) -> list[Key]:
    """Each word with a space before it as a window of its own, all encoded as one text; empty where the tokenizers do
    not cover its bytes."""
    ids = encoded(" ".join(words), t)
    if ids is None:
        if len(words) < 2:
            return [()] * len(words)
        half = len(words) // 2
        return word_keys(words[:half], t) + word_keys(words[half:], t)
    sizes = np.array([len(word.encode()) + 1 for word in words])
    begins, places = np.cumsum(sizes) - sizes, []
    for side, lengths in zip(ids, (t.lengths_a, t.lengths_b), strict=True):
        starts = np.cumsum(lengths[side]) - lengths[side]
        places.append(np.searchsorted(starts, begins))
        if (starts[np.minimum(places[-1], len(starts) - 1)] != begins).any():
            raise ValueError("a token spans words")
    (ids_a, ids_b), (from_a, from_b) = ids, places
    w = Windows(ids_a, ids_b, from_a, from_b, np.diff(from_a, append=len(ids_a)), np.diff(from_b, append=len(ids_b)))
    return w.keys(np.arange(len(words)))


def align(texts: list[str | None], t: Tokenizers, memo: Memo) -> list[Aligned]:
    """Alignments of texts: by their words where these can be told, else whole.

    Between words lies a single space, at which both tokenizers begin anew, so their alignments follow one another.
    """
    split = [_CUT.split(text) if t.by_words and text and "▁" not in text and text == text.strip() else None for text in texts]
    distinct = list(dict.fromkeys(chain.from_iterable(words for words in split if words)))
    keys = {word: key for word, key in zip(distinct, memo.keys_of(distinct, t), strict=True) if key}
    known = {}
    for (word, key), (groups, n_groups, codes) in zip(keys.items(), memo.aligned(list(keys.values()), t), strict=True):
        n_a = key.index(-1)
        known[word] = groups, codes, n_a, len(key) - n_a - 1, n_groups
    found: list[Aligned | None] = []
    for words in split:
        parts = list(map(known.get, words)) if words else [None]
        if None in parts:
            found.append(None)
            continue
        groups, codes, n_a, n_b, n_groups = zip(*parts, strict=True)
        links = np.frombuffer(b"".join(codes), np.int32)
        pairs, times = np.unique(links, return_counts=True)
        found.append(Aligned(sum(n_a), sum(n_b), sum(n_groups), len(links), ";".join(groups), pairs, times))
    whole = [n for n, aligned in enumerate(found) if aligned is None]
    for n, aligned in zip(whole, align_whole([texts[n] for n in whole], t, memo), strict=True):
        found[n] = aligned
    return found


def align_whole(texts: list[str | None], t: Tokenizers, memo: Memo) -> list[Aligned]:
    """Alignments of texts, each encoded as a whole. Their windows are looked up together, those that repeat once."""
    found = [Aligned() for _ in texts]
    usable = [(n, *ids) for n, text in enumerate(texts) if (ids := encoded(text, t))]
    if not usable:
        return found
    w = windows(np.concatenate([a for _, a, _ in usable]), np.concatenate([b for _, _, b in usable]), t)
    chosen, kinds = distinct_windows(w)
    groups, counts, links = zip(*memo.aligned(w.keys(chosen), t), strict=True)

    sizes = np.fromiter(map(len, links), np.int64, len(links)) // 4
    begins, flat = np.cumsum(sizes) - sizes, np.frombuffer(b"".join(links), np.int32)
    per_window = sizes[kinds]
    codes = flat[np.repeat(begins[kinds], per_window) + _in_window(per_window)]
    ends = np.concatenate([[0], np.cumsum(per_window)])
    n_groups = np.concatenate([[0], np.cumsum(np.array(counts)[kinds])])
    order = kinds.tolist()
    upto = np.searchsorted(w.from_a, np.cumsum([len(a) for _, a, _ in usable])).tolist()  # windows up to the end of each text
    for (n, ids_a, ids_b), low, high in zip(usable, [0, *upto], upto, strict=False):
        pairs, times = np.unique(codes[ends[low] : ends[high]], return_counts=True)
        text = ";".join([groups[kind] for kind in order[low:high]])
        n_links = int(ends[high] - ends[low])
        found[n] = Aligned(len(ids_a), len(ids_b), int(n_groups[high] - n_groups[low]), n_links, text, pairs, times)
    return found


_SCHEMA = (
    "doc_id {0}, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, codes array<int>, times array<int>"
)
_NAMES = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "codes", "times"]


def _batch(names: list, found: list[Aligned], kind: pa.DataType) -> pa.RecordBatch:
    def lists(parts: list[np.ndarray]) -> pa.Array:
        offsets = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(parts).astype(np.int32)))

    columns = [pa.array(names, kind)]
    columns += [pa.array([getattr(a, n) for a in found], pa.int64()) for n in _NAMES[1:5]]
    columns.append(pa.array([hashlib.sha256(a.groups.encode()).hexdigest() if a.groups else "" for a in found], pa.string()))
    columns += [lists([a.codes for a in found]), lists([a.times for a in found])]
    return pa.RecordBatch.from_arrays(columns, _NAMES)


def token_links(
    docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", path_a: str | None = None, path_b: str | None = None
) -> DataFrame:
    """One row per document: ``doc_id``, ``n_a``, ``n_b``, ``n_groups``, ``n_links``, ``groups_sha256``, and its distinct
    linked pairs as ``codes`` (see ``ids_of``) with the number of links of each in ``times``.

    Texts that are NULL, empty, or not covered byte by byte by both tokenizers have no tokens: zeros, an empty digest and
    no pairs. Rows with a NULL or repeated id are rows like any other. Other columns play no part.
    """
    path_a = path_a or public_tokenizers.path(BYTE_VOCABULARY)
    path_b = path_b or public_tokenizers.path(PIECE_VOCABULARY)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizers, memo = load(path_a, path_b), _memos.setdefault((path_a, path_b), Memo())
        for batch in batches:
            names, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            begin = held = 0
            for n, text in enumerate(texts, start=1):
                held += len(text or "")
                if held > _BATCH_CHARACTERS or n == len(texts):
                    yield _batch(names[begin:n], align(texts[begin:n], tokenizers, memo), batch.schema.field(0).type)
                    begin, held = n, 0

    kind = docs.schema[doc_id].dataType.simpleString()
    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    return rows.mapInArrow(run, _SCHEMA.format(kind))


_memos: dict[tuple[str, str], Memo] = {}


def ids_of(code: F.Column) -> tuple[F.Column, F.Column]:
    """The ids of both sides in the code of a pair."""
    return F.shiftright(code, _CODE_BITS), code.bitwiseAND(F.lit((1 << _CODE_BITS) - 1))


def pair_counts(links: DataFrame) -> DataFrame:
    """``code``, ``count`` (documents that hold the pair linked) and ``best`` (no pair of its first id has a higher count).

    The highest counts are one row per id of the first vocabulary, at most 65,536, and so are broadcast.
    """
    counts = links.select(F.explode("codes").alias("code")).groupBy("code").agg(F.count(F.lit(1)).alias("count"))
    counts = settle(counts.withColumn("id_a", ids_of(F.col("code"))[0]))
    highest = counts.groupBy("id_a").agg(F.max("count").alias("highest"))
    best = (F.col("count") == F.col("highest")).alias("best")
    return counts.join(F.broadcast(highest), "id_a").select("code", "count", best)


def _frequent_from(pairs: DataFrame, most: int) -> int:
    """The least power of two that at most ``most`` pairs reach with their count."""
    size = F.length(F.bin("count"))
    total, least = 0, None
    for bits, n in sorted(pairs.groupBy(size.alias("bits")).agg(F.count(F.lit(1)).alias("n")).collect(), reverse=True):
        least = 1 << bits if least is None else least
        total += n
        if total > most:
            break
        least = 1 << (bits - 1)
    return least or 1


def alignment(docs: DataFrame, *, frequent_pairs: int = FREQUENT_PAIRS, **options: str) -> DataFrame:
    """``token_links`` without its pairs, and over all links of a document ``n_best`` (links to a partner that the first
    id has in most documents, ties included) and ``count_sum`` (documents that hold the pair, summed).

    ``options`` are those of ``token_links``. The links are written to the shared folder, and the result reads them.
    """
    spark = docs.sparkSession
    folder = f"{shared_folder(spark).rstrip('/')}/alignment-{uuid.uuid4().hex}"
    token_links(docs, **options).withColumn("row_id", F.monotonically_increasing_id()).write.parquet(folder)
    links = spark.read.parquet(folder)
    pairs = settle(pair_counts(links))
    least = _frequent_from(pairs, frequent_pairs)
    frequent, rare = F.broadcast(pairs.where(F.col("count") >= least)), pairs.where(F.col("count") < least)

    held = links.select("row_id", F.explode(F.arrays_zip("codes", "times")).alias("link"))
    held = held.select("row_id", F.col("link.codes").alias("code"), F.col("link.times").alias("times"))
    sums = [
        F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"),
        F.sum(F.col("count") * F.col("times")).alias("count_sum"),
    ]
    of_frequent = held.join(frequent, "code").groupBy("row_id").agg(*sums)
    both = of_frequent
    if least > 1:
        left = held.join(frequent.select("code"), "code", "left_anti")
        of_rare = left.join(rare.hint("merge"), "code").groupBy("row_id").agg(*sums)
        totals = [F.sum(name).alias(name) for name in ("n_best", "count_sum")]
        both = of_frequent.unionByName(of_rare).groupBy("row_id").agg(*totals)
    zero = [F.coalesce(F.col(name), F.lit(0)).cast("bigint").alias(name) for name in ("n_best", "count_sum")]
    return (
        links.drop("codes", "times")
        .join(both, "row_id", "left")
        .select("doc_id", "n_a", "n_b", "n_groups", "n_links", *zero, "groups_sha256")
    )
