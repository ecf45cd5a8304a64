"""SentencePiece encoding and decoding with the N best segmentations.

A text is a lattice: an edge for every vocabulary piece at every place where it fits, and its score is the sum of the
edges' scores. A forward Viterbi pass gives the best score from the start to every place. That is the exact remainder
for a search that walks backward from the end, so A-star by known suffix plus best prefix pops complete segmentations in
falling order of score, each after at most one descent through the text.

The lattice of a text is cut where no piece of the vocabulary spans, mostly at word boundaries. Words repeat, so each
worker keeps what the forward pass found for those it has seen: the best segmentation, and how much the second best
loses. Among the N best of a text, only the words with the N - 1 smallest losses can differ from their best; these are
searched backward, and their alternatives are combined by the same best-first search.

Spaces are written as U+2581 with one in front of the text, as the model's identity normaliser does. A character that is
no piece is spelled in byte pieces, at a penalty. Scoring follows the piece scores of the model file as a unigram lattice.
"""

from __future__ import annotations

import gc
import heapq
import struct
from array import array
from collections.abc import Iterator
from functools import cache
from operator import itemgetter

import public_tokenizers
import pyarrow as pa
import regex
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MODEL = "piece_bpe_32k.model"
N_BEST = 2
SPACE = "▁"
UNKNOWN_PENALTY = 10
# A generation of a worker's caches has at most so many words; results do not depend on it.
MAX_CACHED_WORDS = 300_000

# No piece has U+2581 after another character (`Vocabulary` checks that), so a text may be cut before every run of it.
_WORD = regex.compile(rf"{SPACE}*[^{SPACE}]+|{SPACE}+")
_PART = regex.compile(rf"{SPACE}*\p{{L}}+|{SPACE}*[^{SPACE}\p{{L}}]+|{SPACE}+")

# The best segmentations of a word, best first: score and ids as little-endian unsigned 32-bit integers.
Segmentations = list[tuple[int, bytes]]
# Best score, its ids, and by how much the second best score is lower.
Best = tuple[int, bytes, int]
Node = dict[str, tuple["Node", int | None, bytes]]
_NEVER, _NONE = -(1 << 60), 1 << 50
_SCORE, _IDS, _LOSS = itemgetter(0), itemgetter(1), itemgetter(2)


class Surfaces:
    """The bytes of every piece: all that decoding needs."""

    def __init__(self, model: sentencepiece.SentencePieceProcessor) -> None:
        self.bytes: list[bytes] = []
        for i in range(model.get_piece_size()):
            if model.is_byte(i):
                self.bytes.append(bytes([int(model.id_to_piece(i)[3:5], 16)]))
            elif model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
                self.bytes.append(b"")
            else:
                self.bytes.append(model.id_to_piece(i).encode())

    def decode(self, ids: bytes) -> str:
        """The text of a segmentation. Bytes that are no UTF-8 become U+FFFD; control pieces are empty."""
        parts = map(self.bytes.__getitem__, array("I", ids))
        return b"".join(parts).decode("utf-8", "replace").replace(SPACE, " ").removeprefix(" ")


class Vocabulary:
    def __init__(self, model: sentencepiece.SentencePieceProcessor) -> None:
        self.byte_ids: dict[int, int] = {}
        self.pieces: dict[str, tuple[int, bytes]] = {}
        for i in range(model.get_piece_size()):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.byte_ids[int(piece[3:5], 16)] = i
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                score = model.get_score(i)
                if score != int(score):
                    raise ValueError("the scores of this vocabulary are no whole numbers, as those of BPE are")
                self.pieces[piece] = (int(score), struct.pack("<I", i))
        self.root, self.backward = self._trie(1), self._trie(-1)
        self.longest = max(map(len, self.pieces), default=1)
        self.joined = {p[i : i + 2] for p in self.pieces for i in range(len(p) - 1)}
        if any(pair[1] == SPACE != pair[0] for pair in self.joined):
            raise ValueError("a piece of this vocabulary spans words")
        spoken = [score for p, (score, _) in self.pieces.items() if p.strip(SPACE)]
        self.unknown = min(spoken, default=0) - UNKNOWN_PENALTY
        self._words = Cache()

    def _trie(self, step: int) -> Node:
        """A trie of tuples over the pieces, forward or backward: what may follow, then score and ids of the piece that
        ends here, if one does."""
        root: Node = {}
        for text, piece in sorted((piece[::step], piece) for piece in self.pieces):
            here = root
            for character in text[:-1]:
                here = here.setdefault(character, ({}, None, b""))[0]
            followers = here[text[-1]][0] if text[-1] in here else {}
            here[text[-1]] = (followers, *self.pieces[piece])
        return root

    def spelled(self, character: str) -> bytes:
        return struct.pack(f"<{len(character.encode())}I", *[self.byte_ids[b] for b in character.encode()])

    def edges_to(self, part: str, end: int) -> list[tuple[int, int, bytes]]:
        """Start, score and ids of every edge that ends here."""
        found: list[tuple[int, int, bytes]] = []
        if part[end - 1] not in self.pieces:
            found.append((end - 1, self.unknown, self.spelled(part[end - 1])))
        here = self.backward
        for start in range(end - 1, max(-1, end - 1 - self.longest), -1):
            step = here.get(part[start])
            if step is None:
                break
            here, gain, ids = step
            if gain is not None:
                found.append((start, gain, ids))
        return found

    def prefixes(self, part: str) -> list[int]:
        """The best score of every prefix."""
        best, pieces = [0] + [_NEVER] * len(part), self.pieces
        for start in range(len(part)):
            score = best[start]
            if part[start] not in pieces and score + self.unknown > best[start + 1]:
                best[start + 1] = score + self.unknown
            here, end = self.root, start
            for character in part[start : start + self.longest]:
                step = here.get(character)
                if step is None:
                    break
                here, gain, _ = step
                end += 1
                if gain is not None and score + gain > best[end]:
                    best[end] = score + gain
        return best

    def forward(self, part: str) -> Best:
        """Viterbi with the best and the second best score of every place."""
        size, root = len(part), self.root
        first, second = [0] + [_NEVER] * size, [_NEVER] * (size + 1)
        back: list[tuple[int, bytes]] = [(0, b"")] * (size + 1)
        for start in range(size):
            best, other = first[start], second[start]
            step = root.get(part[start])
            if step is None or step[1] is None:
                total, end = best + self.unknown, start + 1
                if total > first[end]:
                    second[end] = max(first[end], other + self.unknown)
                    first[end], back[end] = total, (start, self.spelled(part[start]))
                elif total > second[end]:
                    second[end] = total
            here, end = root, start
            for character in part[start : start + self.longest]:
                step = here.get(character)
                if step is None:
                    break
                here, gain, ids = step
                end += 1
                if gain is not None:
                    total = best + gain
                    if total > first[end]:
                        also = other + gain
                        second[end] = also if also > first[end] else first[end]
                        first[end] = total
                        back[end] = start, ids
                    elif total > second[end]:
                        second[end] = total
        found, place = [], size
        while place:
            place, piece_ids = back[place]
            found.append(piece_ids)
        ids = b"".join(reversed(found))
        loss = first[size] - second[size]
        return first[size], ids, loss if loss < _NONE else _NONE

    def segmentations(self, part: str, n: int) -> Segmentations:
        """The ``n`` best of a stretch of text, best first, or all if there are fewer.

        The forward scores are exact, so every suffix that is popped is part of a segmentation of just its value. Of equal
        values the one nearest to the start goes first, so each of the ``n`` is reached in at most one descent.
        """
        size, best = len(part), self.prefixes(part)
        # backward: negated score of the best whole path through a suffix, place, order made, suffix score, suffix
        found: Segmentations = []
        made = 0
        heap: list[tuple[int, int, int, int, tuple | None]] = [(-best[size], size, 0, 0, None)]
        while heap and len(found) < n:
            _, place, _, score, suffix = heapq.heappop(heap)
            if not place:
                ids = []
                while suffix is not None:
                    ids.append(suffix[0])
                    suffix = suffix[1]
                found.append((score, b"".join(ids)))
                continue
            for start, gain, ids in self.edges_to(part, place):
                made += 1
                heapq.heappush(heap, (-score - gain - best[start], start, made, score + gain, (ids, suffix)))
        return found

    def parts(self, word: str) -> list[str]:
        """Normalised text, cut where no piece spans."""
        joined = self.joined
        parts: list[str] = []
        for part in _PART.findall(word):
            if parts and parts[-1][-1] + part[0] in joined:
                parts[-1] += part
            else:
                parts.append(part)
        return parts

    def _best(self, word: str) -> Best:
        """Best score and ids of a word, and the loss of its second best segmentation."""
        if word[1:].isalpha():
            return self.forward(word)
        parts = self.parts(word)
        if len(parts) == 1:
            return self.forward(word)
        known = []
        for part in parts:  # words themselves, mostly, without the punctuation around them
            best = self._words.get(part)
            if best is None:
                best = self.forward(part)
                self._words.put(part, best)
            known.append(best)
        return sum([b[0] for b in known]), b"".join([b[1] for b in known]), min([b[2] for b in known])

    def encode(self, text: str, n: int) -> Segmentations:
        """The ``n`` best segmentations of a text, best first; an empty text has one, without pieces."""
        if not text:
            return [(0, b"")]
        words = _WORD.findall(SPACE + text.replace(" ", SPACE))
        chosen = list(map(self._words.young.get, words))
        if None in chosen:
            for at, known in enumerate(chosen):
                if known is None:
                    chosen[at] = self._words.get(words[at]) or self._best(words[at])
                    self._words.put(words[at], chosen[at])
        score, ids, losses = sum(map(_SCORE, chosen)), list(map(_IDS, chosen)), list(map(_LOSS, chosen))
        if n == 2:
            smallest = [losses.index(min(losses))]
        else:
            smallest = heapq.nsmallest(n - 1, range(len(losses)), key=losses.__getitem__)
        open_at = sorted(at for at in smallest if losses[at] < _NONE)
        if not open_at:
            return [(score, b"".join(ids))]
        return self._searched(ids, score, open_at, [self.segmentations(words[at], n) for at in open_at], n)

    @staticmethod
    def _searched(
        ids: list[bytes], score: int, open_at: list[int], options: list[Segmentations], n: int
    ) -> Segmentations:
        """Best-first over the alternatives of the words in ``open_at``; all others are at their best."""
        found: Segmentations = []
        made = 0
        # of equal losses the one with most words decided goes first, so ties do not multiply
        heap: list[tuple[int, int, int, tuple[int, ...]]] = [(0, 0, 0, ())]
        while heap and len(found) < n:
            loss, _, _, picks = heapq.heappop(heap)
            if len(picks) < len(open_at):
                here = options[len(picks)]
                for pick, (points, _) in enumerate(here):
                    made += 1
                    heapq.heappush(heap, (loss + here[0][0] - points, -len(picks), made, (*picks, pick)))
                continue
            for at, here, pick in zip(open_at, options, picks, strict=True):
                ids[at] = here[pick][1]
            found.append((score - loss, b"".join(ids)))
        return found


class Cache:
    """Two generations of words: when the younger one is full, the older one is dropped."""

    def __init__(self) -> None:
        self.young: dict = {}
        self._old: dict = {}

    def get(self, word: str):  # noqa: ANN201
        known = self.young.get(word)
        if known is None:
            known = self._old.get(word)
            if known is not None:
                self.put(word, known)
        return known

    def put(self, word: str, known) -> None:  # noqa: ANN001
        if len(word) > 48:
            return
        if len(self.young) >= MAX_CACHED_WORDS:
            self._old, self.young = self.young, {}
        self.young[word] = known


@cache
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(sentencepiece.SentencePieceProcessor(model_file=path))


@cache
def surfaces(path: str) -> Surfaces:
    return Surfaces(sentencepiece.SentencePieceProcessor(model_file=path))


_SCHEMA = "doc_id bigint, text_hash bigint, rank int, score bigint, ids binary, read_back string"
_ARROW = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("text_hash", pa.int64()),
        ("rank", pa.int32()),
        ("score", pa.int64()),
        ("ids", pa.binary()),
        ("read_back", pa.string()),
    ]
)
_BATCH_BYTES = 4 * 1024 * 1024


def encode(docs: DataFrame, *, n: int = N_BEST, path: str | None = None, read_back: bool = False) -> DataFrame:
    """The ``n`` best segmentations of every whole text: ``doc_id``, ``text_hash``, ``rank`` (from 1), ``score`` and
    ``ids`` (little-endian unsigned 32-bit).

    A NULL text counts as empty; an empty text has one segmentation, without ids. Repeated rows and NULL ids are encoded
    like any other; other columns play no part. Segmentations of equal score come in a fixed order. ``read_back`` adds
    a column of that name with the text that ``decode`` would give, without a second Python worker.
    """
    source = path or public_tokenizers.path(MODEL)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, back = vocabulary(source), surfaces(source)
        rows: list[tuple] = []
        held = 0
        gc.disable()  # nothing here makes cycles, and looking for them in the cache takes time
        try:
            for batch in batches:
                for doc_id, text_hash, text in zip(*batch.columns, strict=True):
                    for rank, (score, ids) in enumerate(known.encode(text.as_py(), n), start=1):
                        text_again = back.decode(ids) if read_back else None
                        rows.append((doc_id.as_py(), text_hash.as_py(), rank, score, ids, text_again))
                        held += len(ids)
                    if held > _BATCH_BYTES:
                        yield _batch(rows)
                        rows, held = [], 0
            if rows:
                yield _batch(rows)
        finally:
            gc.enable()

    body = F.coalesce(F.col("text"), F.lit(""))
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64(body).alias("text_hash"), body.alias("text"))
    found = texts.mapInArrow(run, _SCHEMA)
    return found if read_back else found.drop("read_back")


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, _ARROW, strict=True)], schema=_ARROW)


def decode(encoded: DataFrame, *, path: str | None = None) -> DataFrame:
    """``encoded`` with the ``text`` of its ``ids``. A NULL gives NULL. U+2581 in a text reads back as a space."""
    source = path or public_tokenizers.path(MODEL)

    @F.pandas_udf("string")
    def text_of(ids):  # noqa: ANN001, ANN202
        known = surfaces(source)
        return ids.map(lambda b: None if b is None else known.decode(b))

    return encoded.withColumn("text", text_of(F.col("ids")))
