"""Language identification with a string kernel.

The kernel of two texts is the number of character n-grams (one to three letters, blended) that both contain, divided
by the geometric mean of the numbers that each contains. Nyström landmarks, a few texts of every language, turn a text
into its kernels with them; one-versus-rest kernel ridge regression on these gives a margin per language. Texts are
scored in batches by two matrix products.

Runs of anything but letters count as one separator, so word beginnings and ends are n-grams too. Presence saturates in
long texts, where a short quotation in another language would weigh as much as the rest; so a text is cut into windows,
every one of them is scored, and their margins are averaged by length.
"""

from __future__ import annotations

import sys
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clusterlens.llm import common
from clusterlens.llm.sampling import draw

# Bounds of the sample of labelled rows: texts to fit on, and landmarks among them (both in all, shared by languages).
# A landmark is one window of its text, chosen by a hash; all windows of the examples are fitted.
EXAMPLES, LANDMARKS = 3_000, 160
FOLDS, HELD_OUT = 4, 2
RIDGE = 1e-3
UNDETERMINED = "und"
# Characters in a window, and windows multiplied at once.
WINDOW, _BATCH = 4_000, 256

_is_letter: list[np.ndarray] = []


def letter_table() -> np.ndarray:
    """1 for every code point that is a letter, else 0; built once in each process."""
    if not _is_letter:
        _is_letter.append(np.fromiter((chr(c).isalpha() for c in range(sys.maxunicode + 1)), np.uint8))
    return _is_letter[0]


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


# Places of the letters of an n-gram in its code, 21 bits for any code point, and marks for one and two letters.
_SHIFT = np.uint64(21)
_ONE, _TWO = np.uint64(3 << 62), np.uint64(1 << 63)


def grams(text: str) -> np.ndarray:
    """Sorted codes of the distinct n-grams; none for a text without letters."""
    points = code_points(text)
    marks = np.where(letter_table()[points] > 0, points, 0).astype(np.uint64)
    marks = np.concatenate([np.zeros(1, np.uint64), marks, np.zeros(1, np.uint64)])
    keep = np.ones(len(marks), dtype=bool)
    keep[1:] = (marks[1:] > 0) | (marks[:-1] > 0)
    marks = marks[keep]
    if len(marks) < 3:
        return np.zeros(0, np.uint64)
    two = marks[:-1] << _SHIFT | marks[1:]
    three = two[:-1] << _SHIFT | marks[2:]
    return np.unique(np.concatenate([marks[marks > 0] | _ONE, two | _TWO, three]))


@dataclass(frozen=True)
class Kernel:
    """N-gram presence against landmarks, over the n-grams that any landmark has."""

    ngrams: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))
    landmarks: np.ndarray = field(default_factory=lambda: np.zeros((0, 0), np.float32))

    def rows(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Kernels of each text with the landmarks, and whether it has letters."""
        presence = np.zeros((len(texts), len(self.ngrams)), dtype=np.float32)
        sizes = np.zeros(len(texts))
        for i, text in enumerate(texts):
            found = grams(text)
            sizes[i] = len(found)
            at = np.searchsorted(self.ngrams, found)
            at[at == len(self.ngrams)] = 0
            presence[i, at[self.ngrams[at] == found] if len(self.ngrams) else []] = 1
        shared = presence @ self.landmarks.T
        return shared / np.sqrt(np.maximum(sizes, 1))[:, None], sizes > 0


def kernel_of(texts: list[str]) -> Kernel:
    """A kernel with these texts as landmarks."""
    found = [grams(text) for text in texts]
    ngrams = np.unique(np.concatenate(found)) if found else np.zeros(0, np.uint64)
    landmarks = np.zeros((len(texts), len(ngrams)), dtype=np.float32)
    for i, codes in enumerate(found):
        landmarks[i, np.searchsorted(ngrams, codes)] = 1 / np.sqrt(max(1, len(codes)))
    return Kernel(ngrams, landmarks)


@dataclass(frozen=True)
class Model:
    languages: tuple[str, ...]
    kernel: Kernel
    weights: np.ndarray  # landmarks by languages

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        if not self.languages:
            return [UNDETERMINED] * len(texts), np.zeros(len(texts))
        owners, pieces = windows(texts)
        sums, weights = np.zeros((len(texts), len(self.languages))), np.zeros(len(texts))
        for at in range(0, len(pieces), _BATCH):
            part = pieces[at : at + _BATCH]
            rows, lettered = self.kernel.rows(part)
            share = np.fromiter(map(len, part), np.float64, len(part)) * lettered
            np.add.at(sums, owners[at : at + _BATCH], rows @ self.weights * share[:, None])
            np.add.at(weights, owners[at : at + _BATCH], share)
        margins = sums / np.maximum(weights, 1)[:, None]
        best = margins.argmax(axis=1)
        # targets are -1 and 1, so the middle of a margin's range is 0
        scores = np.clip((margins[np.arange(len(texts)), best] + 1) / 2, 0, 1)
        known = weights > 0
        names = [self.languages[b] if k else UNDETERMINED for b, k in zip(best.tolist(), known.tolist(), strict=True)]
        return names, np.where(known, scores, 0.0)


def windows(texts: list[str]) -> tuple[np.ndarray, list[str]]:
    """All windows of the texts, and the position of the text that each is from."""
    counts = [max(1, -(-len(text) // WINDOW)) for text in texts]
    pieces = [text[at : at + WINDOW] for text in texts for at in range(0, max(1, len(text)), WINDOW)]
    return np.repeat(np.arange(len(texts)), counts), pieces


def fit(docs: DataFrame) -> Model:
    """Learn from the texts and languages of rows whose crc32 of the id, modulo ``FOLDS``, is not ``HELD_OUT``.

    Rows with a NULL language, text or id, and texts without letters, teach nothing. Without any example every text is
    undetermined.
    """
    rows = docs.where((common.fold(F.col("doc_id"), FOLDS) != HELD_OUT) & F.col("lang").isNotNull())
    rows = rows.where(F.col("text").isNotNull()).select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", "lang")
    drawn = common.settle(draw(rows, EXAMPLES, by=F.col("lang")))
    missing = _languages(rows) - _languages(drawn)
    if missing:
        raise ValueError(f"the sample has no texts of {sorted(missing)}, but there are such texts")
    lands = sorted(draw(drawn, LANDMARKS, by=F.col("lang"), salt=1).collect(), key=lambda r: (r.lang, r.doc_id, r.text))
    kernel = kernel_of([landmark(r.text) for r in lands])
    if not lands:
        return Model((), kernel, np.zeros((0, 0)))
    languages = tuple(sorted(_languages(drawn)))
    sums, n = _normal_equations(drawn, kernel, languages)
    if not n:
        return Model((), kernel, np.zeros((len(lands), 0)))
    # Nyström: regression on K(texts, landmarks) with K(landmarks, landmarks) as penalty
    among = kernel.landmarks.astype(float) @ kernel.landmarks.astype(float).T
    gram = sums[:, : len(lands)] + RIDGE * n * among + 1e-8 * n * np.eye(len(lands))
    return Model(languages, kernel, np.linalg.solve(gram, sums[:, len(lands) :]))


def _languages(rows: DataFrame) -> set[str]:
    return {r.lang for r in rows.select("lang").distinct().collect()}


def landmark(text: str) -> str:
    """One window of the text, chosen by a hash of it."""
    pieces = windows([text])[1]
    return pieces[zlib.crc32(text.encode("utf-8", "surrogatepass")) % len(pieces)]


def _normal_equations(drawn: DataFrame, kernel: Kernel, languages: tuple[str, ...]) -> tuple[np.ndarray, int]:
    """Sums over all windows with letters of ``k' [k, t]`` for their kernels k and targets t, and how many windows.

    Each task adds up its own windows; only the sums are shuffled, and only one matrix of sums comes to the driver.
    """
    size = len(kernel.landmarks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros((size, size + len(languages))), 0
        for batch in batches:
            names = batch.column(1).to_pylist()
            owners, pieces = windows(batch.column(0).to_pylist())
            for at in range(0, len(pieces), _BATCH):
                across, lettered = kernel.rows(pieces[at : at + _BATCH])
                across = across[lettered].astype(float)
                of = [names[i] for i in owners[at : at + _BATCH][lettered].tolist()]
                targets = np.array([[1.0 if name == lang else -1.0 for lang in languages] for name in of]).reshape(len(of), len(languages))
                total += across.T @ np.hstack([across, targets])
                n += len(of)
        places = np.arange(total.size + 1, dtype=np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(places), pa.array(np.append(total.ravel(), n))], names=["place", "value"])

    parts = drawn.select("text", "lang").mapInArrow(run, "place int, value double")
    found = sorted(parts.groupBy("place").agg(F.sum("value").alias("value")).collect())
    values = np.array([r.value for r in found])
    return values[:-1].reshape(size, size + len(languages)), int(values[-1])


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id``, ``lang_pred`` and ``score`` for every row; ``und`` and 0 if the text is NULL or has no letter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, _BATCH):
                part = batch.slice(at, _BATCH)
                names, scores = model.predict(part.column(1).to_pylist())
                columns = [part.column(0), pa.array(names, pa.string()), pa.array(scores, pa.float64())]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "lang_pred", "score"])

    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return texts.mapInArrow(run, "doc_id bigint, lang_pred string, score double")
