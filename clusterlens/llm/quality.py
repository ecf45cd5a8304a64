"""Quality by kernel ridge regression on document statistics.

Every text becomes some thirty statistics. Random Fourier features approximate a Gaussian kernel over them, each task
sums its part of the normal equations, and the small sums give ridge scores. The scores are calibrated by isotonic
regression on scores that a model fitted without the row's own fold has given it.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clusterlens.llm import common

FEATURES, WIDTH, RIDGE = 256, 4.0, 1.0
FOLDS, CALIBRATION_FOLDS = 5, 4
# Tasks that sum the normal equations, and bins of the ridge score that calibration sees: both fix what reaches the driver.
SUMMING_TASKS, BINS = 16, 2_000
SEED = 7

_SYMBOL_RUN = re.compile(r"[^\w\s]{2,}")
_LONE_SYMBOL = re.compile(r"(?<!\S)[^\w\s]+(?!\S)")
_SENTENCE_END = re.compile(r"[.!?](?=\s|$)")
_PUNCTUATION = np.isin(np.arange(256), list(b".,;:!?'\"()-"))
_SYMBOL = np.isin(np.arange(256), list(b"#$%&*+/<=>@[\\]^_`{|}~"))
_DIGIT = np.isin(np.arange(256), list(b"0123456789"))
STATISTICS = 26


def statistics(text: str) -> list[float]:
    """Shares and logarithms of counts; all zero for a text without words."""
    words = text.split()
    if not words:
        return [0.0] * STATISTICS
    raw = np.bincount(np.frombuffer(text.encode(), np.uint8), minlength=256)
    n_chars, n_bytes, n_words = len(text), int(raw.sum()), len(words)
    letters = n_bytes - int(raw[_PUNCTUATION].sum() + raw[_SYMBOL].sum() + raw[_DIGIT].sum() + raw[[9, 10, 13, 32]].sum())
    lower = text.lower()
    raised = sum(a != b for a, b in zip(words, lower.split(), strict=False))
    upper = int(raw[65:91].sum())
    lengths = np.fromiter(map(len, words), np.int64, n_words)
    counts = Counter(words)
    lines = [line for line in text.split("\n") if line.strip()]
    line_counts = Counter(lines)
    repeated = sum(n - 1 for n in line_counts.values())
    repeated_chars = sum((n - 1) * len(line) for line, n in line_counts.items())
    present = raw[raw > 0] / n_bytes
    symbol_runs = _SYMBOL_RUN.findall(text)
    sentences = len(_SENTENCE_END.findall(text))
    return [
        math.log1p(n_chars),
        math.log1p(n_words),
        float(lengths.mean()),
        float(lengths.std()),
        math.log1p(int(lengths.max())),
        float((lengths <= 2).mean()),
        upper / max(1, letters),
        raised / n_words,
        int(raw[_PUNCTUATION].sum()) / n_bytes,
        int(raw[_SYMBOL].sum()) / n_bytes,
        int(raw[_DIGIT].sum()) / n_bytes,
        (n_bytes - n_chars) / n_bytes,
        raw[33] / n_words,
        raw[124] / n_words,
        len(symbol_runs) / n_words,
        len(_LONE_SYMBOL.findall(text)) / n_words,
        sentences / n_words,
        raw[44] / n_words,
        len(counts) / n_words,
        math.log(len(counts)) / math.log(n_words) if n_words > 1 else 1.0,
        max(counts.values()) / n_words,
        len(lines) / n_words,
        math.log1p(n_chars / max(1, len(lines))),
        repeated / max(1, len(lines)),
        repeated_chars / n_chars,
        float(-(present * np.log(present)).sum()),
    ]


def measured(docs: DataFrame) -> DataFrame:
    """``doc_id`` and its ``stats``, from every whole text; a NULL text counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            stats = pa.array([statistics(t) for t in batch.column(1).to_pylist()], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), stats], names=["doc_id", "stats"])

    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return texts.mapInArrow(run, "doc_id bigint, stats array<double>")


@dataclass(frozen=True)
class FourierMap:
    """Standardised statistics to cosines whose inner products approximate a Gaussian kernel."""

    mean: np.ndarray
    scale: np.ndarray
    frequencies: np.ndarray
    phases: np.ndarray

    @classmethod
    def draw(cls, mean: np.ndarray, scale: np.ndarray, features: int = FEATURES, width: float = WIDTH) -> FourierMap:
        generator = np.random.default_rng(SEED)
        frequencies = generator.normal(0, 1 / width, (len(mean), features))
        return cls(mean, scale, frequencies, generator.uniform(0, 2 * np.pi, features))

    def __call__(self, stats: np.ndarray) -> np.ndarray:
        """One row per document, with a constant 1 as last column."""
        standard = np.clip((stats - self.mean) / self.scale, -6, 6)
        waves = np.cos(standard @ self.frequencies + self.phases) * np.sqrt(2 / len(self.phases))
        return np.hstack([waves, np.ones((len(stats), 1))])


@dataclass(frozen=True)
class Model:
    features: FourierMap | None
    weights: np.ndarray
    knots: np.ndarray
    levels: np.ndarray

    def score(self, stats: np.ndarray) -> np.ndarray:
        if self.features is None:
            return np.full(len(stats), float(self.levels[0]))
        ridge = self.features(stats) @ self.weights
        calibrated = np.interp(ridge, self.knots, self.levels)
        # isotonic steps are flat; a thousandth of the ridge score keeps the order within them
        return 0.999 * calibrated + 0.001 * np.clip(ridge, 0, 1)


def _matrix(column: pa.ListArray) -> np.ndarray:
    return column.flatten().to_numpy().reshape(len(column), STATISTICS)


def _normal_equations(rows: DataFrame, features: FourierMap) -> dict[int, np.ndarray]:
    """Per calibration fold, the inner products of ``[features, 1, label]``, summed in tasks and then over tasks."""
    size = FEATURES + 2

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((CALIBRATION_FOLDS, size, size))
        for batch in batches:
            fold, label = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            joined = np.hstack([features(_matrix(batch.column(2))), label[:, None]])
            for f in range(CALIBRATION_FOLDS):
                part = joined[fold == f]
                sums[f] += part.T @ part
        for f in range(CALIBRATION_FOLDS):
            if sums[f].any():
                values = pa.FixedSizeListArray.from_arrays(pa.array(sums[f].ravel()), size).cast(pa.list_(pa.float64()))
                columns = [pa.array([f] * size, pa.int32()), pa.array(range(size), pa.int32()), values]
                yield pa.RecordBatch.from_arrays(columns, names=["fold", "at", "sums"])

    def add(table: pa.Table) -> pa.Table:
        total = table.column("sums").combine_chunks().flatten().to_numpy().reshape(-1, size).sum(axis=0)
        return pa.table(
            {
                "fold": table.column("fold").slice(0, 1),
                "at": table.column("at").slice(0, 1),
                "sums": pa.array([total], pa.list_(pa.float64())),
            }
        )

    schema = "fold int, at int, sums array<double>"
    parts = rows.select("fold", "label", "stats").coalesce(SUMMING_TASKS).mapInArrow(partial, schema)
    summed = parts.groupBy("fold", "at").applyInArrow(add, schema)
    result: dict[int, np.ndarray] = {}
    for row in summed.collect():
        result.setdefault(row["fold"], np.zeros((size, size)))[row["at"]] = row["sums"]
    return result


def _ridge(sums: np.ndarray) -> np.ndarray:
    gram, moments = sums[:-1, :-1].copy(), sums[:-1, -1]
    gram[np.arange(FEATURES), np.arange(FEATURES)] += RIDGE
    gram[-1, -1] += 1e-9
    return np.linalg.solve(gram, moments)


def isotonic(values: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Least-squares non-decreasing fit, by pooling adjacent violators."""
    blocks: list[list[float]] = []  # mean, weight, length
    for value, weight in zip(values.tolist(), weights.tolist(), strict=True):
        blocks.append([value, weight, 1])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            mean, heavy, length = blocks.pop()
            last = blocks[-1]
            last[0] = (last[0] * last[1] + mean * heavy) / (last[1] + heavy)
            last[1] += heavy
            last[2] += length
    return np.repeat([b[0] for b in blocks], [int(b[2]) for b in blocks])


def fit(stats: DataFrame, labels: DataFrame) -> Model:
    """Learn ``labels.quality`` from the ``stats`` of rows whose crc32 of the id, modulo ``FOLDS``, is not 0.

    Rows without an id or label teach nothing. Without any label, every score is 0.5; with one class only, its value.
    """
    learnable = common.fold(F.col("doc_id"), FOLDS) != 0
    known = labels.where(learnable).groupBy("doc_id").agg(F.max("quality").cast("double").alias("label")).where("label IS NOT NULL")
    means = [F.avg(F.col("stats")[i]) for i in range(STATISTICS)]
    spreads = [F.stddev_pop(F.col("stats")[i]) for i in range(STATISTICS)]
    moments = [0.0 if v is None else float(v) for v in stats.agg(*means, *spreads).first()]
    mean, spread = np.array(moments[:STATISTICS]), np.array(moments[STATISTICS:])
    fourier = FourierMap.draw(mean, np.where(spread > 1e-9, spread, 1.0))

    fold = F.pmod(F.xxhash64("doc_id"), F.lit(CALIBRATION_FOLDS)).cast("int").alias("fold")
    rows = common.settle(stats.join(known, "doc_id").select("doc_id", fold, "label", "stats"))
    classes = rows.agg(F.min("label"), F.max("label")).first()
    if classes[0] is None or classes[0] == classes[1]:
        level = 0.5 if classes[0] is None else classes[0]
        return Model(None, np.zeros(0), np.zeros(1), np.array([level]))
    sums = _normal_equations(rows, fourier)
    total = sum(sums.values())
    weights = _ridge(total)
    without = {f: _ridge(total - part) if len(sums) > 1 else weights for f, part in sums.items()}

    def bins(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            folds, waves = batch.column(0).to_numpy(), fourier(_matrix(batch.column(2)))
            ridge = np.zeros(len(folds))
            for f, w in without.items():
                ridge[folds == f] = waves[folds == f] @ w
            at = np.clip((ridge + 0.5) / 2 * BINS, 0, BINS - 1).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(at), batch.column(1)], names=["bin", "label"])

    binned = rows.select("fold", "label", "stats").mapInArrow(bins, "bin int, label double")
    counted = sorted(binned.groupBy("bin").agg(F.avg("label").alias("mean"), F.count(F.lit(1)).alias("n")).collect())
    levels = isotonic(np.array([r["mean"] for r in counted]), np.array([float(r["n"]) for r in counted]))
    knots = (np.array([r["bin"] for r in counted]) + 0.5) / BINS * 2 - 0.5
    return Model(fourier, weights, knots, levels)


def score(stats: DataFrame, model: Model) -> DataFrame:
    """``doc_id`` and ``score`` for every row of ``measured``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = model.score(_matrix(batch.column(1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores)], names=["doc_id", "score"])

    return stats.mapInArrow(run, "doc_id bigint, score double")
