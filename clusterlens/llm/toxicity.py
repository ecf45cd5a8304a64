"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic examples and unlabelled text are all that training sees. Unlabelled text holds toxic documents too, in
the share ``prior``; the risk of calling text harmless is estimated on it and corrected by that share of the positives,
and never allowed below zero, which a flexible model would otherwise exploit.

The model is a logistic one over terms: whole words, and the first letters of words, so that inflected forms count
together. Terms are counted by Spark over the sample; only the chosen ones and the sample's presence lists reach the
driver, where numpy fits the weights. Scoring reads every whole text in one scan, without a shuffle.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clusterlens.llm import common
from clusterlens.llm.sampling import draw

# Bounds of the sample: confirmed toxic rows, and rows of unlabelled text.
POSITIVES, UNLABELLED = 3_000, 9_000
# At most so many candidate terms, each in so many confirmed documents, with at least this log-likelihood ratio against its rate in
# unlabelled text, and so many times as frequent as in text that is harmless.
TERMS, SUPPORT, EVIDENCE, LIFT = 2_000, 3, 8.0, 10.0
# A confirmed document is explained once it has so many of the model's terms.
DEPTH = 4
PREFIXES = (4, 5)
FOLDS = 5
# A term counts for the estimate of the prior if so large a part of the examples has it; the prior if none does.
COMMON, DEFAULT_PRIOR = 0.1, 0.05

STEPS, RATE, PENALTY = 300, 0.1, 1e-4

_WORD = re.compile(r"[^\W\d_]+")


def terms(text: str) -> set[str]:
    """Distinct lower-case words, and their prefixes marked by a trailing hyphen."""
    words = set(_WORD.findall(text.lower()))
    starts = [{w[:n] + "-" for w in words if len(w) > n} for n in PREFIXES]
    return words.union(*starts)


def covering_terms(presence: np.ndarray, rate: np.ndarray) -> list[int]:
    """Columns of ``presence`` (confirmed documents by candidate terms) worth keeping, strongest first.

    A term is judged on the documents that fewer than ``DEPTH`` chosen terms explain. The many words that near copies of
    one toxic document share are thus passed over once its toxic words are in. ``rate``: shares in unlabelled text.
    """
    covered = np.zeros(len(presence), dtype=int)
    chosen: list[int] = []
    while True:
        open_rows = covered < DEPTH
        support = presence[open_rows].sum(axis=0).astype(float)
        chance = np.maximum(rate * open_rows.sum(), 0.5)
        evidence = support * np.log(np.maximum(support, 1) / chance) - support + chance
        evidence[(support < SUPPORT) | (support <= chance)] = 0
        evidence[chosen] = 0
        if not len(evidence) or evidence.max() < EVIDENCE:
            return chosen
        chosen.append(int(evidence.argmax()))
        covered += presence[:, chosen[-1]].astype(int)


@dataclass(frozen=True)
class Model:
    weights: dict[str, float]
    bias: float

    def score(self, text: str) -> float:
        if not self.weights:
            return 0.0
        known = self.weights
        margin = self.bias + sum(known[t] for t in terms(text) if t in known)
        return float(1 / (1 + np.exp(-np.clip(margin, -30, 30))))


def fit_weights(
    positive: np.ndarray, unlabelled: np.ndarray, prior: float, *, steps: int = STEPS, rate: float = RATE
) -> tuple[np.ndarray, float]:
    """Weights and bias that minimise the non-negative risk with logistic loss, by Adam on whole batches.

    Risk: ``prior * loss(positive, +1) + max(0, loss(unlabelled, -1) - prior * loss(positive, -1))``. While the second
    part is negative the step climbs it instead.
    """

    def with_one(x: np.ndarray) -> np.ndarray:
        return np.hstack([x, np.ones((len(x), 1), dtype=x.dtype)])

    p, u = with_one(positive), with_one(unlabelled)
    w = np.zeros(p.shape[1])
    w[-1] = np.log(prior / (1 - prior))
    first, second = np.zeros_like(w), np.zeros_like(w)
    for step in range(1, steps + 1):
        now = w.astype(p.dtype)
        on_p, on_u = p @ now, u @ now
        sigmoid_p, sigmoid_u = (1 / (1 + np.exp(-np.clip(m, -30, 30))) for m in (on_p, on_u))
        harmless = np.logaddexp(0, on_u).mean() - prior * np.logaddexp(0, on_p).mean()
        of_harmless = sigmoid_u @ u / len(u) - prior * (sigmoid_p @ p) / len(p)
        if harmless >= 0:
            gradient = prior * ((sigmoid_p - 1) @ p) / len(p) + of_harmless
        else:
            gradient = -of_harmless
        gradient[:-1] += PENALTY * w[:-1]
        first = 0.9 * first + 0.1 * gradient
        second = 0.999 * second + 0.001 * gradient**2
        w -= rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    return w[:-1], float(w[-1])


def _term_rows(rows: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = pa.array([sorted(terms(t)) for t in batch.column(2).to_pylist()], pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), found], names=["id", "known", "terms"])

    return rows.mapInArrow(run, "id bigint, known boolean, terms array<string>")


def _presence(rows: DataFrame, vocabulary: list[str]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = {term: i for i, term in enumerate(vocabulary)}
        for batch in batches:
            lists = [[index[t] for t in found if t in index] for found in batch.column(2).to_pylist()]
            columns = [batch.column(0), batch.column(1), pa.array(lists, pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "known", "at"])

    return rows.mapInArrow(run, "id bigint, known boolean, at array<int>")


def estimated_prior(counted: DataFrame, n_positive: int) -> float:
    """Share of the class in unlabelled text, if no row is labelled otherwise.

    A term is at least as frequent in unlabelled text as its share in confirmed examples times that of the class, so the
    least ratio of the two, over terms that enough examples have, is an upper bound, and close where a term is the class's own.
    """
    common_enough = counted.where(F.col("support") >= max(SUPPORT, COMMON * n_positive))
    least = common_enough.agg(F.min(F.col("u") * n_positive / F.col("support"))).first()[0]
    return DEFAULT_PRIOR if least is None else least


def fit(docs: DataFrame, labels: DataFrame, *, prior: float | None = None) -> Model:
    """Learn from ``labels.toxic`` of the rows whose crc32 of the id, modulo ``FOLDS``, is not 0, and from the text of
    such rows of ``docs``. Rows without an id or without a label teach nothing. Without a confirmed example the model
    has no terms, and scores everything 0.

    ``prior`` is the share of toxic texts. If it is not given, it is their share among the labelled rows, or where these
    are all toxic, ``estimated_prior``.
    """
    learnable = common.fold(F.col("doc_id"), FOLDS) != 0
    known = labels.where(learnable).groupBy("doc_id").agg(F.max("toxic").alias("toxic")).where("toxic IS NOT NULL")
    known = common.settle(known)
    n, toxic = known.agg(F.count(F.lit(1)), F.coalesce(F.sum((F.col("toxic") == 1).cast("int")), F.lit(0))).first()
    if not toxic:
        return Model({}, 0.0)
    if prior is None and toxic < n:
        prior = toxic / n
    texts = docs.where(learnable).select(F.col("doc_id").cast("bigint").alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    confirmed = draw(known.where("toxic = 1"), POSITIVES).select(F.col("doc_id").cast("bigint").alias("id"))
    positive = texts.join(F.broadcast(confirmed), "id").select("id", F.lit(True).alias("known"), "text")
    anything = draw(texts, UNLABELLED, doc_id="id").select("id", F.lit(False).alias("known"), "text")
    # copies of one text would pass for evidence
    distinct = positive.unionByName(anything).withColumn("_hash", F.xxhash64("text")).dropDuplicates(["known", "_hash"])
    sample = common.settle(_term_rows(distinct.drop("_hash")))

    sizes = {r.known: r.n for r in sample.groupBy("known").agg(F.count(F.lit(1)).alias("n")).collect()}
    n_p, n_u = sizes.get(True, 0), sizes.get(False, 0)
    if not n_u and not texts.isEmpty():
        raise ValueError("the sample of unlabelled texts is empty, but there are such texts")
    if not n_p or not n_u:  # the confirmed examples are of no document at hand
        return Model({}, 0.0)
    is_known = F.col("known").cast("double")
    counted = sample.select(is_known.alias("k"), F.explode("terms").alias("term")).groupBy("term").agg(
        (F.sum(1 - F.col("k")) / n_u).alias("u"), F.sum("k").alias("support")
    )
    if prior is None:
        prior = estimated_prior(counted, n_p)
    prior = min(0.9, max(0.001, prior))
    support, share = F.col("support"), F.col("support") / n_p
    chance = F.greatest(F.col("u") * n_p, F.lit(0.5))
    evidence = support * F.log(support / chance) - support + chance
    among_harmless = F.greatest(F.lit(0.0), F.col("u") - prior * share) / (1 - prior)
    chosen = counted.where((support >= SUPPORT) & (support > chance) & (evidence >= EVIDENCE) & (share > LIFT * among_harmless))
    vocabulary = [r.term for r in chosen.orderBy(evidence.desc(), "term").limit(TERMS).select("term").collect()]

    found = sorted(_presence(sample, vocabulary).collect(), key=lambda r: (r.known, r.id))
    matrix = np.zeros((len(found), len(vocabulary)), dtype=np.float32)
    for i, row in enumerate(found):
        matrix[i, row.at] = 1
    is_positive = np.array([r.known for r in found])
    positive_rows, unlabelled_rows = matrix[is_positive], matrix[~is_positive]
    kept = covering_terms(positive_rows, unlabelled_rows.mean(axis=0))
    weights, bias = fit_weights(positive_rows[:, kept], unlabelled_rows[:, kept], prior)
    return Model({vocabulary[i]: w for i, w in zip(kept, weights.tolist(), strict=True)}, bias)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id`` and ``score`` for every row. NULL and empty texts have the score of a text without known terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = [model.score(text) for text in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], names=["doc_id", "score"])

    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return texts.mapInArrow(run, "doc_id bigint, score double")


def drop_toxic(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """``docs`` without the rows that score ``threshold`` or more. One scan; rows keep all their columns."""

    @F.pandas_udf("double")
    def toxicity_of(texts):  # noqa: ANN001, ANN202
        return texts.map(lambda t: model.score(t or ""))

    return docs.where(toxicity_of(F.col("text")) < F.lit(threshold))
