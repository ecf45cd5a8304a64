"""Held-out accuracy of the classifiers, and what they do with unusual rows."""

import zlib

import numpy as np
import pytest

from clusterlens.llm import language, quality, queries, toxicity

SF_DIR = "/root/testdata/sf0.1"


def rows_of(df, labels):
    found = {}
    for row in df.collect():
        assert row.held_out == (zlib.crc32(str(row.doc_id).encode()) % 5 == 0)
        assert 0 <= row.score <= 1
        if row.held_out and row.doc_id in labels:
            found[row.doc_id] = (labels[row.doc_id], row.score, row.predicted)
    return np.array(list(found.values()), dtype=float)


def area(truth, score):
    """Probability that a row of class 1 scores higher than one of class 0."""
    ones, zeros = score[truth == 1], score[truth == 0]
    return ((ones[:, None] > zeros).sum() + 0.5 * (ones[:, None] == zeros).sum()) / (len(ones) * len(zeros))


def labels_of(spark, name):
    labels = spark.read.parquet(f"{SF_DIR}/labels.parquet")
    return {r[0]: r[1] for r in labels.select("doc_id", name).collect()}


def test_quality(spark):
    found = queries.op1_quality(spark, SF_DIR)
    assert found.count() == 10_000
    truth, score, predicted = rows_of(found, labels_of(spark, "quality")).T
    assert area(truth, score) > 0.99
    assert (predicted == (score >= 0.3)).all() and (predicted == truth).mean() > 0.98


def test_toxicity(spark):
    found = queries.op6_toxicity(spark, SF_DIR)
    assert found.count() == 10_000
    truth, score, predicted = rows_of(found, labels_of(spark, "toxic")).T
    assert (predicted == (score >= 0.5)).all()
    assert predicted[truth == 1].mean() > 0.8 and predicted[truth == 0].mean() < 0.03


def test_language(spark):
    found = queries.op3_language(spark, SF_DIR)
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "lang")
    held = found.join(docs, "doc_id").where("held_out")
    assert held.selectExpr("avg(int(lang = lang_pred))").first()[0] > 0.99
    assert found.where("score < 0 OR score > 1").count() == 0


UNUSUAL = [(1, None), (2, ""), (3, "123 ... !"), (None, "some text"), (4, "word " * 30_000), (4, "word"), (5, "漢字 かな"), (6, "\x00   a")]


@pytest.fixture
def unusual(spark):
    return spark.createDataFrame(UNUSUAL, "doc_id long, text string").selectExpr(
        "*", "'en' AS lang", "0.5 AS score", "'x' AS stats", "1 AS id", "true AS known"
    )


@pytest.mark.parametrize("labels", [[], [(1, None, None)], [(1, 1, 0), (2, 1, 0)], [(1, 0, 1), (4, 1, 0), (4, 1, 1), (None, 1, 1)]])
def test_unusual_rows_and_labels(spark, unusual, labels):
    made = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    for docs in (unusual, unusual.limit(0)) if len(labels) in (0, 4) else (unusual,):
        stats = quality.measured(docs)
        by_quality = quality.score(stats, quality.fit(stats, made)).collect()
        by_toxicity = toxicity.score(docs, toxicity.fit(docs, made)).collect()
        for found in (by_quality, by_toxicity):
            assert len(found) == docs.count()
            assert all(0 <= r.score <= 1 for r in found)
    assert toxicity.drop_toxic(unusual, toxicity.Model({"word": 9.0}, -5.0)).columns == unusual.columns
    kept = toxicity.drop_toxic(unusual, toxicity.Model({"word": 9.0}, -5.0)).collect()
    assert len(kept) == len(UNUSUAL) - 2


def test_unusual_rows_in_language(spark, unusual):
    model = language.fit(unusual)
    found = {(r.doc_id, r.lang_pred) for r in language.identify(unusual, model).collect()}
    assert {(1, "und"), (2, "und"), (3, "und"), (None, "en"), (4, "en"), (5, "en")} <= found
    empty = unusual.limit(0)
    assert language.identify(empty, language.fit(empty)).count() == 0
    assert {r.lang_pred for r in language.identify(unusual, language.fit(empty)).collect()} == {"und"}


def test_isotonic_is_the_best_monotone_fit():
    generator = np.random.default_rng(2)
    for _ in range(30):
        values, weights = generator.normal(size=12), generator.integers(1, 5, 12).astype(float)
        fit = quality.isotonic(values, weights)
        # min-max formula
        mean = lambda i, j: np.average(values[i : j + 1], weights=weights[i : j + 1])
        best = [max(min(mean(i, j) for j in range(k, 12)) for i in range(k + 1)) for k in range(12)]
        assert np.allclose(fit, best)


def test_fourier_features_approximate_the_kernel():
    stats = np.random.default_rng(1).normal(size=(40, quality.STATISTICS))
    features = quality.FourierMap.draw(np.zeros(quality.STATISTICS), np.ones(quality.STATISTICS), 20_000, 5.0)(stats)[:, :-1]
    distances = ((stats[:, None] - stats) ** 2).sum(axis=2)
    assert np.abs(features @ features.T - np.exp(-distances / (2 * 5.0**2))).max() < 0.06


def test_normal_equations_do_not_depend_on_partitions(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    stats = quality.measured(docs).toPandas()
    one, many = (spark.createDataFrame(stats).repartition(n) for n in (1, 7))
    assert np.allclose(quality.fit(one, labels).weights, quality.fit(many, labels).weights, atol=1e-4)


def test_the_risk_estimator_learns_from_unlabelled_text():
    """Half of the unlabelled rows are positive; a plain classifier would call the positives unlabelled."""
    generator = np.random.default_rng(4)
    positive = (generator.random((300, 6)) < [0.9, 0.9, 0.5, 0.5, 0.5, 0.5]).astype(np.float32)
    harmless = (generator.random((500, 6)) < [0.1, 0.1, 0.5, 0.5, 0.5, 0.5]).astype(np.float32)
    hidden = (generator.random((500, 6)) < [0.9, 0.9, 0.5, 0.5, 0.5, 0.5]).astype(np.float32)
    weights, bias = toxicity.fit_weights(positive, np.vstack([harmless, hidden]), 0.5)
    assert ((hidden @ weights + bias) > 0).mean() > 0.75
    assert ((harmless @ weights + bias) > 0).mean() < 0.25


def test_kernels_count_shared_ngrams():
    texts = ["abc abd", "xyz", "ab"]
    kernel = language.kernel_of(texts)
    rows, lettered = kernel.rows([*texts, "", "12"])

    def grams(text):
        padded = "".join(" " + w for w in text.split()) + " "
        return {padded[i : i + n] for n in (1, 2, 3) for i in range(len(padded) - n + 1)} - {" "}

    for i, a in enumerate(texts):
        for j, b in enumerate(texts):
            expected = len(grams(a) & grams(b)) / np.sqrt(len(grams(a)) * len(grams(b)))
            assert rows[i, j] == pytest.approx(expected, abs=1e-6)
    assert lettered.tolist() == [True, True, True, False, False]


def test_the_quality_fit_equals_plain_ridge_on_collected_rows(spark):
    """All normal equations, the ridge and the calibration against numpy over the rows themselves."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    stats = quality.measured(docs)
    model = quality.fit(stats, labels)
    known = {r.doc_id: r.quality for r in labels.collect() if zlib.crc32(str(r.doc_id).encode()) % 5 and r.quality is not None}
    rows = [r for r in stats.collect() if r.doc_id in known]
    waves = model.features(np.array([r.stats for r in rows]))
    label = np.array([float(known[r.doc_id]) for r in rows])
    penalty = np.eye(waves.shape[1]) * quality.RIDGE
    penalty[-1, -1] = 1e-9
    weights = np.linalg.solve(waves.T @ waves + penalty, waves.T @ label)
    assert np.allclose(waves @ weights, waves @ model.weights, atol=1e-4)
    scores = {r.doc_id: r.score for r in quality.score(stats, model).collect()}
    order = np.argsort(waves @ model.weights)
    fitted = np.array([scores[rows[i].doc_id] for i in order])
    assert (np.diff(fitted) >= -1e-9).all() and fitted.min() >= 0 and fitted.max() <= 1
    assert abs(fitted.mean() - label.mean()) < 0.05


def test_the_language_fit_equals_plain_regression_on_collected_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = language.fit(docs)
    across, names = [], []
    for row in docs.select("doc_id", "text", "lang").collect():
        if row.lang is not None and row.text is not None and zlib.crc32(str(row.doc_id).encode()) % 4 != 2:
            for at in range(0, max(1, len(row.text)), language.WINDOW):
                values, lettered = model.kernel.rows([row.text[at : at + language.WINDOW]])
                if lettered[0]:
                    across.append(values[0])
                    names.append(row.lang)
    k = np.array(across, float)
    landmarks = model.kernel.landmarks.astype(float)
    targets = np.array([[1.0 if name == lang else -1.0 for lang in model.languages] for name in names])
    gram = k.T @ k + language.RIDGE * len(k) * landmarks @ landmarks.T + 1e-8 * len(k) * np.eye(k.shape[1])
    assert np.allclose(k @ np.linalg.solve(gram, k.T @ targets), k @ model.weights, atol=1e-4)


def test_ngrams_of_any_script_are_told_apart():
    kernel = language.kernel_of(["漢字仮名", "한글문자", "abcdef", "абвгде", "ああああ"])
    values, lettered = kernel.rows(["漢字", "한글", "abc", "абв", "ああ"])
    assert lettered.all() and (values.argmax(axis=1) == np.arange(5)).all()
    assert (np.sort(values, axis=1)[:, :-1] < 1e-6).all()


def test_a_landmark_may_be_any_window():
    texts = ["".join(chr(97 + (n + k) % 26) for k in range(3 * language.WINDOW)) for n in range(40)]
    places = {language.windows([text])[1].index(language.landmark(text)) for text in texts}
    assert places == {0, 1, 2}
