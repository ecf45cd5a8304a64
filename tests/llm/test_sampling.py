"""Samples: their size, and that they do not run empty on very large tables."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from clusterlens.llm import language, sampling, toxicity


def test_shares_of_very_large_groups():
    limits = sampling.limits({"a": 10**11, "b": 10**4, "c": 10}, 3_000)
    assert limits["c"] == 2**63 - 1
    for name, n in (("a", 10**11), ("b", 10**4)):
        assert 0.999 < limits[name] / 2**63 * n / 1_000 < 1.001


@pytest.mark.parametrize("salt", [0, 1])
def test_numbers_are_spread_over_63_bits(spark, salt):
    ids = spark.range(40_000).select(sampling.drawn_number("id", salt).alias("n"))
    values = np.array([r.n for r in ids.collect()])
    assert values.min() >= 0 and values.max() > 2**62 and len(set(values.tolist())) == 40_000
    assert np.abs(np.histogram(values / 2**63, 16, (0, 1))[0] - 2_500).max() < 300
    low = values & (2**43 - 1)  # the bits below the first twenty
    assert np.abs(np.histogram(low / 2**43, 16, (0, 1))[0] - 2_500).max() < 300


def test_draws_cut_to_their_bound_and_by_group(spark):
    rows = spark.range(30_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "x").otherwise("y").alias("g"))
    assert 800 < sampling.draw(rows, 1_000).count() < 1_200
    counts = {r.g: r["count"] for r in sampling.draw(rows, 1_000, by=F.col("g")).groupBy("g").count().collect()}
    assert all(400 < n < 600 for n in counts.values()) and len(counts) == 2
    assert sampling.draw(rows, 10**6).count() == 30_000
    assert sampling.draw(rows.limit(0), 10).count() == 0


@pytest.fixture
def huge(monkeypatch):
    """As if every group had a hundred billion rows more than it has."""
    sizes = sampling.group_sizes
    monkeypatch.setattr(sampling, "group_sizes", lambda rows, group: {g: n + 10**11 for g, n in sizes(rows, group).items()})


def test_an_empty_sample_is_an_error(spark, huge):
    """So few rows are no sample of so many: refused, instead of a model that knows nothing."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    with pytest.raises(ValueError, match="sample"):
        language.fit(docs)
    with pytest.raises(ValueError, match="sample"):
        toxicity.fit(docs, labels)


def test_samples_that_the_bound_cuts(spark, monkeypatch):
    """Models from small samples of the test data still tell most languages and toxic texts."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    monkeypatch.setattr(language, "EXAMPLES", 400)
    monkeypatch.setattr(language, "LANDMARKS", 40)
    found = language.identify(docs, language.fit(docs)).join(docs.select("doc_id", "lang"), "doc_id")
    right = found.where("lang IS NOT NULL AND doc_id % 7 = 0").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
    assert right > 0.9
    monkeypatch.setattr(toxicity, "UNLABELLED", 1_500)
    scored = toxicity.score(docs, toxicity.fit(docs, labels)).join(labels.where("toxic IS NOT NULL"), "doc_id")
    rates = {r.toxic: r.rate for r in scored.groupBy("toxic").agg(F.avg((F.col("score") >= 0.5).cast("int")).alias("rate")).collect()}
    assert rates[1] > 0.9 and rates[0] < 0.05


def test_confirmed_examples_alone_suffice(spark):
    """No row is labelled harmless: the prior comes from unlabelled text."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    model = toxicity.fit(docs, labels.where("toxic = 1"))
    scored = toxicity.score(docs, model).join(labels.where("toxic IS NOT NULL"), "doc_id")
    rates = {r.toxic: r.rate for r in scored.groupBy("toxic").agg(F.avg((F.col("score") >= 0.5).cast("int")).alias("rate")).collect()}
    assert rates[1] > 0.9 and rates[0] < 0.05
