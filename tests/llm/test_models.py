"""Fitted models: held-out accuracy, defined results on awkward rows, exact selection."""

import numpy as np
import pytest
from frames import awkward, empty
from pyspark.sql import functions as F

import cardwatch.llm.resampling as resampling
from cardwatch.llm.queries import QUERIES, table
from cardwatch.llm.resampling import kth_largest, log_ratios, resample
from cardwatch.llm.toxicity import SeverityModel, add_severity, fit_ordinal, fit_severity

FOLDER = "/root/testdata/sf0.1"


def test_held_out_toxic_documents(spark):
    docs = table(spark, FOLDER, "documents").select("doc_id", "text")
    labels = table(spark, FOLDER, "labels").select("doc_id", "toxic")
    model = fit_severity(docs, labels.where("doc_id % 2 = 0"))
    held = add_severity(docs.join(labels.where("doc_id % 2 = 1"), "doc_id").withColumnRenamed("toxic", "truth"), model)
    rows = held.select("truth", "toxic", "expected_severity").collect()
    hit = sum(r.toxic for r in rows if r.truth) / sum(r.truth for r in rows)
    wrong = sum(r.toxic for r in rows if not r.truth) / sum(1 - r.truth for r in rows)
    assert hit > 0.9 and wrong < 0.01
    assert all(0 <= r.expected_severity <= 3 for r in rows) and {round(r.expected_severity) for r in rows} == {0, 1, 2, 3}


def test_ordinal_fit_recovers_order():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(3000, 2))
    margin = x @ [2.0, -1.0] + rng.logistic(size=3000)
    grades = np.digitize(margin, [-1.0, 0.5, 2.0])
    w, limits = fit_ordinal(np.repeat(np.arange(3000), 2), np.tile([0, 1], 3000), x.ravel(), grades, 2)
    assert np.allclose(w, [2, -1], atol=0.3) and np.allclose(limits, [-1, 0.5, 2], atol=0.3)


def test_severity_of_awkward_rows(spark):
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, 0), (5, None), (None, 1), (4, 0)], "doc_id long, toxic int")
    model = fit_severity(awkward(spark), labels)
    got = add_severity(awkward(spark), model)
    assert got.count() == 11 and got.columns == ["doc_id", "text", "n_lines", "pos", "id", "expected_severity", "toxic"]
    assert got.where("expected_severity IS NULL OR isnan(expected_severity)").count() == 0
    assert add_severity(empty(spark), model).collect() == []
    for none in (labels.where("false"), labels.where("toxic = 0")):
        assert fit_severity(awkward(spark), none) == SeverityModel()
    assert {(r.expected_severity, r.toxic) for r in add_severity(awkward(spark), SeverityModel()).collect()} == {(0.0, False)}


def test_resampling_prefers_target_like_text(spark):
    labels = {r.doc_id: r.quality for r in table(spark, FOLDER, "labels").collect()}
    got = QUERIES["op8_quality_resampling"](spark, FOLDER).collect()
    kept = {r.doc_id for r in got}
    good = [d for d, q in labels.items() if q == 1]
    poor = [d for d, q in labels.items() if q == 0]
    assert len(got) == 8000 == len(kept)
    assert np.mean([d in kept for d in good]) > 0.95 and np.mean([d in kept for d in poor]) < 0.2
    weights = {r.doc_id: (r.log_weight, r.gumbel_key) for r in got}
    again = {r.doc_id: (r.log_weight, r.gumbel_key) for r in QUERIES["op8_quality_resampling"](spark, FOLDER).collect()}
    assert weights == again


def test_resampling_of_awkward_rows(spark):
    docs = awkward(spark)
    ratios = log_ratios(docs, docs.select("doc_id").where("doc_id < 3").withColumnRenamed("doc_id", "id"))
    assert len(resample(docs, ratios, keep=1.0).collect()) == 11
    some = resample(docs, ratios, keep=0.5).collect()
    assert 5 <= len(some) <= 6  # rows alike stay together
    assert resample(docs, ratios, keep=0.01).collect() == []
    none = empty(spark)
    assert resample(none, log_ratios(none, none.select("doc_id").withColumnRenamed("doc_id", "id"))).collect() == []


def test_counts_add_up_in_rounds(spark, monkeypatch):
    """More tasks than one place adds up, against one task."""
    docs = table(spark, FOLDER, "documents").select("doc_id", "text").where("doc_id < 400")
    good = docs.where("doc_id % 3 = 0").select(F.col("doc_id").alias("id"))
    want = log_ratios(docs.coalesce(1), good)
    monkeypatch.setattr(resampling, "MERGE_WAYS", 3)
    assert np.array_equal(log_ratios(docs.repartition(23), good), want)


def test_equal_keys_at_the_border(spark):
    """Texts without words have the same weight; with one hash all keys are equal and the smaller ids stay."""
    docs = spark.createDataFrame([(i, "same text of all") for i in range(20)], "doc_id long, text string")
    weights = resample(docs, np.zeros(resampling.BUCKETS), keep=0.5)
    keys = sorted(((-r.gumbel_key, r.doc_id) for r in resample(docs, np.zeros(resampling.BUCKETS), keep=1.0).collect()))
    assert {r.doc_id for r in weights.collect()} == {d for _, d in keys[:10]}


@pytest.mark.parametrize("values", [[1.0] * 50, [float(i % 7) for i in range(100)], [-1e300, 5e-324, 0.0, 1.5, 1e300, 1e-300]])
def test_kth_largest(spark, values):
    frame = spark.createDataFrame([(v,) for v in values], "x double")
    ordered = sorted(values, reverse=True)
    for k in (1, len(values) // 2, len(values)):
        value, rank = kth_largest(frame, "x", k)
        assert value == ordered[k - 1] and rank == k - sum(v > value for v in values)
