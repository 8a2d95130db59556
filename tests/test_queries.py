"""Every registered query against its SQL, and again with all keys cut into slices."""

import re

import pytest
from compare import SMALL, difference

import __spark_entry__ as entry

QUERIES, ORACLES = entry.queries(), entry.oracle_sql()
WITHOUT_SQL = {"lr_scores", "gbt_scores", "feature_importance", "fitted_model_comparison"}
SLICED = [
    "velocity_features",
    "device_risk_features",
    "geo_features",
    "country_entropy",
    "historical_risk_label_aware",
    "amount_zscore_pit",
    "amount_percentile_full",
    "amount_percentile_pit",
    "history_asof",
    "latency_stats",
    "roc_auc",
    "score_drift",
]


def test_only_fitted_models_lack_sql():
    assert {n for n in set(QUERIES) - set(ORACLES) if not re.match(r"op\d|pipeline", n)} == WITHOUT_SQL
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, con, name):
    assert difference(QUERIES[name](spark, SMALL), con, ORACLES[name]) is None


@pytest.mark.parametrize("name", SLICED)
def test_matches_sql_with_hot_keys(sliced, con, name):
    assert difference(QUERIES[name](sliced, SMALL), con, ORACLES[name]) is None


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns[0] == "transaction_id" and df.count() == 1000


def test_fitted_models(spark):
    table = QUERIES["fitted_model_comparison"](spark, SMALL).collect()
    assert {(r.model, r.strategy) for r in table} == {
        (m, s) for m in ("logistic regression", "boosted trees") for s in ("F1", "80% Recall", "1% FPR")
    }
    scores = QUERIES["lr_scores"](spark, SMALL).collect()
    assert scores and all(0 <= r.fraud_score <= 1 for r in scores)
