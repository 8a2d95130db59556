"""Published figures recomputed, and sweeps against scans per threshold."""

import math
import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cardwatch.operators import curves, drift, metrics, scoring, splits
from cardwatch.operators.quantiles import EVERYTHING, bucket_of, exact_quantiles, row_at_rank, value_counts

SCORED = "transaction_id bigint, fraud_score double, is_fraud int, amount double"


@pytest.fixture(scope="module")
def scored(spark):
    rng = random.Random(7)
    rows = []
    for i in range(500):
        fraud = int(rng.random() < 0.2)
        score = min(1.0, max(0.0, round(rng.gauss(0.7 if fraud else 0.4, 0.2), 2)))
        rows.append((i, score, fraud, round(rng.uniform(1, 900), 2)))
    return rows, spark.createDataFrame(rows, SCORED).cache()


def test_published_confusion_and_business_figures(spark):
    """78 frauds caught, 19 missed, 48 alerts on legitimate rows, 25,021 rows approved."""
    groups = [(78, 0.99, 1, 6473238), (19, 0.1, 1, 685219), (48, 0.99, 0, 5595679), (25021, 0.1, 0, 2502100)]
    rows = []
    for n, score, fraud, cents in groups:
        base = cents // n
        rows += [(len(rows) + i, score, fraud, (base + (cents - base * n if i == 0 else 0)) / 100) for i in range(n)]
    df = spark.createDataFrame(rows, SCORED)
    m = metrics.threshold_metrics(df, [0.95]).first()
    assert (m.true_positives, m.false_positives, m.false_negatives, m.true_negatives) == (78, 48, 19, 25021)
    assert [round(x, 3) for x in (m.precision, m.recall, m.fpr, m.dollar_recall, m.approval_rate)] == [
        0.619, 0.804, 0.002, 90.428, 99.499,
    ]
    assert (m.fraud_caught_dollars, m.fraud_missed_dollars, m.legit_blocked_dollars) == (64732.38, 6852.19, 55956.79)
    roi = metrics.roi_analysis(metrics.threshold_metrics(df, [0.95])).first()
    assert round(roi.roi_percent) == 1955 and roi.review_cost == 3150
    assert round(roi.dollars_per_case, 2) == 829.90 and round(roi.dollars_per_alert, 2) == 513.75
    assert round(roi.annual_net_benefit, 2) == 246329.52 and round(roi.monthly_net_benefit, 2) == 20527.46


def test_sweep_equals_scans(scored):
    rows, df = scored
    got = {r.threshold: r for r in metrics.threshold_metrics(df, metrics.threshold_grid()).collect()}
    assert len(got) == 100
    recall = 1.1
    for t in metrics.threshold_grid():
        tp = sum(s >= t and f for _, s, f, _ in rows)
        fp = sum(s >= t and not f for _, s, f, _ in rows)
        m = got[t]
        assert (m.true_positives, m.false_positives) == (tp, fp)
        assert m.true_positives + m.false_positives + m.true_negatives + m.false_negatives == len(rows)
        assert m.recall <= recall
        recall = m.recall


def test_strategies(scored):
    rows, df = scored
    sweep = metrics.threshold_metrics(df, metrics.threshold_grid())
    table = sorted(sweep.collect(), key=lambda m: m.threshold)

    def first_best(allowed, target):
        best, at = 0, 0.5
        for m in table:
            if allowed(m) and round(m[target], 12) > best:
                best, at = round(m[target], 12), m.threshold
        return at

    assert metrics.optimal_threshold(sweep, "F1").first().threshold == first_best(lambda m: True, "f1")
    assert metrics.optimal_threshold(sweep, "80% Recall").first().threshold == first_best(
        lambda m: m.recall >= 0.8, "precision"
    )
    assert metrics.optimal_threshold(sweep, "1% FPR").first().threshold == first_best(lambda m: m.fpr <= 0.01, "recall")


def test_no_frauds_gives_the_default_threshold(spark):
    df = spark.createDataFrame([(1, 0.3, 0, 5.0), (2, 0.99, 0, 6.0)], SCORED)
    sweep = metrics.threshold_metrics(df, metrics.threshold_grid())
    assert metrics.optimal_threshold(sweep, "F1").first().threshold == 0.5
    assert curves.roc_auc(df).first().roc_auc is None
    assert curves.average_precision(df).first().average_precision == 0.0


def test_curves(scored):
    rows, df = scored
    pos = [s for _, s, f, _ in rows if f]
    neg = [s for _, s, f, _ in rows if not f]
    auc = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))
    assert curves.roc_auc(df).first().roc_auc == pytest.approx(auc)
    ap, last = 0.0, 0.0
    for t in sorted({s for _, s, _, _ in rows}, reverse=True):
        tp, hits = sum(p >= t for p in pos), sum(s >= t for _, s, _, _ in rows)
        ap += (tp / len(pos) - last) * tp / hits
        last = tp / len(pos)
    assert curves.average_precision(df).first().average_precision == pytest.approx(ap)


def test_bucket_of(spark):
    edges = metrics.threshold_grid()
    values = [0.0, 0.01, 0.5, 0.99, 1.0, edges[37]]
    df = spark.createDataFrame([(v,) for v in values], "v double").withColumn("b", bucket_of(F.col("v"), edges))
    assert [r.b for r in df.collect()] == [sum(e <= v for e in edges) for v in values]


@pytest.mark.parametrize("rows_per_slice", [None, "40"])
def test_quantiles_and_ranks(spark, rows_per_slice):
    if rows_per_slice:
        spark.conf.set("spark.cardwatch.sliceRows", rows_per_slice)
    try:
        rng = np.random.default_rng(3)
        values = np.round(rng.exponential(10, 700), 1)
        df = spark.createDataFrame([(float(v),) for v in values], "x double")
        probs = [0, 0.1, 0.25, 0.5, 0.95, 1]
        got = exact_quantiles(value_counts(df, [], "x"), [], "x", probs).orderBy("prob").collect()
        assert [r.quantile for r in got] == pytest.approx(list(np.percentile(values, [p * 100 for p in probs])))
        assert EVERYTHING in got[0].asDict()
    finally:
        spark.conf.unset("spark.cardwatch.sliceRows")


def test_row_at_rank_narrows(spark):
    rng = random.Random(1)
    points = [(rng.randrange(10**12) if i % 3 else 777, i) for i in range(2000)]
    df = spark.createDataFrame(points, "at bigint, id bigint")
    ordered = sorted(points)
    for rank in (0, 1, 500, 1000, 1999):
        found = row_at_rank(df, F.col("at"), F.col("id"), rank)
        assert (found["at"], found["tie"]) == ordered[rank]
    assert row_at_rank(df, F.col("at"), F.col("id"), 2000) is None


def test_row_at_rank_within_one_time(spark):
    """Many rows of one time: the id decides, as a number or as a text, and no row is sorted to a top."""
    same = spark.range(200_000).select(F.lit(5).alias("at"), "id", F.concat(F.lit("TXN_"), "id").alias("name"))
    names = sorted(f"TXN_{i}" for i in range(200_000))
    for rank in (0, 150_000, 199_999):
        assert row_at_rank(same, F.col("at"), F.col("id"), rank) == {"at": 5, "tie": rank}
        assert row_at_rank(same, F.col("at"), F.col("name"), rank) == {"at": 5, "tie": names[rank]}
    split = splits.rowcount_split(same.select(F.lit(dt.datetime(2024, 1, 1)).cast("timestamp_ntz").alias("ts"), F.col("id").alias("transaction_id")))
    assert "TakeOrdered" not in split._jdf.queryExecution().toString()
    assert split.where("side = 'baseline'").count() == 150_000


def plain_psi(base, prod, bins=10):
    """From the definition: cut points by interpolating the sorted baseline, then one comparison per value and bin."""
    ordered, cuts = sorted(base), []
    for i in range(bins + 1):
        low, part = divmod(i * (len(ordered) - 1), bins)
        high = ordered[min(low + 1, len(ordered) - 1)]
        cut = ordered[low] + (high - ordered[low]) * (part / bins)
        if not cuts or cut > cuts[-1]:
            cuts.append(cut)
    total = 0.0
    for low, high in zip(cuts, cuts[1:]):
        share = []
        for values in (base, prod):
            inside = sum(1 for v in values if low <= v < high or v == high == cuts[-1])
            share.append(max(inside / len(values), 1e-10))
        total += (share[1] - share[0]) * math.log(share[1] / share[0])
    return total


def test_psi_matches_numpy(spark):
    rng = np.random.default_rng(5)
    columns = {
        "normal": (rng.normal(0, 1, 400), rng.normal(0.5, 1.5, 150)),
        "ties": (rng.integers(0, 6, 400).astype(float), rng.integers(2, 9, 150).astype(float)),
        "constant": (np.ones(400), np.ones(150)),
        "binary": ((rng.random(400) < 0.3).astype(float), (rng.random(150) < 0.8).astype(float)),
    }
    names = list(columns)
    rows = [("baseline", *[float(columns[c][0][i]) for c in names]) for i in range(400)]
    rows += [("production", *[float(columns[c][1][i]) for c in names]) for i in range(150)]
    df = spark.createDataFrame(rows, "side string, " + ", ".join(f"{c} double" for c in names))
    report = {r.feature: r for r in drift.feature_drift(df, names).collect()}
    for c in names:
        assert report[c].psi == pytest.approx(plain_psi(*columns[c]), abs=1e-9)
        assert report[c].baseline_mean == pytest.approx(columns[c][0].mean())
        assert report[c].production_std == pytest.approx(columns[c][1].std(), abs=1e-6)
    categorical = {r.feature: r.psi for r in drift.categorical_psi(drift.side_counts(df, names)).collect()}
    assert report["binary"].psi < categorical["binary"] and categorical["binary"] > 0.25


def test_psi_edges(spark):
    shape = "side string, x double"
    same = [("baseline", float(i)) for i in range(50)] + [("production", float(i)) for i in range(50)]
    assert drift.feature_drift(spark.createDataFrame(same, shape), ["x"]).first().psi == 0
    for part, seen, missing in ((same[:50], "baseline", "production"), (same[50:], "production", "baseline")):
        row = drift.feature_drift(spark.createDataFrame(part, shape), ["x"]).first()
        assert row.psi == 0 and row[f"{seen}_mean"] == 24.5 and row[f"{missing}_mean"] is None and row[f"{missing}_std"] is None


def test_deviation_of_large_values(spark):
    rows = [(side, v) for side in ("baseline", "production") for v in (1e9, 1e9 + 1)]
    row = drift.feature_drift(spark.createDataFrame(rows, "side string, x double"), ["x"]).first()
    assert row.baseline_std == 0.5 and row.production_std == 0.5


def test_score_drift_from_zero(spark):
    shape = "side string, fraud_score double"
    zero = spark.createDataFrame([("baseline", 0.0)] * 9 + [("production", 0.0)] * 9, shape)
    row = drift.score_drift(zero).first()
    assert row.mean_shift_percent is None and row.status == "Stable"
    up = spark.createDataFrame([("baseline", 0.0)] * 9 + [("production", 0.5)] * 9, shape)
    assert drift.score_drift(up).first().mean_shift_percent is None


def test_ks(spark):
    rng = np.random.default_rng(8)
    a, b = np.round(rng.normal(0, 1, 300), 2), np.round(rng.normal(0.3, 1, 200), 2)
    rows = [("baseline", float(v)) for v in a] + [("production", float(v)) for v in b]
    got = curves.ks_two_sample(spark.createDataFrame(rows, "side string, x double"), "x").first()
    grid = np.unique(np.concatenate([a, b]))
    expected = max(abs((a <= v).mean() - (b <= v).mean()) for v in grid)
    assert got.ks_statistic == pytest.approx(expected) and 0 <= got.ks_pvalue <= 1
    same = spark.createDataFrame([(s, float(v)) for v in a for s in ("baseline", "production")], "side string, x double")
    assert tuple(curves.ks_two_sample(same, "x").first()) == (0.0, 1.0)


KPIS = (
    "total_transactions bigint, predicted_fraud_count bigint, approval_rate double, fraud_detection_rate double, "
    "precision double, actual_fraud_count bigint"
)


@pytest.mark.parametrize(
    "row, alerts",
    [
        ((100, 1, 99.0, 80.0, 60.0, 1), ["All metrics"]),
        ((100, 10, 90.0, 80.0, 60.0, 8), ["ALERT: Approval rate 90.0%"]),
        ((100, 0, 100.0, 0.0, 0.0, 5), ["ALERT: Fraud detection rate 0.0%"]),
        ((100, 0, 100.0, 0.0, 0.0, 0), ["All metrics"]),
        ((100, 10, 90.0, 10.0, 10.0, 8), ["ALERT: Approval", "ALERT: Fraud", "WARNING: Precision 10.0%"]),
    ],
)
def test_alerts(spark, row, alerts):
    got = sorted(r.alert for r in drift.kpi_alerts(spark.createDataFrame([row], KPIS)).collect())
    assert len(got) == len(alerts) and all(g.startswith(a) for g, a in zip(got, alerts))


def test_sustained_breach(spark):
    days = [("a", f"2024-01-{d:02d}", 90.0) for d in (1, 2, 3, 5, 6, 8, 9, 10, 11)] + [("b", "2024-01-01", 99.0)]
    df = spark.createDataFrame(days, "model string, day string, approval_rate double").selectExpr(
        "model", "CAST(day AS DATE) AS day", "approval_rate"
    )
    got = sorted((str(r.first_day), r.days) for r in drift.sustained_breach(df).collect())
    assert got == [("2024-01-01", 3), ("2024-01-08", 4)]


def test_decision_bands(spark):
    df = spark.createDataFrame([(1, 0.95), (2, 0.9499), (3, 0.7), (4, 0.6649), (5, 0.87654)], "transaction_id int, fraud_score double")
    got = {r.transaction_id: r for r in scoring.with_decision(df).collect()}
    assert [got[i].decision for i in (1, 2, 3, 4)] == ["BLOCK", "REVIEW", "REVIEW", "APPROVE"]
    assert got[5].reason == "Moderate fraud score (87.7%) - requires manual review" and got[5].fraud_score == 0.8765


def test_sample_does_not_depend_on_partitions(spark):
    df = spark.range(1000).withColumnRenamed("id", "transaction_id")
    first = {r[0] for r in splits.deterministic_sample(df.repartition(7), 50).collect()}
    assert first == {r[0] for r in splits.deterministic_sample(df.coalesce(1), 50).collect()} and len(first) == 50
