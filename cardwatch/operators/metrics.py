"""Confusion, dollar and approval metrics at one or many thresholds."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cardwatch import schema as S
from cardwatch.functions.expressions import cents, ratio
from cardwatch.operators.quantiles import bucket_of

COMPARISON_COLUMNS = [
    "threshold",
    "precision",
    "recall",
    "fpr",
    "dollar_recall",
    "approval_rate",
    "fraud_caught_dollars",
    "fraud_missed_dollars",
    "legit_blocked_dollars",
    "true_positives",
    "false_positives",
    "false_negatives",
    "true_negatives",
]


def threshold_grid(size: int = 100) -> list[float]:
    return [float(t) for t in np.linspace(0.01, 0.99, size)]


def _sums() -> dict[str, Column]:
    return {
        "n": F.count(F.lit(1)),
        "frauds": F.sum("is_fraud"),
        "cents": F.sum(cents(F.col("amount"))),
        "fraud_cents": F.sum(F.when(F.col("is_fraud") == 1, cents(F.col("amount"))).otherwise(F.lit(0))),
    }


def threshold_counts(scored: DataFrame, thresholds: list[float], by: list[str] | None = None) -> DataFrame:
    """Counts and cents at or above each threshold, and in total.

    One pass puts every row between two thresholds; the rest works on at most (thresholds + 1) rows per group.
    """
    by = by or []
    edges = sorted(thresholds)
    level = bucket_of(F.col("fraud_score"), edges).alias("_level")
    banded = scored.groupBy(*by, level).agg(*[agg.alias(name) for name, agg in _sums().items()])
    points = F.array(
        *[F.struct(F.lit(i + 1).alias("position"), F.lit(t).alias("threshold")) for i, t in enumerate(edges)]
    )
    spread = banded.withColumn("_point", F.explode(points))
    hit = F.col("_level") >= F.col("_point.position")
    return spread.groupBy(*by, F.col("_point.threshold").alias("threshold")).agg(
        *[F.sum(name).alias(name) for name in _sums()],
        *[F.sum(F.when(hit, F.col(name)).otherwise(F.lit(0))).alias(f"hit_{name}") for name in _sums()],
    )


def _metrics(counts: DataFrame, by: list[str]) -> DataFrame:
    tp = F.col("hit_frauds")
    fp = F.col("hit_n") - F.col("hit_frauds")
    fn = F.col("frauds") - F.col("hit_frauds")
    tn = F.col("n") - F.col("hit_n") - fn
    precision, recall = ratio(tp, tp + fp), ratio(tp, tp + fn)
    dollars = F.lit(100.0)
    caught, total = F.col("hit_fraud_cents"), F.col("fraud_cents")
    return counts.select(
        *by,
        "threshold",
        precision.alias("precision"),
        recall.alias("recall"),
        ratio(fp, fp + tn).alias("fpr"),
        ratio(2 * precision * recall, precision + recall).alias("f1"),
        tp.alias("true_positives"),
        fp.alias("false_positives"),
        tn.alias("true_negatives"),
        fn.alias("false_negatives"),
        (caught / dollars).alias("fraud_caught_dollars"),
        ((total - caught) / dollars).alias("fraud_missed_dollars"),
        (total / dollars).alias("total_fraud_dollars"),
        (ratio(caught, total) * 100).alias("dollar_recall"),
        ((F.col("hit_cents") - caught) / dollars).alias("legit_blocked_dollars"),
        (ratio(F.col("n") - F.col("hit_n"), F.col("n")) * 100).alias("approval_rate"),
        F.col("hit_n").alias("blocked_transactions"),
    )


def threshold_metrics(scored: DataFrame, thresholds: list[float], by: list[str] | None = None) -> DataFrame:
    """All business metrics at every threshold, one row each."""
    return _metrics(threshold_counts(scored, thresholds, by), by or [])


def confusion_matrix(scored: DataFrame, threshold: float = S.BLOCK_THRESHOLD) -> DataFrame:
    return threshold_metrics(scored, [threshold]).select(
        "threshold", "true_negatives", "false_positives", "false_negatives", "true_positives"
    )


def _strategies() -> dict[str, tuple[Column, str]]:
    return {
        "F1": (F.lit(True), "f1"),
        "80% Recall": (F.col("recall") >= S.TARGET_RECALL, "precision"),
        "1% FPR": (F.col("fpr") <= S.MAX_FPR, "recall"),
    }


def optimal_threshold(metrics: DataFrame, strategy: str, by: list[str] | None = None) -> DataFrame:
    """Best grid threshold of a strategy: the lowest of those with the best value, 0.5 if none has a value above 0."""
    by = by or []
    allowed, target = _strategies()[strategy]
    value = F.round(F.col(target), 12)
    best = F.max(F.when(allowed & (value > 0), F.struct(value.alias("value"), (-F.col("threshold")).alias("minus"))))
    return (
        metrics.groupBy(*by)
        .agg(best.alias("best"))
        .select(
            *by,
            F.lit(strategy).alias("strategy"),
            F.coalesce(-F.col("best.minus"), F.lit(0.5)).alias("threshold"),
            F.coalesce(F.col("best.value"), F.lit(0.0)).alias("value"),
        )
    )


def model_comparison(scored: DataFrame) -> DataFrame:
    """Models (column ``model``) times strategies, each at its own best threshold, 3 decimals.

    The sweep has 100 rows per model; the metrics of the chosen thresholds are looked up in it instead of rescanning.
    """
    grid = [*threshold_grid(), 0.5]
    sweep = threshold_metrics(scored, grid, ["model"])
    search = sweep.where(F.col("threshold") != 0.5)
    picks = None
    for strategy in _strategies():
        pick = optimal_threshold(search, strategy, ["model"]).drop("value")
        picks = pick if picks is None else picks.unionByName(pick)
    joined = picks.join(sweep, ["model", "threshold"])
    columns = [F.round(c, 3).alias(c) if c in COMPARISON_COLUMNS[:9] else F.col(c) for c in COMPARISON_COLUMNS]
    return joined.select("model", "strategy", *columns)


def segment_metrics(scored: DataFrame, threshold: float = S.BLOCK_THRESHOLD) -> DataFrame:
    """Metrics by country, by MCC and by amount band from one pass over grouping sets."""
    band = (
        F.when(F.col("amount") < S.SMALL_AMOUNT, F.lit("small"))
        .when(F.col("amount") > S.LARGE_AMOUNT, F.lit("large"))
        .otherwise(F.lit("medium"))
    )
    hit = F.col("fraud_score") >= F.lit(threshold)
    work = scored.withColumn("amount_band", band)
    sums = _sums()
    hits = {
        "hit_n": F.count_if(hit),
        "hit_frauds": F.sum(F.when(hit, F.col("is_fraud")).otherwise(0)),
        "hit_cents": F.sum(F.when(hit, cents(F.col("amount"))).otherwise(0)),
        "hit_fraud_cents": F.sum(F.when(hit & (F.col("is_fraud") == 1), cents(F.col("amount"))).otherwise(0)),
    }
    keys = ["country", "mcc", "amount_band"]
    counts = work.groupingSets([[k] for k in keys], *keys).agg(
        F.grouping_id().alias("_set"), *[a.alias(n) for n, a in {**sums, **hits}.items()]
    )
    # grouping_id has a 0 bit for the key that is grouped by.
    dimension = F.when(F.col("_set") == 3, F.lit("country")).when(F.col("_set") == 5, F.lit("mcc"))
    labelled = counts.select(
        dimension.otherwise(F.lit("amount_band")).alias("dimension"),
        F.coalesce(*keys).alias("segment"),
        F.lit(threshold).alias("threshold"),
        *sums,
        *hits,
    )
    return _metrics(labelled, ["dimension", "segment"])


def roi_analysis(metrics: DataFrame, review_cost: float = S.REVIEW_COST, months: int = 3) -> DataFrame:
    """Cost and benefit of reviewing every alert; one month is the period over ``months``, a year is 12 of them."""
    alerts = F.col("true_positives") + F.col("false_positives")
    caught, missed = F.col("fraud_caught_dollars"), F.col("fraud_missed_dollars")
    cost = alerts * F.lit(review_cost)
    net = caught - cost
    monthly = F.lit(1.0 / months)
    yearly = F.lit(12.0 / months)
    money = {
        "alerts": alerts,
        "fraud_prevented": caught,
        "fraud_missed": missed,
        "total_fraud": F.col("total_fraud_dollars"),
        "review_cost": cost,
        "net_benefit": net,
        "roi_percent": ratio(net, cost) * 100,
        "monthly_prevented": caught * monthly,
        "monthly_review_cost": cost * monthly,
        "monthly_net_benefit": net * monthly,
        "monthly_alerts": alerts * monthly,
        "annual_prevented": caught * yearly,
        "annual_review_cost": cost * yearly,
        "annual_net_benefit": net * yearly,
        "annual_alerts": alerts * yearly,
        "dollars_per_case": ratio(caught, F.col("true_positives")),
        "dollars_per_alert": ratio(caught, alerts),
        "annual_loss_without_model": F.col("total_fraud_dollars") * yearly,
        "annual_loss_with_model": missed * yearly,
        "annual_savings": caught * yearly,
    }
    return metrics.select("threshold", *[v.alias(n) for n, v in money.items()])


def daily_kpis(scored: DataFrame, threshold: float = S.BLOCK_THRESHOLD, by: list[str] | None = None) -> DataFrame:
    """Approval, detection, precision and alerts of each day."""
    by = by or []
    hit = F.col("fraud_score") >= F.lit(threshold)
    counts = scored.groupBy(*by, F.to_date("ts").alias("day")).agg(
        F.count(F.lit(1)).alias("transactions"),
        F.count_if(hit).alias("alerts"),
        F.sum("is_fraud").alias("frauds"),
        F.sum(F.when(hit, F.col("is_fraud")).otherwise(0)).alias("caught"),
    )
    return counts.select(
        *by,
        "day",
        "transactions",
        "alerts",
        "frauds",
        (ratio(F.col("transactions") - F.col("alerts"), F.col("transactions")) * 100).alias("approval_rate"),
        (ratio(F.col("caught"), F.col("frauds")) * 100).alias("detection_rate"),
        (ratio(F.col("caught"), F.col("alerts")) * 100).alias("precision_rate"),
    )


def last_days(kpis: DataFrame, days: int) -> DataFrame:
    """The last ``days`` days of a daily table."""
    latest = kpis.agg(F.max("day").alias("d")).first().d
    return kpis.where(F.col("day") > F.date_sub(F.lit(latest), days))
