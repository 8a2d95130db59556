"""Scoring of checked requests, and the check of served scores against offline ones."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cardwatch import schema as S
from cardwatch.operators import metrics, scoring

MODEL_VERSION = "1.0"


def score_checked(checked: DataFrame) -> DataFrame:
    """Rows with errors stay in the result without a score; they are no part of the history of the others."""
    good = checked.where(F.size("errors") == 0)
    scored = scoring.rule_inputs(good).withColumn("fraud_score", scoring.rule_score(scoring.CHAMPION))
    rejected = checked.where(F.size("errors") > 0)
    both = scoring.with_decision(scored).unionByName(rejected, allowMissingColumns=True)
    return both.withColumns({"model_version": F.lit(MODEL_VERSION), "error_count": F.size("errors")})


def api_summary(offline: DataFrame, served: DataFrame, log: DataFrame) -> DataFrame:
    """The validation summary as one JSON document per section: test_info, latency_stats, model_comparison, metrics."""

    def section(name: str, df: DataFrame, columns: list) -> DataFrame:
        return df.select(F.lit(name).alias("section"), F.to_json(F.struct(*columns)).alias("document"))

    counts = served.agg(
        F.count(F.lit(1)).alias("total_transactions"),
        F.sum("is_fraud").alias("fraud_cases"),
        (F.count(F.lit(1)) - F.sum("is_fraud")).alias("legitimate_cases"),
    )
    info = section("test_info", counts, ["total_transactions", "fraud_cases", "legitimate_cases"])
    latency_names = ["mean_ms", "median_ms", "std_ms", "min_ms", "max_ms", "p50_ms", "p95_ms", "p99_ms"]
    latency = section(
        "latency_stats",
        scoring.latency_stats(log),
        [F.round(c, 3).alias(c) for c in [*latency_names, "throughput_per_sec"]],
    )
    agreement = scoring.score_agreement(scoring.compare_scores(served, offline))
    compared = section(
        "model_comparison",
        agreement,
        [
            F.round("mean_difference", 4).alias("mean_difference"),
            F.round("max_difference", 4).alias("max_difference"),
            (F.col("max_difference") < 0.001).alias("predictions_match"),
        ],
    )
    table = metrics.threshold_metrics(served, S.FIXED_THRESHOLDS)
    entry = F.struct(
        F.round("precision", 4).alias("precision"),
        F.round("recall", 4).alias("recall"),
        F.round("f1", 4).alias("f1"),
        F.round(F.col("approval_rate") / 100, 4).alias("approval_rate"),
    )
    # One entry per tested threshold.
    entries = table.groupBy().agg(
        F.array_sort(F.collect_list(F.struct(F.col("threshold").cast("string").alias("key"), entry.alias("value")))).alias("all")
    )
    by_threshold = entries.select(
        F.lit("metrics").alias("section"), F.to_json(F.map_from_entries("all")).alias("document")
    )
    return info.unionByName(latency).unionByName(compared).unionByName(by_threshold)
