"""Rule scores, decisions and the comparison of online with offline scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cardwatch import schema as S
from cardwatch.functions.expressions import decision, ratio, reason, risk_level
from cardwatch.operators.features import add_history, add_row_features
from cardwatch.operators.quantiles import EVERYTHING, exact_quantiles, value_counts

# Rule -> (condition, points). Two rule sets, so that versions can be compared without a fitted model.
RULE_HISTORY = [
    "feat_tx_count_user_1h",
    "feat_time_since_last_tx_mins",
    "feat_country_change",
    "feat_unique_users_per_device_24h",
    "feat_device_fraud_rate_historical",
]
RULE_ROW = ["feat_is_high_risk_country", "feat_is_large_amount", "feat_is_night"]
CHAMPION = {
    "mcc = '7995'": 45,
    "feat_unique_users_per_device_24h >= 5": 12,
    "feat_device_fraud_rate_historical >= 0.05": 15,
    "feat_tx_count_user_1h >= 1": 10,
    "feat_is_high_risk_country = 1": 18,
    "feat_time_since_last_tx_mins < 10": 9,
    "feat_is_night = 1": 11,
    "feat_is_large_amount = 1": 8,
    "feat_country_change = 1": 7,
}
CHALLENGER = {
    "mcc = '7995'": 62,
    "feat_device_fraud_rate_historical >= 0.04": 14,
    "feat_is_high_risk_country = 1": 6,
    "feat_is_night = 1": 9,
    "feat_is_large_amount = 1": 5,
}
RULE_CENTER = 50
RULE_SCALE = 12


def rule_points(rules: dict[str, int]) -> Column:
    total = F.lit(0)
    for condition, points in rules.items():
        total = total + F.when(F.expr(condition), F.lit(points)).otherwise(F.lit(0))
    return total


def rule_score(rules: dict[str, int]) -> Column:
    """Points on a logistic scale between 0 and 1."""
    points = rule_points(rules).cast("double")
    return F.round(1 / (1 + F.exp(-(points - RULE_CENTER) / RULE_SCALE)), 6)


def rule_inputs(df: DataFrame) -> DataFrame:
    """Transactions with the features the rules read: one shuffle by user and one by device."""
    return add_row_features(add_history(df, RULE_HISTORY), RULE_ROW)


def with_decision(df: DataFrame, score: str = "fraud_score", threshold: float = S.BLOCK_THRESHOLD) -> DataFrame:
    """Bands are taken from the unrounded score; the score shown has 4 decimals."""
    decided = decision(F.col(score), threshold)
    return df.withColumns(
        {
            "decision": decided,
            "risk_level": risk_level(decided),
            "reason": reason(F.col(score), decided),
        }
    ).withColumn(score, F.round(score, 4))


def decision_distribution(df: DataFrame) -> DataFrame:
    """Rows and percentage per decision; the total is summed over the few decisions, not over the rows."""
    counts = df.groupBy("decision").agg(F.count(F.lit(1)).alias("n")).withColumn(EVERYTHING, F.lit(0))
    total = counts.groupBy(EVERYTHING).agg(F.sum("n").alias("total"))
    return counts.join(total, EVERYTHING).select(
        "decision", "n", (F.col("n") * 100.0 / F.col("total")).cast("double").alias("percent")
    )


def history_stores(df: DataFrame, until: Column, days: int = 7) -> dict[str, DataFrame]:
    """Figures of users, merchants and devices over the ``days`` days before ``until``, one short-lived store each."""
    week = df.where((F.col("ts") < until) & (F.col("ts") >= until - F.make_dt_interval(F.lit(days))))
    amounts = {
        entity: [F.avg("amount").alias(f"{entity}_avg_amount"), F.stddev_samp("amount").alias(f"{entity}_std_amount")]
        for entity in ("user", "merchant")
    }
    countries = F.count_distinct("country")
    rate = F.avg("is_fraud")
    return {
        "user_id": week.where("user_id IS NOT NULL").groupBy("user_id").agg(
            *amounts["user"],
            countries.alias("feat_unique_countries_user_7d"),
            rate.alias("feat_user_fraud_rate_historical"),
        ),
        "merchant_id": week.where("merchant_id IS NOT NULL").groupBy("merchant_id").agg(
            *amounts["merchant"], rate.alias("feat_merchant_fraud_rate_historical")
        ),
        "device_id": week.where("device_id IS NOT NULL").groupBy("device_id").agg(
            countries.alias("feat_unique_countries_per_device_7d"), rate.alias("feat_device_fraud_rate_historical")
        ),
    }


def with_history_defaults(df: DataFrame, stores: dict[str, DataFrame] | None = None) -> DataFrame:
    """Features of a request from stores by key, with a fixed value where they have none.

    Without stores every history feature is its default, which is what the service computes when the store is down.
    """
    work = df
    stored: set[str] = set()
    for key, history in (stores or {}).items():
        stored |= set(history.columns) - {key}
        work = work.join(history.withColumnRenamed(key, "_key"), work[key] == F.col("_key"), "left").drop("_key")

    def value(name: str, otherwise: Column) -> Column:
        return F.coalesce(F.col(name), otherwise) if name in stored else otherwise

    amount = F.col("amount")
    constants = {n: F.lit(v) for n, v in S.HISTORY_DEFAULTS.items() if n.startswith("feat_")}
    features = {n: value(n, v) for n, v in constants.items()}
    features["feat_amount_sum_user_24h"] = value("feat_amount_sum_user_24h", amount * 3)
    features["feat_amount_avg_user_24h"] = value("feat_amount_avg_user_24h", amount)
    for entity in ("user", "merchant"):
        mean = value(f"{entity}_avg_amount", F.lit(S.HISTORY_DEFAULTS[f"{entity}_avg_amount"]))
        spread = value(f"{entity}_std_amount", F.lit(S.HISTORY_DEFAULTS[f"{entity}_std_amount"]))
        features[f"feat_amount_vs_{entity}_avg"] = (amount - mean) / (spread + 1)
    features["feat_amount_percentile_user"] = F.least(amount / 1000, F.lit(1.0))
    features["feat_user_country_entropy"] = value("feat_user_country_entropy", F.lit(0.0))
    out = work.withColumns(features)
    rows = [n for n in S.ALL_FEATURES if n not in features]
    out = add_row_features(out, rows)
    return out.select(*df.columns, *S.ALL_FEATURES)


def compare_scores(online: DataFrame, offline: DataFrame) -> DataFrame:
    """Absolute difference per transaction, matched by id and never by position."""
    left = online.select("transaction_id", F.col("fraud_score").alias("online_score"))
    right = offline.select("transaction_id", F.col("fraud_score").alias("offline_score"))
    joined = left.join(right, "transaction_id")
    return joined.withColumn("difference", F.round(F.abs(F.col("online_score") - F.col("offline_score")), 6))


def score_agreement(compared: DataFrame) -> DataFrame:
    counts = value_counts(compared, [], "difference")
    n, d = F.col("n"), F.col("difference")
    size = F.sum("n")
    mean = F.sum(n * d) / size
    # Deviation from the distinct values, shifted by none: differences lie between 0 and 1.
    spread = F.sqrt(F.greatest(F.sum(n * d * d) / size - mean * mean, F.lit(0.0)))
    stats = counts.groupBy(EVERYTHING).agg(
        size.alias("n"),
        mean.alias("mean_difference"),
        F.max("difference").alias("max_difference"),
        spread.alias("std_difference"),
        F.sum(F.when(d < 0.0001, n).otherwise(0)).alias("within_0001"),
        F.sum(F.when(d < 0.001, n).otherwise(0)).alias("within_001"),
        F.sum(F.when(d < 0.01, n).otherwise(0)).alias("within_01"),
    )
    median = exact_quantiles(counts, [], "difference", [0.5]).select(
        EVERYTHING, F.col("quantile").alias("median_difference")
    )
    worst = F.col("max_difference")
    verdict = (
        F.when(worst < 0.001, F.lit("EXCELLENT")).when(worst < 0.01, F.lit("GOOD")).otherwise(F.lit("WARNING"))
    )
    return stats.join(median, EVERYTHING).drop(EVERYTHING).withColumn("verdict", verdict)


def latency_stats(log: DataFrame, latency: str = "latency_ms") -> DataFrame:
    """Latency figures of a request log; requests per second is rows over summed latency."""
    counts = value_counts(log, [], latency)
    wide = log.where(F.col(latency).isNotNull()).agg(
        F.count(F.lit(1)).alias("requests"),
        F.avg(latency).alias("mean_ms"),
        F.stddev_pop(latency).alias("std_ms"),
        F.min(latency).alias("min_ms"),
        F.max(latency).alias("max_ms"),
        ratio(F.count(F.lit(1)), F.sum(latency) / 1000, None).alias("throughput_per_sec"),
    )
    points = exact_quantiles(counts, [], latency, [0.5, 0.95, 0.99])
    named = points.groupBy(EVERYTHING).agg(
        *[
            F.max(F.when(F.col("prob") == p, F.col("quantile"))).alias(name)
            for name, p in {"median_ms": 0.5, "p50_ms": 0.5, "p95_ms": 0.95, "p99_ms": 0.99}.items()
        ]
    )
    return wide.withColumn(EVERYTHING, F.lit(0)).join(named, EVERYTHING).drop(EVERYTHING)
