"""The registered queries. Each takes (spark, folder) and reads the tables of that folder."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cardwatch import schema as S
from cardwatch.operators import curves, drift, features, metrics, quality, retrain, scoring, splits
from cardwatch.plans import monitor, training, validation
from cardwatch.sources.session import materialize, shared_path
from cardwatch.sources.transactions import event_transactions, order_transactions, write_table
from cardwatch.streaming import jobs, sinks, store

DIGITS = 6
TODAY = "2024-01-31"

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


# One division of whole numbers: the same double everywhere, and often half way between two rounded values.
EXACT = re.compile("feat_time_since_last_tx_mins|time_since_last_transaction|history_age_mins|.*_fraud_rate_.*")


def rounded(df: DataFrame, digits: int = DIGITS) -> DataFrame:
    """Round doubles for comparison across engines."""
    inexact = {f.name for f in df.schema if f.dataType.typeName() == "double" and not EXACT.fullmatch(f.name)}
    return df.select(*[F.round(c, digits).alias(c) if c in inexact else F.col(c) for c in df.columns])


def tx(spark: SparkSession, folder: str) -> DataFrame:
    return event_transactions(spark, folder)


def today(spark: SparkSession):
    return F.lit(TODAY).cast("timestamp_ntz")


def history(spark: SparkSession, folder: str, names: list[str]) -> DataFrame:
    return rounded(features.history_features(tx(spark, folder), names))


def feature_source(spark: SparkSession, folder: str) -> DataFrame:
    """The columns that the 31 features read."""
    return tx(spark, folder).select(*features.INPUTS[:-1])


def score_source(spark: SparkSession, folder: str) -> DataFrame:
    """The columns that the rules and the evaluation of their scores read."""
    return tx(spark, folder).select(
        "transaction_id", "ts", "user_id", "device_id", "country", "mcc", "amount", "is_fraud"
    )


def champion(spark: SparkSession, folder: str) -> DataFrame:
    """Transactions with the champion's rule score."""
    return scoring.rule_inputs(score_source(spark, folder)).withColumn("fraud_score", scoring.rule_score(scoring.CHAMPION))


def both_models(spark: SparkSession, folder: str) -> DataFrame:
    """Every transaction once per model."""
    scores = F.array(
        F.struct(F.lit("champion").alias("model"), scoring.rule_score(scoring.CHAMPION).alias("fraud_score")),
        F.struct(F.lit("challenger").alias("model"), scoring.rule_score(scoring.CHALLENGER).alias("fraud_score")),
    )
    inputs = scoring.rule_inputs(score_source(spark, folder))
    return inputs.select("transaction_id", "ts", "user_id", "country", "mcc", "amount", "is_fraud", F.inline(scores))


def ordered(spark: SparkSession, folder: str) -> DataFrame:
    """Orders as transactions: many share a date."""
    return order_transactions(spark, folder)


def faulty(spark: SparkSession, folder: str) -> DataFrame:
    """Transactions without some devices and addresses, with one time for all rows of an hour."""
    base = tx(spark, folder)
    return base.withColumns(
        {
            "device_id": F.when(F.col("device_id") % 7 != 0, F.col("device_id")),
            "ip_id": F.when(F.col("ip_id") % 5 != 0, F.col("ip_id")),
            "user_id": F.when(F.col("user_id") % 11 != 0, F.col("user_id")),
            "ts": F.date_trunc("hour", "ts").cast("timestamp_ntz"),
        }
    )


def sided_champion(spark: SparkSession, folder: str) -> DataFrame:
    return splits.rowcount_split(champion(spark, folder), source=tx(spark, folder))


def sided_features(spark: SparkSession, folder: str, names: list[str] = S.ALL_FEATURES) -> DataFrame:
    full = features.all_features(feature_source(spark, folder), amount="full").select("transaction_id", "ts", *names)
    return materialize(rounded(splits.rowcount_split(full, source=tx(spark, folder))))


def monitoring_frame(spark: SparkSession, folder: str) -> DataFrame:
    """Side, features and champion score of every transaction in one stored table, computed once.

    The score comes from the unrounded features of the same pass.
    """
    base = tx(spark, folder).select(*features.INPUTS[:-1], "mcc")
    full = features.all_features(base, amount="full").withColumn("fraud_score", scoring.rule_score(scoring.CHAMPION))
    kept = full.select("transaction_id", "ts", "amount", "is_fraud", "fraud_score", *S.ALL_FEATURES)
    return materialize(rounded(splits.rowcount_split(kept, source=tx(spark, folder))))


def online(spark: SparkSession, folder: str) -> DataFrame:
    """Scores as served without a history store: every history feature is its default."""
    served = scoring.with_history_defaults(tx(spark, folder))
    return served.withColumn("fraud_score", scoring.rule_score(scoring.CHAMPION))


def requests(spark: SparkSession, folder: str) -> DataFrame:
    """Scoring requests with the faults real ones have: amounts at or below 0, odd countries, missing devices."""
    return tx(spark, folder).select(
        "transaction_id",
        "user_id",
        "merchant_id",
        F.round(F.col("amount") - 20, 2).alias("amount"),
        F.when(F.col("mcc") == "5541", F.lit("usa"))
        .when(F.col("mcc") == "5411", F.lower("country"))
        .otherwise(F.col("country"))
        .alias("country"),
        F.when(F.col("device_id") > 0, F.col("device_id")).alias("device_id"),
        "ip_id",
        "mcc",
        "ts",
        "is_fraud",
    )


# Sources and sinks


@query
def scan_transactions(spark, folder):
    return tx(spark, folder)


@query
def write_features(spark, folder):
    """Write velocity features partitioned by day and read one column set back."""
    names = S.FEATURE_FAMILIES["velocity"]
    base = tx(spark, folder).select(*features.input_columns(names))
    out = features.add_history(base, names).withColumn("day", F.to_date("ts"))
    path = shared_path(spark, "features")
    write_table(out.select("transaction_id", "day", *names), path, partition_by=["day"])
    return rounded(spark.read.parquet(path).select("transaction_id", "day", *names))


# Features


@query
def velocity_features(spark, folder):
    return history(spark, folder, S.FEATURE_FAMILIES["velocity"])


@query
def velocity_features_inclusive(spark, folder):
    return history(
        spark,
        folder,
        ["tx_count_user_1h_inclusive", "tx_count_user_24h_inclusive", "tx_count_merchant_1h_inclusive"],
    )


@query
def unique_users_per_device_24h(spark, folder):
    return history(spark, folder, ["feat_unique_users_per_device_24h"])


@query
def unique_countries_per_device_7d(spark, folder):
    return history(spark, folder, ["feat_unique_countries_per_device_7d"])


@query
def unique_countries_per_device_7d_legacy24h(spark, folder):
    return history(spark, folder, ["feat_unique_countries_per_device_24h"])


@query
def unique_users_per_ip_24h(spark, folder):
    return history(spark, folder, ["feat_unique_users_per_ip_24h"])


@query
def entity_age(spark, folder):
    return history(spark, folder, ["feat_device_age_days", "feat_ip_age_days"])


@query
def device_risk_features(spark, folder):
    return history(spark, folder, S.FEATURE_FAMILIES["device_ip"])


@query
def distinct_counts_with_nulls(spark, folder):
    """Rows without a device, address or user belong to no entity, and rows of one time do not see each other."""
    names = [
        "feat_unique_users_per_device_24h",
        "feat_unique_countries_per_device_7d",
        "feat_unique_users_per_ip_24h",
        "feat_unique_countries_user_7d",
    ]
    return rounded(features.history_features(faulty(spark, folder), names))


@query
def geo_features(spark, folder):
    names = ["feat_country_change", "feat_unique_countries_user_7d"]
    base = tx(spark, folder).select(*features.input_columns(names))
    out = features.add_row_features(features.add_history(base, names), ["feat_is_high_risk_country"])
    return out.select("transaction_id", *names, "feat_is_high_risk_country")


@query
def country_change_first_is_change(spark, folder):
    return history(spark, folder, ["country_change_first_is_change"])


@query
def country_entropy(spark, folder):
    return history(spark, folder, ["feat_user_country_entropy"])


@query
def historical_risk(spark, folder):
    return history(spark, folder, S.FEATURE_FAMILIES["historical"])


@query
def historical_risk_smoothed(spark, folder):
    return history(
        spark, folder, ["user_fraud_rate_smoothed", "merchant_fraud_rate_smoothed", "device_fraud_rate_smoothed"]
    )


@query
def historical_risk_label_aware(spark, folder):
    return history(
        spark,
        folder,
        ["user_fraud_rate_label_aware", "merchant_fraud_rate_label_aware", "device_fraud_rate_label_aware"],
    )


@query
def user_running_count(spark, folder):
    return history(spark, folder, ["user_transaction_count"])


@query
def time_since_last_zero(spark, folder):
    return history(spark, folder, ["time_since_last_transaction"])


@query
def amount_zscore_pit(spark, folder):
    return history(spark, folder, ["feat_amount_vs_user_avg", "feat_amount_vs_merchant_avg"])


@query
def amount_zscore_full(spark, folder):
    out = features.add_full_table_zscore(tx(spark, folder), "user_id", "feat_amount_vs_user_avg")
    out = features.add_full_table_zscore(out, "merchant_id", "feat_amount_vs_merchant_avg")
    return rounded(out.select("transaction_id", "feat_amount_vs_user_avg", "feat_amount_vs_merchant_avg"))


@query
def amount_percentile_full(spark, folder):
    out = features.add_full_table_percentile(tx(spark, folder).select("transaction_id", "user_id", "amount"))
    return rounded(out.select("transaction_id", "feat_amount_percentile_user"))


@query
def amount_percentile_pit(spark, folder):
    out = features.add_past_percentile(tx(spark, folder).select("transaction_id", "ts", "user_id", "amount"))
    return rounded(out.select("transaction_id", "feat_amount_percentile_user"))


@query
def user_amount_stats(spark, folder):
    return rounded(features.amount_stats(tx(spark, folder), "user_id"))


@query
def merchant_amount_stats(spark, folder):
    return rounded(features.amount_stats(tx(spark, folder), "merchant_id"))


@query
def amount_flags(spark, folder):
    names = ["feat_is_small_amount", "feat_is_large_amount"]
    return features.add_row_features(tx(spark, folder), names).select("transaction_id", *names)


@query
def temporal_features(spark, folder):
    names = S.FEATURE_FAMILIES["temporal"]
    return rounded(features.add_row_features(tx(spark, folder), names).select("transaction_id", *names))


@query
def all_features(spark, folder):
    return rounded(features.all_features(feature_source(spark, folder)).select("transaction_id", *S.ALL_FEATURES))


@query
def all_features_full_table(spark, folder):
    out = features.all_features(feature_source(spark, folder), amount="full")
    return rounded(out.select("transaction_id", *S.ALL_FEATURES))


@query
def feature_matrix(spark, folder):
    names = ["feat_amount_vs_user_avg", "feat_hour_sin", "feat_tx_count_user_24h"]
    base = tx(spark, folder).select("transaction_id", "ts", "user_id", "amount")
    out = features.add_full_table_zscore(base, "user_id", "feat_amount_vs_user_avg")
    out = features.add_history(out, ["feat_tx_count_user_24h"])
    out = features.add_row_features(out, ["feat_hour_sin"])
    return rounded(quality.feature_matrix(out.select("transaction_id", *names)))


@query
def history_asof(spark, folder):
    base = tx(spark, folder).select("transaction_id", "ts", "device_id", "user_id", "country", "amount")
    out = features.latest_history(base, "device_id", ["user_id", "country", "amount"])
    return rounded(
        out.select("transaction_id", "history_age_mins", "last_user_id", "last_country", "last_amount")
    )


@query
def enrich_with_defaults(spark, folder):
    """Serve every request from stores of users, merchants and devices that hold the week before the last one."""
    base = tx(spark, folder)
    edge = today(spark) - F.make_dt_interval(F.lit(7))
    served = scoring.with_history_defaults(base, scoring.history_stores(base, edge))
    return rounded(served.select("transaction_id", *S.ALL_FEATURES))


# Quality, splits, validation


@query
def dataset_summary(spark, folder):
    return rounded(quality.dataset_summary(tx(spark, folder)))


@query
def null_census(spark, folder):
    """Missing values of the 31 features, whole-table variant: users with one row have no deviation."""
    source = feature_source(spark, folder)
    return quality.null_census(features.all_features(source, amount="full"), S.ALL_FEATURES)


@query
def null_census_first_day(spark, folder):
    """The same for the first day alone, on which many users have one row."""
    source = feature_source(spark, folder)
    first = source.agg(F.to_date(F.min("ts")).alias("d")).first().d
    day = materialize(source.where(F.to_date("ts") == F.lit(first)))
    return quality.null_census(features.all_features(day, amount="full"), S.ALL_FEATURES)


@query
def feature_catalog(spark, folder):
    return quality.feature_catalog(features.all_features(feature_source(spark, folder), amount="full"))


@query
def temporal_split(spark, folder):
    return splits.temporal_split(tx(spark, folder)).select("transaction_id", "split")


@query
def rowcount_split(spark, folder):
    return splits.rowcount_split(tx(spark, folder)).select("transaction_id", "side")


@query
def rowcount_split_ties(spark, folder):
    """The border lies within the orders of one day, so that the id decides."""
    return splits.rowcount_split(ordered(spark, folder)).select("transaction_id", "side")


@query
def training_window(spark, folder):
    """Windows of 30, 60, 90 and 180 days before the cutoff, without the last week."""
    windows = [30, 60, 90, 180]
    widest = splits.training_window(tx(spark, folder), today(spark), max(windows))
    sums = []
    for days in windows:
        inside = splits.in_training_window(today(spark), days)
        sums.append(
            F.struct(
                F.lit(days).alias("window_days"),
                F.count_if(inside).alias("n"),
                F.sum(F.when(inside, F.col("is_fraud"))).alias("frauds"),
                F.max(F.when(inside, F.col("ts"))).alias("last_ts"),
            )
        )
    return widest.agg(F.array(*sums).alias("all")).select(F.inline("all")).where("n > 0")


@query
def deterministic_sample(spark, folder):
    return splits.deterministic_sample(tx(spark, folder), 500).select("transaction_id", "amount")


@query
def validate_transactions(spark, folder):
    out = quality.valid_requests(requests(spark, folder))
    return out.select("transaction_id", "amount", "country", "currency", F.size("warnings").alias("warning_count"))


@query
def validation_errors(spark, folder):
    return quality.rejected_requests(requests(spark, folder))


@query
def request_fields(spark, folder):
    """Requests of which some lack the category or the time, and all the optional fields."""
    category = F.when(F.col("mcc") != "5812", F.concat(F.lit("category "), F.col("mcc")))
    given = requests(spark, folder).withColumns(
        {"merchant_category": category, "ts": F.when(F.col("transaction_id") % 10 != 0, F.col("ts"))}
    )
    checked = quality.complete_requests(given, today(spark))
    return checked.select(
        *["transaction_id", "ts", "merchant_category", "currency", "user_email_domain", "is_first_transaction"],
        F.size("errors").alias("error_count"),
    )


@query
def request_payload(spark, folder):
    return quality.request_payload(
        tx(spark, folder).select(
            "transaction_id", "user_id", "mcc", "amount", "country", "is_fraud", "ts", "delay_days"
        )
    )


# Scores and decisions


@query
def rule_scores(spark, folder):
    return champion(spark, folder).select("transaction_id", "fraud_score")


@query
def decisions(spark, folder):
    return scoring.with_decision(champion(spark, folder)).select(
        "transaction_id", "fraud_score", "decision", "risk_level", "reason"
    )


@query
def score_transactions(spark, folder):
    """Validate, add features, score and decide; a rejected request keeps its errors instead of a score."""
    checked = quality.check_requests(requests(spark, folder))
    return validation.score_checked(checked).select(
        "transaction_id", "fraud_score", "decision", "risk_level", "reason", "model_version", "error_count"
    )


@query
def decision_distribution(spark, folder):
    return rounded(scoring.decision_distribution(scoring.with_decision(champion(spark, folder))))


@query
def score_comparison(spark, folder):
    return scoring.compare_scores(online(spark, folder), champion(spark, folder))


@query
def score_agreement(spark, folder):
    return rounded(scoring.score_agreement(scoring.compare_scores(online(spark, folder), champion(spark, folder))))


def request_log(spark, folder):
    """Request log: the measured value of each event is read as its latency."""
    return tx(spark, folder).select("transaction_id", (F.col("amount") / 10).alias("latency_ms"))


@query
def latency_stats(spark, folder):
    return rounded(scoring.latency_stats(request_log(spark, folder)))


# Evaluation


@query
def confusion_matrix(spark, folder):
    return metrics.confusion_matrix(champion(spark, folder))


@query
def business_metrics(spark, folder):
    return rounded(metrics.threshold_metrics(champion(spark, folder), [S.BLOCK_THRESHOLD]))


@query
def threshold_sweep_100(spark, folder):
    return rounded(metrics.threshold_metrics(champion(spark, folder), metrics.threshold_grid(100)))


@query
def threshold_sweep_50(spark, folder):
    return rounded(metrics.threshold_metrics(champion(spark, folder), metrics.threshold_grid(50)))


@query
def threshold_metrics_fixed(spark, folder):
    return rounded(metrics.threshold_metrics(champion(spark, folder), S.FIXED_THRESHOLDS))


def _optimum(spark, folder, strategy):
    sweep = metrics.threshold_metrics(champion(spark, folder), metrics.threshold_grid())
    return rounded(metrics.optimal_threshold(sweep, strategy))


@query
def optimal_threshold_f1(spark, folder):
    return _optimum(spark, folder, "F1")


@query
def optimal_threshold_recall80(spark, folder):
    return _optimum(spark, folder, "80% Recall")


@query
def optimal_threshold_fpr1(spark, folder):
    return _optimum(spark, folder, "1% FPR")


@query
def model_comparison(spark, folder):
    return metrics.model_comparison(both_models(spark, folder))


@query
def roi_analysis(spark, folder):
    return rounded(metrics.roi_analysis(metrics.threshold_metrics(champion(spark, folder), [0.5, S.BLOCK_THRESHOLD])), 2)


@query
def segment_metrics(spark, folder):
    return rounded(metrics.segment_metrics(champion(spark, folder)))


@query
def daily_kpis(spark, folder):
    return rounded(metrics.daily_kpis(champion(spark, folder)))


@query
def alerts_last_7d(spark, folder):
    kpis = materialize(metrics.daily_kpis(champion(spark, folder)))
    return metrics.last_days(kpis, 7).select("day", "alerts")


@query
def pr_curve(spark, folder):
    return rounded(curves.pr_curve(champion(spark, folder)))


@query
def average_precision(spark, folder):
    return rounded(curves.average_precision(champion(spark, folder)))


@query
def roc_auc(spark, folder):
    return rounded(curves.roc_auc(champion(spark, folder)))


# Drift and monitoring


@query
def psi_amount(spark, folder):
    sided = splits.rowcount_split(tx(spark, folder)).select("side", "amount")
    return rounded(drift.feature_drift(sided, ["amount"]).select("feature", "psi"))


@query
def feature_drift(spark, folder):
    return rounded(drift.feature_drift(sided_features(spark, folder), S.ALL_FEATURES))


@query
def categorical_psi(spark, folder):
    columns = ["feat_country_change", "feat_is_night", "feat_is_large_amount", "feat_day_of_week", "feat_hour"]
    sided = sided_features(spark, folder, columns)
    return rounded(drift.categorical_psi(drift.side_counts(sided, columns)))


@query
def drift_status_counts(spark, folder):
    return drift.status_counts(drift.feature_drift(sided_features(spark, folder), S.ALL_FEATURES))


@query
def top_drifted(spark, folder):
    report = drift.feature_drift(sided_features(spark, folder), S.ALL_FEATURES)
    return rounded(drift.top_drifted(report, 10).select("feature", "psi", "status"))


@query
def top_mean_shift(spark, folder):
    report = drift.feature_drift(sided_features(spark, folder), S.ALL_FEATURES)
    return rounded(drift.mean_shift(drift.top_drifted(report, 10)), 3)


@query
def ks_two_sample(spark, folder):
    return rounded(curves.ks_two_sample(sided_champion(spark, folder), "fraud_score"))


@query
def score_drift(spark, folder):
    return rounded(drift.score_drift(sided_champion(spark, folder)))


@query
def score_histogram(spark, folder):
    return drift.score_histogram(sided_champion(spark, folder))


def production_kpis(spark, folder):
    sided = sided_champion(spark, folder)
    return drift.business_kpis(sided.where(F.col("side") == "production"))


@query
def business_kpis(spark, folder):
    return rounded(production_kpis(spark, folder))


@query
def kpi_alerts(spark, folder):
    return drift.kpi_alerts(production_kpis(spark, folder))


def monitored(spark, folder) -> monitor.Report:
    frame = monitoring_frame(spark, folder)
    return monitor.monitor(frame, frame, S.ALL_FEATURES)


@query
def retrain_decision(spark, folder):
    return rounded(monitored(spark, folder).decision)


@query
def monitoring_summary(spark, folder):
    return monitored(spark, folder).summary


def daily_tables(spark, folder, frame) -> monitor.DailyTables:
    """Daily tables whose baseline is the first three quarters of the rows."""
    tables = monitor.DailyTables(spark, shared_path(spark, "monitoring"))
    columns = [c for c in frame.columns if c in S.ALL_FEATURES]
    tables.start(frame.where("side = 'baseline'"), {**dict.fromkeys(columns, 10), "fraud_score": 20})
    return tables


@query
def retrain_decision_by_day(spark, folder):
    """Production comes in two deliveries, the second with a day that the first one had; the tables add up."""
    frame = monitoring_frame(spark, folder)
    tables = daily_tables(spark, folder, frame)
    production = frame.where("side = 'production'")
    last = production.agg(F.to_date(F.max("ts")).alias("d")).first().d
    tables.add(production.where(F.to_date("ts") < F.lit(last)))
    tables.add(production.where(F.to_date("ts") >= F.date_sub(F.lit(last), 1)))
    return rounded(tables.report().decision)


@query
def kpi_trend(spark, folder):
    """KPIs and score stability of every day, from daily counts."""
    frame = materialize(sided_champion(spark, folder).select("ts", "is_fraud", "fraud_score", "side"))
    tables = daily_tables(spark, folder, frame)
    tables.add(frame)
    return rounded(tables.trend())


@query
def sustained_breach(spark, folder):
    """Days below the approval target at the review threshold, where both models refuse more."""
    kpis = metrics.daily_kpis(both_models(spark, folder), S.BLOCK_THRESHOLD * S.REVIEW_RATIO, ["model"])
    return rounded(drift.sustained_breach(kpis))


# Retraining


@query
def label_backfill(spark, folder):
    """Start from labels without the frauds and fill in those discovered by the cutoff."""
    base = tx(spark, folder)
    labels = base.where("is_fraud = 1").select("transaction_id", "chargeback_ts")
    unlabelled = base.select("transaction_id", "ts", F.lit(0).alias("is_fraud"))
    out = retrain.backfill_labels(unlabelled, labels.unionByName(labels), today(spark))
    return out.select("transaction_id", "is_fraud", "label_ts")


@query
def unmatched_labels(spark, folder):
    """Labels of transactions that lie before the training window."""
    base = tx(spark, folder)
    labels = base.where("is_fraud = 1").select("transaction_id", "chargeback_ts")
    return retrain.unmatched_labels(splits.training_window(base, today(spark), 20), labels)


@query
def class_weights(spark, folder):
    return rounded(retrain.class_weights(splits.temporal_split(tx(spark, folder)).where("split = 'train'")))


@query
def ab_assignment(spark, folder):
    return retrain.assign_versions(tx(spark, folder)).select("transaction_id", "model_version")


@query
def champion_challenger(spark, folder):
    return rounded(retrain.champion_challenger(both_models(spark, folder), 0.5))


@query
def promotion_check(spark, folder):
    return retrain.promotion_check(both_models(spark, folder), 0.5)


@query
def retrain_success(spark, folder):
    scored = monitoring_frame(spark, folder)
    report = drift.feature_drift(scored, S.ALL_FEATURES)
    production = metrics.threshold_metrics(scored.where(F.col("side") == "production"), [S.BLOCK_THRESHOLD])
    return retrain.retrain_success(production, report, drift.score_drift(scored))


@query
def api_summary_json(spark, folder):
    return validation.api_summary(
        champion(spark, folder), online(spark, folder), request_log(spark, folder)
    )


# Models


def model_input(spark, folder):
    return training.prepare(features.all_features(feature_source(spark, folder)).select(*training.KEPT, *S.ALL_FEATURES))


@query
def lr_scores(spark, folder):
    """Fit, store, load again and score the test period."""
    prepared = model_input(spark, folder)
    path = training.save_model(training.fit_logistic(prepared), shared_path(spark, "model"))
    scored = training.score(training.load_model(path), prepared.where("split = 'test'"))
    return rounded(scored.select("transaction_id", "is_fraud", "fraud_score"))


@query
def lr_scored_rows(spark, folder):
    """Whether each row of the test period has a probability, and the same one from the stored and loaded model."""
    prepared = model_input(spark, folder)
    model = training.fit_logistic(prepared)
    loaded = training.load_model(training.save_model(model, shared_path(spark, "model")))
    test = prepared.where("split = 'test'")
    first = training.score(model, test).select("transaction_id", "split", "fraud_score")
    second = training.score(loaded, test).select("transaction_id", F.col("fraud_score").alias("again"))
    return first.join(second, "transaction_id").select(
        "transaction_id",
        "split",
        F.col("fraud_score").between(0, 1).alias("is_probability"),
        (F.col("fraud_score") == F.col("again")).alias("same_after_loading"),
    )


@query
def lr_optimum(spark, folder):
    """Whether the penalised gradient of the logistic model vanishes for every coefficient, from its own scores."""
    prepared = model_input(spark, folder)
    gradient = training.logistic_gradient(training.fit_logistic(prepared), prepared)
    return gradient.select("feature", (F.abs("gradient") < 1e-4).alias("at_optimum"))


@query
def scaled_features(spark, folder):
    """Features with whole values, scaled by the training period."""
    names = ["feat_tx_count_user_24h", "feat_unique_users_per_device_24h", "feat_hour", "feat_is_night"]
    base = features.add_history(feature_source(spark, folder), names[:2])
    base = features.add_row_features(base, names[2:])
    return rounded(training.scaled(training.prepare(base)))


@query
def gbt_scores(spark, folder):
    prepared = model_input(spark, folder)
    scored = training.score(training.fit_trees(prepared), prepared.where("split = 'test'"))
    return rounded(scored.select("transaction_id", "is_fraud", "fraud_score"))


@query
def feature_importance(spark, folder):
    model = training.fit_trees(model_input(spark, folder))
    return rounded(training.feature_importance(model, spark))


@query
def importance_shares(spark, folder):
    """Whether the importances of the boosted trees are shares of one whole over all features."""
    found = training.feature_importance(training.fit_trees(model_input(spark, folder)), spark)
    whole = abs(found.agg(F.sum("importance")).first()[0] - 1) < 1e-9
    return found.select("feature", (F.lit(whole) & F.col("importance").between(0, 1)).alias("is_share"))


@query
def fitted_model_comparison(spark, folder):
    """Both fitted models at their best thresholds on the test period."""
    prepared = model_input(spark, folder)
    models = {
        "logistic regression": training.fit_logistic(prepared),
        "boosted trees": training.fit_trees(prepared),
    }
    return metrics.model_comparison(materialize(training.evaluate(prepared, models)))


# Streams


@query
def stream_hourly_kpis(spark, folder):
    return jobs.drain(jobs.hourly_kpis(jobs.scored_stream(jobs.transaction_stream(spark, folder))), "hourly")


@query
def stream_alert_volume(spark, folder):
    return jobs.drain(jobs.alert_volume(jobs.scored_stream(jobs.transaction_stream(spark, folder))), "alerts")


@query
def stream_alert_volume_1h(spark, folder):
    scored = jobs.scored_stream(jobs.transaction_stream(spark, folder))
    return jobs.drain(jobs.alert_volume(scored, "1 hour", "10 minutes"), "alerts-1h")


@query
def stream_dedup(spark, folder):
    """The stream joined with a replay of itself."""
    twice = jobs.transaction_stream(spark, folder).unionByName(jobs.transaction_stream(spark, folder))
    return jobs.drain(jobs.deduplicated(twice), "dedup").select("transaction_id", "ts", "amount")


def stored_by_day(spark, folder):
    """The transactions as a stored table with a folder per day."""
    path = shared_path(spark, "transactions")
    return write_table(tx(spark, folder).withColumn("day", F.to_date("ts")), path, partition_by=["day"])


def label_status(spark, folder, days):
    labels = jobs.transaction_stream(spark, folder).where("is_fraud = 1").select("transaction_id", "chargeback_ts")
    sink = shared_path(spark, "labels")
    sinks.labels_into(labels, stored_by_day(spark, folder), sink, days)
    return spark.read.parquet(sink).select("transaction_id", "ts", "amount", "chargeback_ts", "label_status")


@query
def stream_label_join(spark, folder):
    return label_status(spark, folder, jobs.LABEL_DAYS).where("label_status = 'matched'").drop("label_status")


@query
def stream_late_labels(spark, folder):
    """Chargebacks that come more than two weeks after their transaction."""
    return label_status(spark, folder, 14).where("label_status = 'late'").drop("label_status")


@query
def stream_label_upsert(spark, folder):
    """A stored table without labels into which the stream of chargebacks is merged day by day."""
    base = tx(spark, folder)
    bare = base.withColumns(
        {"day": F.to_date("ts"), "is_fraud": F.lit(0), "chargeback_ts": F.lit(None).cast("timestamp_ntz")}
    )
    path = write_table(bare, shared_path(spark, "unlabelled"), partition_by=["day"])
    work = shared_path(spark, "upserts")
    labels = jobs.transaction_stream(spark, folder).where("is_fraud = 1").select("transaction_id", "chargeback_ts")
    sinks.run_batches(labels, "upsert", lambda batch, i: sinks.upsert_labels(batch, i, path, work, 20))
    return spark.read.parquet(path).select("transaction_id", "ts", "is_fraud", "chargeback_ts")


@query
def stream_scores(spark, folder):
    return jobs.drain(jobs.scored_decisions(jobs.transaction_stream(spark, folder)), "scores")


@query
def stream_scores_without_store(spark, folder):
    return jobs.drain(jobs.decisions_without_store(jobs.transaction_stream(spark, folder)), "scores")


@query
def stream_entity_features(spark, folder):
    """The features of the store for every closed transaction: users, merchants, devices and addresses."""
    stream = jobs.transaction_stream(spark, folder).withWatermark("at", jobs.DELAY)
    names = [n for e in store.ENTITIES for n in e.features]
    return rounded(jobs.drain(store.with_history(stream, buckets=store.BUCKETS), "features").select("transaction_id", *names))


@query
def stream_user_velocity(spark, folder):
    return jobs.drain(jobs.user_velocity(jobs.transaction_stream(spark, folder)), "velocity")
