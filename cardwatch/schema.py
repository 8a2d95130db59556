"""Table schemas and the fixed values every stage shares."""

from pyspark.sql import types as T

# They must equal the published pipeline's for results to agree.
HIGH_RISK_COUNTRIES = ["NG", "PK", "BD", "VN", "ID"]
SMALL_AMOUNT = 10
LARGE_AMOUNT = 500
NO_PREVIOUS_TX_MINUTES = 999999.0
BLOCK_THRESHOLD = 0.95
REVIEW_RATIO = 0.7
FIXED_THRESHOLDS = [0.5, 0.665, 0.8, 0.9, 0.95, 0.99]
MIN_APPROVAL_RATE = 95.0
MIN_DETECTION_RATE = 75.0
MIN_PRECISION = 50.0
TARGET_RECALL = 0.80
MAX_FPR = 0.01
PSI_MODERATE = 0.1
PSI_SIGNIFICANT = 0.25
REVIEW_COST = 25.0
TRAIN_MONTHS = 9
TEST_MONTHS = 3
LARGE_REQUEST_AMOUNT = 10000

# The texts of alerts and of reasons to retrain.
APPROVAL_ALERT = "ALERT: Approval rate %.1f%% below 95%% threshold"
DETECTION_ALERT = "ALERT: Fraud detection rate %.1f%% below 75%% threshold"
PRECISION_ALERT = "WARNING: Precision %.1f%% below 50%% threshold"
NO_ALERT = "All metrics within acceptable ranges"
FEATURES_REASON = "High drift in %d features (threshold: 3)"
SCORE_REASON = "Score PSI %.3f exceeds 0.25"
SHIFT_REASON = "Score mean shifted %+.1f%% (threshold: ±20%%)"
APPROVAL_REASON = "Approval rate %.1f%% below 95%%"
DETECTION_REASON = "Fraud detection rate %.1f%% below 75%%"

# Fixed values used when an entity has no stored history.
HISTORY_DEFAULTS = {
    "user_avg_amount": 150.0,
    "user_std_amount": 75.0,
    "merchant_avg_amount": 100.0,
    "merchant_std_amount": 50.0,
    "feat_country_change": 0,
    "feat_unique_countries_user_7d": 1,
    "feat_tx_count_user_1h": 1,
    "feat_tx_count_user_24h": 3,
    "feat_time_since_last_tx_mins": 120.0,
    "feat_tx_count_merchant_1h": 10,
    "feat_unique_users_per_device_24h": 1,
    "feat_unique_countries_per_device_7d": 1,
    "feat_unique_users_per_ip_24h": 1,
    "feat_device_age_days": 30.0,
    "feat_ip_age_days": 15.0,
    "feat_user_fraud_rate_historical": 0.0,
    "feat_merchant_fraud_rate_historical": 0.01,
    "feat_device_fraud_rate_historical": 0.0,
}

FEATURE_FAMILIES = {
    "velocity": [
        "feat_tx_count_user_1h",
        "feat_tx_count_user_24h",
        "feat_amount_sum_user_24h",
        "feat_amount_avg_user_24h",
        "feat_time_since_last_tx_mins",
        "feat_tx_count_merchant_1h",
    ],
    "device_ip": [
        "feat_unique_users_per_device_24h",
        "feat_unique_countries_per_device_7d",
        "feat_unique_users_per_ip_24h",
        "feat_device_age_days",
        "feat_ip_age_days",
    ],
    "geo": [
        "feat_country_change",
        "feat_unique_countries_user_7d",
        "feat_is_high_risk_country",
        "feat_user_country_entropy",
    ],
    "historical": [
        "feat_user_fraud_rate_historical",
        "feat_merchant_fraud_rate_historical",
        "feat_device_fraud_rate_historical",
    ],
    "amount": [
        "feat_amount_vs_user_avg",
        "feat_amount_vs_merchant_avg",
        "feat_is_small_amount",
        "feat_is_large_amount",
        "feat_amount_percentile_user",
    ],
    "temporal": [
        "feat_hour",
        "feat_day_of_week",
        "feat_is_weekend",
        "feat_is_night",
        "feat_hour_sin",
        "feat_hour_cos",
        "feat_day_sin",
        "feat_day_cos",
    ],
}
ALL_FEATURES = [name for names in FEATURE_FAMILIES.values() for name in names]

RAW_TRANSACTIONS = T.StructType(
    [
        T.StructField("transaction_id", T.StringType()),
        T.StructField("user_id", T.StringType()),
        T.StructField("merchant_id", T.StringType()),
        T.StructField("merchant_category_code", T.StringType()),
        T.StructField("merchant_category", T.StringType()),
        T.StructField("amount", T.DoubleType()),
        T.StructField("currency", T.StringType()),
        T.StructField("country", T.StringType()),
        T.StructField("device_id", T.StringType()),
        T.StructField("ip_address", T.StringType()),
        T.StructField("timestamp", T.TimestampNTZType()),
        T.StructField("is_fraud", T.IntegerType()),
        T.StructField("chargeback_date", T.TimestampNTZType()),
        T.StructField("delay_days", T.IntegerType()),
        T.StructField("transaction_hour", T.IntegerType()),
        T.StructField("transaction_day_of_week", T.IntegerType()),
        T.StructField("user_transaction_count_1h", T.LongType()),
        T.StructField("time_since_last_transaction", T.DoubleType()),
        T.StructField("is_weekend", T.IntegerType()),
        T.StructField("is_night", T.IntegerType()),
    ]
)

EVENTS = T.StructType(
    [
        T.StructField("event_id", T.LongType()),
        T.StructField("ts", T.TimestampNTZType()),
        T.StructField("user_id", T.LongType()),
        T.StructField("event_type", T.StringType()),
        T.StructField("value", T.DoubleType()),
        T.StructField("props", T.StringType()),
    ]
)
