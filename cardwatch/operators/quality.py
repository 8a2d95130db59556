"""Validation of requests, summaries of tables and checks of features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cardwatch import schema as S
from cardwatch.functions.expressions import clean_number

REQUIRED = ["transaction_id", "user_id", "merchant_id", "amount", "country", "device_id", "ip_id", "mcc"]

#: What a request to the service has to name as well, and what it may leave out.
REQUEST_FIELDS = [*REQUIRED, "merchant_category"]
OPTIONAL_FIELDS = {
    "merchant_category": "string",
    "currency": "string",
    "ts": "timestamp_ntz",
    "user_email_domain": "string",
    "is_first_transaction": "boolean",
}


def feature_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c.startswith("feat_")]


def feature_matrix(df: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Model input: the feature columns as doubles without null, NaN or infinity."""
    names = feature_columns(df)
    return df.select(*(keep or ["transaction_id"]), *[clean_number(F.col(c)).alias(c) for c in names])


def request_errors(required: list[str] = REQUIRED) -> Column:
    checks = [F.when(F.col(c).isNull(), F.lit(f"{c} is required")) for c in required]
    # NaN is greater than every number here, but not greater than 0.
    checks.append(F.when((F.col("amount") <= 0) | F.isnan("amount"), F.lit("amount must be greater than 0")))
    checks.append(F.when(F.length("country") != 2, F.lit("country must have 2 letters")))
    return F.array_compact(F.array(*checks))


def check_requests(df: DataFrame, required: list[str] = REQUIRED) -> DataFrame:
    """Upper-case countries, fill the currency and attach errors and warnings; failed rows stay as data."""
    currency = F.coalesce(F.col("currency"), F.lit("USD")) if "currency" in df.columns else F.lit("USD")
    large = F.when(F.col("amount") > S.LARGE_REQUEST_AMOUNT, F.lit("large amount"))
    return (
        df.withColumn("errors", request_errors(required))
        .withColumn("warnings", F.array_compact(F.array(large)))
        .withColumns({"country": F.upper("country"), "currency": currency})
    )


def complete_requests(df: DataFrame, received: Column | None = None) -> DataFrame:
    """Checked requests with every field of the service. A column that is missing is null in all rows, which is an error
    for ``merchant_category`` and none for the optional ones; a request without a time gets that of its arrival."""
    missing = {c: F.lit(None).cast(kind) for c, kind in OPTIONAL_FIELDS.items() if c not in df.columns}
    now = F.current_timestamp() if received is None else received
    full = df.withColumns(missing) if missing else df
    return check_requests(full.withColumn("ts", F.coalesce("ts", now.cast("timestamp_ntz"))), REQUEST_FIELDS)


def valid_requests(df: DataFrame) -> DataFrame:
    return check_requests(df).where(F.size("errors") == 0)


def rejected_requests(df: DataFrame) -> DataFrame:
    """One row per rejected request and error."""
    return check_requests(df).select("transaction_id", F.explode("errors").alias("error"))


def request_payload(df: DataFrame) -> DataFrame:
    """JSON body of a scoring request: no label, no time, no null fields, numbers as doubles, MCC as text."""
    fields = []
    for name in df.columns:
        if name in ("is_fraud", "ts"):
            continue
        kind = df.schema[name].dataType.typeName()
        if name == "mcc":
            fields.append(F.col(name).cast("string").alias("merchant_category_code"))
        elif kind in ("long", "integer", "double", "float", "short"):
            fields.append(F.col(name).cast("double").alias(name))
        else:
            fields.append(F.col(name))
    return df.select("transaction_id", F.to_json(F.struct(*fields)).alias("payload"))


def dataset_summary(df: DataFrame) -> DataFrame:
    return df.agg(
        F.count(F.lit(1)).alias("transactions"),
        F.sum("is_fraud").alias("frauds"),
        F.avg("is_fraud").alias("fraud_rate"),
        F.min("ts").alias("first_ts"),
        F.max("ts").alias("last_ts"),
        F.min("amount").alias("min_amount"),
        F.max("amount").alias("max_amount"),
        F.count_distinct("country").alias("countries"),
        F.count_distinct("user_id").alias("users"),
        F.count_distinct("merchant_id").alias("merchants"),
    )


def null_census(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Columns with missing values and how many, from one pass."""
    columns = columns or feature_columns(df)
    counts = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
    return counts.unpivot([], columns, "column_name", "missing").where(F.col("missing") > 0)


def feature_catalog(df: DataFrame) -> DataFrame:
    """Features of a frame by family, with the number of values present."""
    family = {name: family for family, names in S.FEATURE_FAMILIES.items() for name in names}
    names = [c for c in feature_columns(df) if c in family]
    present = df.agg(*[F.count(c).alias(c) for c in names]).unpivot([], names, "feature", "present")
    lookup = F.create_map(*[F.lit(x) for name in names for x in (name, family[name])])
    return (
        present.withColumn("family", lookup[F.col("feature")])
        .groupBy("family")
        .agg(F.count(F.lit(1)).alias("features"), F.sum("present").alias("values_present"))
    )
