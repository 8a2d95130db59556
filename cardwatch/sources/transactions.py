"""Reading and writing transaction tables."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cardwatch import schema as S

# Maps the driver's event stream onto card transactions. Every expression is plain SQL.
EVENT_COLUMNS = {
    "transaction_id": "event_id",
    "ts": "ts",
    "user_id": "user_id",
    "merchant_id": "event_id * 31 % 40",
    "mcc": "CASE event_type WHEN 'view' THEN '5411' WHEN 'click' THEN '5812' WHEN 'signup' THEN '5541' "
    "WHEN 'purchase' THEN '5999' ELSE '7995' END",
    "amount": "round(value * 10, 2)",
    "country": "CASE (event_id * 7 + user_id) % 13 WHEN 0 THEN 'NG' WHEN 1 THEN 'PK' WHEN 2 THEN 'GB' "
    "WHEN 3 THEN 'CA' WHEN 4 THEN 'DE' ELSE 'US' END",
    "device_id": "CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT)",
    "ip_id": "event_id * 17 % 500",
    "is_fraud": "CASE WHEN event_type = 'error' AND event_id % 5 = 0 THEN 1 ELSE 0 END",
    "delay_days": "CASE WHEN event_type = 'error' AND event_id % 5 = 0 THEN CAST(event_id % 31 AS INT) END",
    "chargeback_ts": "CASE WHEN event_type = 'error' AND event_id % 5 = 0 "
    "THEN ts + INTERVAL 1 DAY * CAST(event_id % 31 AS INT) END",
}


def from_events(events: DataFrame) -> DataFrame:
    return events.selectExpr(*[f"{sql} AS {name}" for name, sql in EVENT_COLUMNS.items()])


def event_transactions(spark: SparkSession, folder: str) -> DataFrame:
    """Transactions of a test-data folder; only the columns a query uses reach the Parquet scan."""
    return from_events(spark.read.schema(S.EVENTS).parquet(f"{folder}/events.parquet"))


def order_transactions(spark: SparkSession, folder: str) -> DataFrame:
    """Orders seen as transactions; their dates repeat, which exercises equal timestamps."""
    orders = spark.read.parquet(f"{folder}/orders.parquet")
    return orders.select(
        F.col("o_orderkey").alias("transaction_id"),
        F.col("o_orderdate").alias("ts"),
        F.col("o_custkey").alias("user_id"),
        F.col("o_totalprice").alias("amount"),
    )


def read_transactions(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Scan a raw transaction table with a declared schema: CSV (with header) or any columnar format."""
    reader = spark.read.schema(S.RAW_TRANSACTIONS)
    if fmt == "csv":
        reader = reader.option("header", True)
    return canonical(reader.format(fmt).load(path))


def canonical(raw: DataFrame) -> DataFrame:
    """Rename the raw columns to the short names the operators use."""
    names = {
        "timestamp": "ts",
        "merchant_category_code": "mcc",
        "ip_address": "ip_id",
        "chargeback_date": "chargeback_ts",
    }
    return raw.withColumnsRenamed(names)


def write_table(df: DataFrame, path: str, fmt: str = "parquet", partition_by: list[str] | None = None) -> str:
    """Write features, splits, reports or predictions; days partition large tables."""
    if partition_by:
        # Each folder is written by the tasks that hold its rows, not by all tasks; large days are split.
        df = df.hint("rebalance", *partition_by)
    writer = df.write.mode("overwrite").format(fmt)
    if fmt == "csv":
        writer = writer.option("header", True)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.save(path)
    return path


def write_text(lines: DataFrame, path: str) -> str:
    lines.select("line").write.mode("overwrite").text(path)
    return path


def write_json(df: DataFrame, path: str) -> str:
    df.write.mode("overwrite").json(path)
    return path
