"""Structured Streaming jobs over the transaction stream. They use the batch definitions of scores and decisions."""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cardwatch import schema as S
from cardwatch.functions.expressions import as_instant, cents, without_zone
from cardwatch.operators import quality, scoring
from cardwatch.operators.features import add_row_features
from cardwatch.sources.session import shared_path
from cardwatch.sources.transactions import from_events
from cardwatch.streaming.store import BUCKETS, DEVICE, USER, with_history
from cardwatch.streaming.velocity import OUTPUT, UserVelocity

DELAY = "10 minutes"
LABEL_DAYS = 90
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def transaction_stream(spark: SparkSession, folder: str) -> DataFrame:
    """Transactions with their event time as an instant in ``at``."""
    events = spark.readStream.schema(S.EVENTS).option("pathGlobFilter", "events*.parquet").parquet(folder)
    tx = from_events(events)
    return tx.withColumn("at", as_instant(tx, "ts"))


def drain(
    stream: DataFrame, name: str, trigger: dict | None = None, sink: str | None = None, progress: str | None = None
) -> DataFrame:
    """Process what is available into a Parquet sink and read the sink back. State is kept in RocksDB.

    With the same ``sink`` and ``progress`` folders a later call goes on where this one stopped. Without them both are
    new folders of the shared one, and the run starts from the beginning.
    """
    spark = stream.sparkSession
    sink = sink or shared_path(spark, f"stream-{name}")
    progress = progress or f"{sink}-progress"
    writer = stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", progress)
    with rocksdb(spark):
        writer.trigger(**(trigger or {"availableNow": True})).start(sink).awaitTermination()
    return spark.read.schema(stream.schema).parquet(sink)


@contextmanager
def rocksdb(spark: SparkSession):
    """State larger than memory needs the RocksDB store; the session keeps its own choice afterwards."""
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key, None)
    spark.conf.set(key, ROCKSDB)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def scored_stream(tx: DataFrame, ttl_days: int | None = 7, stored: dict[str, DataFrame] | None = None) -> DataFrame:
    """Scores from the state of users and devices, by the batch definitions: two stateful stages, one per key. A drain
    takes all that is there as one batch with very many users, so their state is kept in buckets."""
    served = with_history(tx.withWatermark("at", DELAY), (USER, DEVICE), ttl_days, stored, BUCKETS)
    return add_row_features(served, scoring.RULE_ROW).withColumn("fraud_score", scoring.rule_score(scoring.CHAMPION))


def scored_without_store(tx: DataFrame) -> DataFrame:
    """Scores from the row itself and the default history, as the service computes them when the store is down."""
    served = scoring.with_history_defaults(tx)
    return served.select(*tx.columns, scoring.rule_score(scoring.CHAMPION).alias("fraud_score"))


def hourly_kpis(scored: DataFrame) -> DataFrame:
    """Closed hours only: an hour is written once the watermark has passed its end."""
    alert = F.col("fraud_score") >= F.lit(S.BLOCK_THRESHOLD)
    return (
        scored.groupBy(F.window("at", "1 hour"))
        .agg(
            F.count(F.lit(1)).alias("transactions"),
            F.count_if(alert).alias("alerts"),
            F.sum("is_fraud").alias("frauds"),
            F.sum(cents(F.col("amount"))).alias("amount_cents"),
        )
        .select(without_zone(F.col("window.start")).alias("hour"), "transactions", "alerts", "frauds", "amount_cents")
    )


def alert_volume(scored: DataFrame, width: str = "24 hours", slide: str = "1 hour") -> DataFrame:
    """Alerts of the last ``width``, every ``slide``.

    Rows are counted per ``slide`` first, so that the copies a sliding window needs are made of counts and not of rows.
    """
    alert = F.col("fraud_score") >= F.lit(S.BLOCK_THRESHOLD)
    steps = scored.groupBy(F.window("at", slide)).agg(F.count(F.lit(1)).alias("n"), F.count_if(alert).alias("alerts"))
    span = F.window(F.window_time("window"), width, slide)
    return (
        steps.groupBy(span.alias("span"))
        .agg(F.sum("n").alias("transactions"), F.sum("alerts").alias("alerts"))
        .select(
            without_zone(F.col("span.start")).alias("window_start"),
            without_zone(F.col("span.end")).alias("window_end"),
            "transactions",
            "alerts",
        )
    )


def deduplicated(tx: DataFrame) -> DataFrame:
    """Each transaction id once, however often the client sent it within the watermark."""
    return tx.withWatermark("at", "1 hour").dropDuplicatesWithinWatermark(["transaction_id"])


def label_join(labels: DataFrame, stored: DataFrame, days: int = LABEL_DAYS) -> DataFrame:
    """A stream of chargebacks with the stored transaction of each, and where it goes: ``matched`` within ``days`` of
    the transaction, ``late`` after them (nothing is dropped), ``unknown`` without a transaction.

    Labels are few and transactions are stored anyway, so the stream side alone moves and no transaction is buffered
    as state for three months.
    """
    tx = stored.select("transaction_id", "ts", "amount")
    found = labels.select("transaction_id", "chargeback_ts").join(tx, "transaction_id", "left")
    status = (
        F.when(F.col("ts").isNull(), F.lit("unknown"))
        .when(F.col("chargeback_ts") <= F.col("ts") + F.make_dt_interval(F.lit(days)), F.lit("matched"))
        .otherwise(F.lit("late"))
    )
    return found.select("transaction_id", "ts", "amount", "chargeback_ts", status.alias("label_status"))


def scored_decisions(tx: DataFrame, ttl_days: int | None = 7, stored: dict[str, DataFrame] | None = None) -> DataFrame:
    """Validate, score and decide on the stream, with the history of users and devices. Rejected requests keep their
    error count, get no score and are no part of the history of others."""
    checked = quality.check_requests(tx)
    counted = checked.withColumns({"error_count": F.size("errors"), "counted": F.size("errors") == 0})
    return _decided(scored_stream(counted, ttl_days, stored), F.col("counted"))


def decisions_without_store(tx: DataFrame) -> DataFrame:
    """The same from default histories, at once and without state."""
    checked = quality.check_requests(tx)
    counted = checked.withColumns({"error_count": F.size("errors"), "counted": F.size("errors") == 0})
    return _decided(scored_without_store(counted), F.col("counted"))


def _decided(scored: DataFrame, valid) -> DataFrame:
    decided = scoring.with_decision(scored)
    fields = ["fraud_score", "decision", "risk_level"]
    return decided.select("transaction_id", *[F.when(valid, F.col(f)).alias(f) for f in fields], "error_count")


def user_velocity(tx: DataFrame) -> DataFrame:
    """Activity of each user over the last hour, day and week, kept as state.

    Transactions are counted per user and minute before they are shuffled, so a very active user sends one row per
    minute; the state of a user holds at most a week of minutes and ends a week after the last.
    """
    minutes = (
        tx.withWatermark("at", DELAY)
        .groupBy(F.window("at", "1 minute"), "user_id")
        .agg(F.count(F.lit(1)).alias("n"), F.sum(cents(F.col("amount"))).alias("cents"))
    )
    minute = (F.unix_micros(F.col("window.start")) / 60_000_000).cast("long")
    rows = minutes.select("user_id", minute.alias("minute"), "n", "cents", F.window_time("window").alias("at"))
    return rows.groupBy("user_id").transformWithStateInPandas(
        statefulProcessor=UserVelocity(), outputStructType=OUTPUT, outputMode="Append", timeMode="EventTime"
    )
