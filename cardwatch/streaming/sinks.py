"""Writes of streams that can be repeated: a batch that is delivered twice leaves the same table as one delivered once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cardwatch.sources.session import materialize, shared_path
from cardwatch.streaming.jobs import LABEL_DAYS, rocksdb


def _exists(spark: SparkSession, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def _mark(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).create(place, True).close()


def _replace(df: DataFrame, path: str, *folders: str) -> None:
    """Write a frame over the folders it has rows for; all other folders of the table stay as they are."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*folders).parquet(path)


def append_batch(batch: DataFrame, batch_id: int, path: str, day: str = "ts") -> None:
    """Put a batch into folders by day and batch. The same batch again replaces its own files."""
    _replace(batch.withColumns({"day": F.to_date(day), "batch": F.lit(batch_id)}), path, "day", "batch")


def upsert_labels(labels: DataFrame, batch_id: int, path: str, work: str, days: int = LABEL_DAYS) -> None:
    """Mark the transactions of a table partitioned by ``day`` whose chargebacks are in ``labels``.

    Only days up to ``days`` before the chargebacks are read, and only those with a match are written again. The new
    days are stored in ``work`` first: a batch that comes again after a failure is written from there, one that was
    written is left out. Repeated labels count once, by their first chargeback; labels without a transaction in reach
    change nothing (:func:`match_labels` reports them).
    """
    spark = labels.sparkSession
    staged = f"{work}/batch={batch_id}"
    if _exists(spark, f"{staged}/_applied"):
        return
    if not _exists(spark, f"{staged}/_SUCCESS"):
        first = _first_labels(labels)
        table, _ = _near(spark.read.parquet(path), first, days)
        if table is None:
            return
        kept = table.columns
        found = F.col("_chargeback").isNotNull() & (F.col("_chargeback") <= F.col("ts") + F.make_dt_interval(F.lit(days)))
        renamed = first.withColumnsRenamed({"transaction_id": "_id", "chargeback_ts": "_chargeback"})
        joined = table.join(renamed, table["transaction_id"] == F.col("_id"), "left").withColumn("_found", found)
        # One row per day in reach, a bounded number.
        touched = [r.day for r in joined.where("_found").select("day").distinct().collect()]
        if not touched:
            return
        values = {
            "is_fraud": F.when(F.col("_found"), F.lit(1)).otherwise(F.col("is_fraud")).cast(table.schema["is_fraud"].dataType),
            "chargeback_ts": F.when(F.col("_found"), F.col("_chargeback")).otherwise(F.col("chargeback_ts")),
        }
        out = joined.where(F.col("day").isin(touched)).withColumns(values).select(*kept)
        out.write.mode("overwrite").parquet(staged)
    # Days are spread over tasks by their rows, so that a large day is no single task.
    _replace(spark.read.parquet(staged).hint("rebalance", "day"), path, "day")
    _mark(spark, f"{staged}/_applied")


def _first_labels(labels: DataFrame) -> DataFrame:
    return materialize(
        labels.where("transaction_id IS NOT NULL AND chargeback_ts IS NOT NULL")
        .groupBy("transaction_id")
        .agg(F.min("chargeback_ts").alias("chargeback_ts"))
    )


def _near(table: DataFrame, labels: DataFrame, days: int) -> tuple[DataFrame | None, DataFrame | None]:
    """The days of a table that labels may belong to, and all other days; none without labels. The border is part of
    the scan, which opens the files of its own days only."""
    span = labels.agg(F.to_date(F.min("chargeback_ts")).alias("lo"), F.to_date(F.max("chargeback_ts")).alias("hi")).first()
    if span.lo is None:
        return None, None
    inside = F.col("day").between(F.date_sub(F.lit(span.lo), days), F.lit(span.hi))
    return table.where(inside), table.where(~inside)


def match_labels(labels: DataFrame, table: DataFrame, days: int = LABEL_DAYS) -> DataFrame | None:
    """A batch of chargebacks with the transaction of each, from a table partitioned by ``day``: ``matched`` within
    ``days`` of the transaction, ``late`` after them, ``unknown`` without one. None for a batch without labels.

    The days in reach are joined first; only labels that are left over look into the others.
    """
    first = _first_labels(labels)
    near, far = _near(table, first, days)
    if near is None:
        return None
    columns = ["transaction_id", "ts", "amount"]
    found = materialize(first.join(near.select(*columns), "transaction_id"))
    rest = first.join(found.select("transaction_id"), "transaction_id", "left_anti")
    both = found.unionByName(rest.join(far.select(*columns), "transaction_id", "left"))
    status = (
        F.when(F.col("ts").isNull(), F.lit("unknown"))
        .when(F.col("chargeback_ts") <= F.col("ts") + F.make_dt_interval(F.lit(days)), F.lit("matched"))
        .otherwise(F.lit("late"))
    )
    return both.select("transaction_id", "ts", "amount", "chargeback_ts", status.alias("label_status"))


def run_batches(stream: DataFrame, name: str, each, progress: str | None = None) -> None:
    """Hand every batch of what is available to ``each(batch, batch_id)``."""
    progress = progress or shared_path(stream.sparkSession, f"progress-{name}")
    writer = stream.writeStream.foreachBatch(each).outputMode("append").option("checkpointLocation", progress)
    with rocksdb(stream.sparkSession):
        writer.trigger(availableNow=True).start().awaitTermination()


def labels_into(labels: DataFrame, table: str, sink: str, days: int = LABEL_DAYS, progress: str | None = None) -> None:
    """A stream of chargebacks against a stored table: the status of each goes to ``sink``, by chargeback day and batch."""
    spark = labels.sparkSession

    def each(batch: DataFrame, batch_id: int) -> None:
        found = match_labels(batch, spark.read.parquet(table), days)
        if found is not None:
            append_batch(found, batch_id, sink, "chargeback_ts")

    run_batches(labels, "labels", each, progress)
