"""Time and row based splits, training windows and samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cardwatch import schema as S
from cardwatch.functions.expressions import DAY_US, epoch_micros
from cardwatch.operators.quantiles import row_at_rank


def split_day(df: DataFrame, train_months: int = S.TRAIN_MONTHS, test_months: int = S.TEST_MONTHS):
    """First time + whole training days; train_months of the span train and test_months test."""
    span = df.agg(
        F.min("ts").alias("lo"),
        F.floor((F.max(epoch_micros(df, "ts")) - F.min(epoch_micros(df, "ts"))) / F.lit(DAY_US)).alias("days"),
    )
    days = F.floor(F.col("days") * F.lit(train_months) / F.lit(train_months + test_months)).cast("int")
    return span.select((F.col("lo") + F.make_dt_interval(days)).alias("split")).first().split


def temporal_split(df: DataFrame, train_months: int = S.TRAIN_MONTHS, test_months: int = S.TEST_MONTHS) -> DataFrame:
    """Mark rows before the split time as train and all later ones as test.

    The time is a single value, so the filter on it is a plain comparison that reaches the scan.
    """
    at = split_day(df, train_months, test_months)
    edge = F.lit(at).cast(df.schema["ts"].dataType)
    return df.withColumn("split", F.when(F.col("ts") < edge, F.lit("train")).otherwise(F.lit("test")))


def rowcount_split(df: DataFrame, share: float = 0.75, source: DataFrame | None = None) -> DataFrame:
    """Mark the first ``share`` of the rows in (ts, transaction_id) order as baseline and the rest as production.

    ``source`` may name a cheaper frame with the same rows to search for the border in.
    """
    source = df if source is None else source
    border = row_at_rank(source, epoch_micros(source, "ts"), F.col("transaction_id"), int(source.count() * share))
    return df.withColumn("side", _before(df, border))


def _before(df: DataFrame, border) -> Column:
    if border is None:
        return F.lit("baseline")
    us = epoch_micros(df, "ts")
    earlier = (us < border["at"]) | ((us == border["at"]) & (F.col("transaction_id") < F.lit(border["tie"])))
    return F.when(earlier, F.lit("baseline")).otherwise(F.lit("production"))


def training_window(df: DataFrame, today, days: int = 90, label_lag_days: int = 7) -> DataFrame:
    """Rows of the last ``days`` days without the last ``label_lag_days``, whose labels are still incomplete."""
    return df.where(in_training_window(today, days, label_lag_days))


def in_training_window(today, days: int = 90, label_lag_days: int = 7) -> Column:
    start = F.lit(today) - F.make_dt_interval(F.lit(days))
    end = F.lit(today) - F.make_dt_interval(F.lit(label_lag_days))
    return (F.col("ts") >= start) & (F.col("ts") <= end)


def deterministic_sample(df: DataFrame, size: int, seed: int = 42) -> DataFrame:
    """The same ``size`` rows whatever the partitioning: the smallest hashes of (seed, id)."""
    order = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("transaction_id").cast("string")))
    return df.orderBy(order, "transaction_id").limit(size)
