"""Curves over the whole score range, computed from counts per distinct score."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cardwatch.functions.expressions import ratio
from cardwatch.operators.quantiles import EVERYTHING, running, value_counts, with_totals


def score_counts(scored: DataFrame) -> DataFrame:
    """Rows and frauds per distinct score, ordered later by falling score."""
    flipped = scored.withColumn("_falling", -F.col("fraud_score"))
    return value_counts(flipped, [], "_falling", {"n": F.count(F.lit(1)), "frauds": F.sum("is_fraud")})


def _ranked(counts: DataFrame) -> DataFrame:
    ranked = running(counts, [], "_falling", ["n", "frauds"], "upto")
    return with_totals(ranked, counts, [], ["n", "frauds"])


def pr_curve(scored: DataFrame) -> DataFrame:
    """Precision and recall at every distinct score, with the share of frauds as the random baseline."""
    tp, hits = F.col("cum_frauds"), F.col("cum_n")
    return _ranked(score_counts(scored)).select(
        (-F.col("_falling")).alias("threshold"),
        ratio(tp, hits).alias("precision"),
        ratio(tp, F.col("total_frauds")).alias("recall"),
        ratio(F.col("total_frauds"), F.col("total_n")).alias("random_precision"),
    )


def average_precision(scored: DataFrame) -> DataFrame:
    """Sum of precision times the recall gained at each distinct score."""
    gain = ratio(F.col("frauds"), F.col("total_frauds"))
    value = F.sum(gain * ratio(F.col("cum_frauds"), F.col("cum_n")))
    return _ranked(score_counts(scored)).agg(F.coalesce(value, F.lit(0.0)).alias("average_precision"))


def roc_auc(scored: DataFrame) -> DataFrame:
    """Share of (fraud, legitimate) pairs in the right order, ties half, counted per distinct score."""
    frauds = F.col("frauds").cast("double")
    legit = F.col("n").cast("double") - frauds
    above = F.col("cum_frauds").cast("double") - frauds
    wins = F.sum(legit * (above + frauds / 2))
    pairs = F.max(F.col("total_frauds").cast("double") * (F.col("total_n") - F.col("total_frauds")))
    return _ranked(score_counts(scored)).agg(ratio(wins, pairs, None).alias("roc_auc"))


def ks_counts(df: DataFrame, value: str) -> DataFrame:
    sides = {
        "base": F.count_if(F.col("side") == "baseline"),
        "prod": F.count_if(F.col("side") == "production"),
    }
    return value_counts(df, [], value, sides)


def ks_from_counts(counts: DataFrame, value: str, by: list[str] | None = None) -> DataFrame:
    """Largest distance of the two distribution functions and its asymptotic p-value (Kolmogorov series), per group."""
    by = by or []
    keys = by or [EVERYTHING]
    ranked = with_totals(running(counts, by, value, ["base", "prod"], "upto"), counts, by, ["base", "prod"])
    gap = F.abs(ratio(F.col("cum_base"), F.col("total_base")) - ratio(F.col("cum_prod"), F.col("total_prod")))
    stats = ranked.groupBy(*keys).agg(
        F.max(gap).alias("ks_statistic"), F.max("total_base").alias("n1"), F.max("total_prod").alias("n2")
    )
    n1, n2 = F.col("n1").cast("double"), F.col("n2").cast("double")
    effective = n1 * n2 / (n1 + n2)
    exponent = -2 * effective * F.col("ks_statistic") * F.col("ks_statistic")
    terms = F.aggregate(
        F.sequence(F.lit(1), F.lit(100)),
        F.lit(0.0),
        lambda total, k: total + F.when(k % 2 == 1, F.lit(2.0)).otherwise(F.lit(-2.0)) * F.exp(exponent * k * k),
    )
    p = F.when(exponent > -0.1, F.lit(1.0)).otherwise(F.least(F.greatest(terms, F.lit(0.0)), F.lit(1.0)))
    return stats.select(*keys, "ks_statistic", p.alias("ks_pvalue"))


def ks_two_sample(df: DataFrame, value: str) -> DataFrame:
    """Two-sample test of the rows with side=baseline against side=production."""
    return ks_from_counts(ks_counts(df, value), value).drop(EVERYTHING)
