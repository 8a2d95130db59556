"""Monitoring of a feature table and its scores."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cardwatch import schema as S
from cardwatch.functions.expressions import ratio
from cardwatch.operators import drift
from cardwatch.sources.session import materialize
from cardwatch.sources.transactions import write_table, write_text


@dataclass(frozen=True)
class Report:
    features: DataFrame
    scores: DataFrame
    kpis: DataFrame
    alerts: DataFrame
    decision: DataFrame
    summary: DataFrame


def monitor(features: DataFrame, scored: DataFrame, columns: list[str]) -> Report:
    """All monitoring tables for frames with a ``side`` column (baseline or production).

    The report has one row per feature and the score figures one row in all; they are stored since several outputs
    read them.
    """
    report = materialize(drift.feature_drift(features, columns))
    scores = materialize(drift.score_drift(scored))
    kpis = materialize(drift.business_kpis(scored.where(F.col("side") == "production")))
    decision = drift.retrain_decision(report, scores, kpis)
    return Report(report, scores, kpis, drift.kpi_alerts(kpis), decision, drift.monitoring_summary(decision))


@dataclass(frozen=True)
class DailyTables:
    """Monitoring kept as small tables that add up: counts per day, feature and bin, and KPI sums per day.

    ``start`` stores the profile and the counts of a baseline once. ``add`` reads the rows of the days it is given and
    nothing else; a day given again replaces its own folder. ``report`` adds up the days of a window.
    """

    spark: SparkSession
    path: str

    def start(self, baseline: DataFrame, bins: dict[str, int]) -> None:
        profile = drift.baseline_profile(baseline.withColumn("side", F.lit("baseline")), bins)
        rows = [(c, e, profile.means[c]) for c, e in profile.edges.items()]
        table = self.spark.createDataFrame(rows, "feature string, edges array<double>, mean double")
        table.write.mode("overwrite").parquet(f"{self.path}/profile")
        drift.bin_counts(baseline, profile, []).write.mode("overwrite").parquet(f"{self.path}/baseline")

    def profile(self) -> drift.Profile:
        rows = self.spark.read.parquet(f"{self.path}/profile").collect()  # a row per feature
        return drift.Profile({r.feature: list(r.edges) for r in rows}, {r.feature: r.mean for r in rows})

    def add(self, days: DataFrame, threshold: float = S.BLOCK_THRESHOLD) -> None:
        """Days of scored transactions with their features, ``ts`` and ``is_fraud``."""
        dated = days.withColumn("day", F.to_date("ts"))
        counts = drift.bin_counts(dated, self.profile(), ["day"])
        kpis = dated.groupBy("day").agg(*drift.kpi_sums(threshold))
        for name, table in (("bins", counts), ("kpis", kpis)):
            writer = table.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
            writer.partitionBy("day").parquet(f"{self.path}/{name}")

    def _days(self, name: str, first=None, last=None) -> DataFrame:
        table = self.spark.read.parquet(f"{self.path}/{name}")
        if first is not None:
            table = table.where(F.col("day") >= F.lit(first).cast("date"))
        return table if last is None else table.where(F.col("day") <= F.lit(last).cast("date"))

    def report(self, first=None, last=None, score: str = "fraud_score") -> Report:
        """All monitoring tables for the days from ``first`` to ``last`` against the baseline; no transaction is read."""
        profile = self.profile()
        base = self.spark.read.parquet(f"{self.path}/baseline").withColumn("side", F.lit("baseline"))
        days = self._days("bins", first, last).drop("day").withColumn("side", F.lit("production"))
        both = materialize(drift.drift_report(base.unionByName(days), profile))
        features = both.where(F.col("feature") != score)
        mean, other = F.col("baseline_mean"), F.col("production_mean")
        scores = both.where(F.col("feature") == score).withColumn("mean_shift_percent", ratio(other - mean, mean, None) * 100)
        sums = [F.sum(c).alias(c) for c in ("total_transactions", "predicted_fraud_count", "actual_fraud_count", "caught")]
        kpis = materialize(drift.kpis_of(self._days("kpis", first, last).agg(*sums)))
        decision = drift.retrain_decision(features, scores, kpis)
        return Report(features, scores, kpis, drift.kpi_alerts(kpis), decision, drift.monitoring_summary(decision))

    def trend(self, score: str = "fraud_score") -> DataFrame:
        """KPIs of every day, with the stability of the score on that day and over the last 7 and 30 days."""
        mine = F.col("feature") == score
        base = self.spark.read.parquet(f"{self.path}/baseline").where(mine)
        days = self._days("bins").where(mine).select("day", "bin", "n")
        spans = {"score_psi": 1, "score_psi_7d": 7, "score_psi_30d": 30}
        return drift.kpis_of(self._days("kpis")).join(drift.stability_trend(days, base, spans), "day")


def save(report: Report, folder: str) -> None:
    write_table(report.features.orderBy(F.desc("psi"), "feature"), f"{folder}/drift_report", "csv")
    lines = report.summary.orderBy("line_number").select("line")
    write_text(lines, f"{folder}/monitoring_summary")
