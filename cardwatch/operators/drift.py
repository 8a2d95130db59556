"""Population stability, score drift, alerts and the retraining decision."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cardwatch import schema as S
from cardwatch.functions.expressions import drift_action, drift_status, ratio
from cardwatch.operators.curves import ks_from_counts
from cardwatch.operators.quality import feature_columns
from cardwatch.operators.quantiles import EVERYTHING, exact_quantiles, value_counts
from cardwatch.sources.session import materialize

FLOOR = 1e-10


def side_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """(feature, value, base, prod): how often each value of each column occurs on either side.

    For a test of whole distributions and for bins of single values; equal values travel once.
    """
    long = df.unpivot(["side"], [F.col(c).cast("double").alias(c) for c in columns], "feature", "value")
    counts = {
        "base": F.count_if(F.col("side") == "baseline"),
        "prod": F.count_if(F.col("side") == "production"),
    }
    return value_counts(long, ["feature"], "value", counts)


def _psi_sum(parts: DataFrame) -> DataFrame:
    """Sum over bins from (feature, base, prod, total_base, total_prod); shares have a floor."""
    base = F.greatest(ratio(F.col("base"), F.col("total_base")), F.lit(FLOOR))
    prod = F.greatest(ratio(F.col("prod"), F.col("total_prod")), F.lit(FLOOR))
    return parts.groupBy("feature").agg(F.sum((prod - base) * F.ln(prod / base)).alias("psi"))


def _side_totals(counts: DataFrame) -> DataFrame:
    return counts.groupBy("feature").agg(F.sum("base").alias("total_base"), F.sum("prod").alias("total_prod"))


def psi_from_counts(counts: DataFrame, bins: int = 10) -> DataFrame:
    """Stability index per feature over bins at baseline quantiles.

    Values outside the baseline range belong to no bin but stay in the denominator; features whose quantiles coincide,
    or with an empty side, get 0.
    """
    probs = [i / bins for i in range(bins + 1)]
    breaks = (
        exact_quantiles(counts, ["feature"], "value", probs, "base")
        .groupBy("feature")
        .agg(F.array_sort(F.collect_set("quantile")).alias("edges"))
    )
    # One row per feature.
    sized = _side_totals(counts).join(breaks, "feature")
    usable = (F.size("edges") > 1) & (F.col("total_base") > 0) & (F.col("total_prod") > 0)
    value, edges = F.col("value"), F.col("edges")
    # The edges of a feature number bins + 1 at most; equal ones have been merged.
    below = sum((F.when(value >= F.get(edges, F.lit(i)), F.lit(1)).otherwise(F.lit(0)) for i in range(bins + 1)), F.lit(0))
    bin_of = F.when(value == F.element_at(edges, -1), F.size(edges) - 1).otherwise(below)
    inside = (value >= F.element_at(edges, 1)) & (value <= F.element_at(edges, -1))
    filled = (
        counts.join(F.broadcast(sized.where(usable)), "feature")
        .where(inside)
        .groupBy("feature", bin_of.alias("bin"))
        .agg(F.sum("base").alias("base"), F.sum("prod").alias("prod"))
    )
    all_bins = sized.where(usable).select(
        "feature", "total_base", "total_prod", F.explode(F.sequence(F.lit(1), F.size("edges") - 1)).alias("bin")
    )
    parts = all_bins.join(filled, ["feature", "bin"], "left").fillna(0, ["base", "prod"])
    psi = _psi_sum(parts)
    return (
        counts.select("feature")
        .distinct()
        .join(psi, "feature", "left")
        .select("feature", F.coalesce("psi", F.lit(0.0)).alias("psi"))
    )


def categorical_psi(counts: DataFrame) -> DataFrame:
    """Stability index with one bin per value, which also moves for columns with few values."""
    parts = counts.join(F.broadcast(_side_totals(counts)), "feature")
    return _psi_sum(parts)


def side_moments(counts: DataFrame) -> DataFrame:
    """Mean and population deviation per feature and side, null for a side without rows.

    Deviations are summed around the mean in a second pass over the stored counts, so that large values lose no digits.
    """
    sides = {"base": "baseline", "prod": "production"}
    v = F.col("value")
    means = counts.groupBy("feature").agg(
        *[ratio(F.sum(F.col(s) * v), F.sum(s), None).alias(f"{label}_mean") for s, label in sides.items()]
    )
    spread = [
        F.sqrt(ratio(F.sum(F.col(s) * (v - F.col(f"{label}_mean")) ** 2), F.sum(s), None)).alias(f"{label}_std")
        for s, label in sides.items()
    ]
    return counts.join(means, "feature").groupBy("feature", "baseline_mean", "production_mean").agg(*spread)


@dataclass(frozen=True)
class Profile:
    """What a baseline leaves for later comparisons: bin edges and a mean per feature. A few numbers per feature."""

    edges: dict[str, list[float]]
    means: dict[str, float]


#: Size of the sketches, and how far around a cut point the first bracket reaches, as a share of the rows. A bracket
#: that misses its rank is widened, so neither changes results.
SKETCH_SIZE = 2048
BRACKET = 0.005
#: Groups that sketches are merged in before the last merge, and steps of rank at which a sketch is read.
MERGE_GROUPS = 64
GRID = 2000


def long_rows(df: DataFrame, columns: list[str], by: list[str]) -> DataFrame:
    """(by, feature, value): one row per value that is a number."""
    entries = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value")) for c in columns])
    return df.select(*by, F.inline(entries)).where("value IS NOT NULL AND NOT isnan(value)")


def _reached(value: Column, limits: Column, most: int, beyond: bool = False) -> Column:
    """How many of the ascending numbers of an array column a value has reached, or has passed: a search tree over the
    places, so that a value meets a few of the limits and not all. Places behind the end of an array are never reached."""

    def search(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        middle = (low + high) // 2
        limit = F.get(limits, F.lit(middle))
        passed = value > limit if beyond else value >= limit
        return F.when(passed, search(middle + 1, high)).otherwise(search(low, middle))

    return search(0, most)


def baseline_profile(df: DataFrame, bins: dict[str, int]) -> Profile:
    """Exact quantile edges of the baseline rows of a frame that is stored, for the number of bins of each column.

    A mergeable sketch per column brackets every cut point. A second pass counts the rows between the brackets and, per
    value, those inside them; the ranks wanted lie inside, where the values are exact. What is shuffled is a sketch per
    column and task, then a row per column, bracket and value in it; the table is never sorted or laid out by value.
    """
    rows = long_rows(df.where(F.col("side") == "baseline"), list(bins), [])
    found = _sketched(rows)
    edges: dict[str, set[float]] = {c: set() for c in bins}
    open_ = {c: BRACKET for c in found}
    while open_:
        spans = {c: _brackets(found[c], bins[c], width) for c, width in open_.items()}
        counts = _bracket_counts(rows, spans)
        missed = _missed(counts, {c: _wanted(bins[c], found[c].n) for c in open_})
        probs = {c: {i / bins[c] for i in range(bins[c] + 1)} for c in open_}
        for r in exact_quantiles(counts, ["feature"], "value", sorted(set().union(*probs.values()))).collect():
            if r.feature not in missed and r.prob in probs[r.feature]:
                edges[r.feature].add(r.quantile)
        open_ = {c: width * 8 for c, width in open_.items() if c in missed}
    return Profile({c: sorted(e) for c, e in edges.items()}, {c: found[c].mean if c in found else 0.0 for c in bins})


def _sketched(rows: DataFrame) -> dict:
    """Count, range, mean and sketched quantiles of each feature; sketches are merged in groups of tasks first."""
    sketch = F.kll_sketch_agg_double("value", F.lit(SKETCH_SIZE)).alias("sketch")
    ends = [F.min("value").alias("min"), F.max("value").alias("max")]
    group = (F.spark_partition_id() % MERGE_GROUPS).alias("_group")
    parts = rows.groupBy("feature", group).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"), *ends, sketch)
    ends = [F.min("min").alias("min"), F.max("max").alias("max"), (F.sum("total") / F.sum("n")).alias("mean")]
    merged = parts.groupBy("feature").agg(F.sum("n").alias("n"), *ends, F.kll_merge_agg_double("sketch", F.lit(SKETCH_SIZE)).alias("sketch"))
    grid = F.expr("array(" + ", ".join(f"{i / GRID!r}D" for i in range(GRID + 1)) + ")")
    points = F.kll_sketch_get_quantile_double("sketch", grid).alias("points")
    return {r.feature: r for r in merged.select("feature", "n", "min", "max", "mean", points).collect()}


def _brackets(found, bins: int, width: float) -> list[tuple[float, float]]:
    """Disjoint ranges of values that should hold the cut points of a feature."""
    spans: list[tuple[float, float]] = []
    for i in range(bins + 1):
        first, last = math.floor((i / bins - width) * GRID), math.ceil((i / bins + width) * GRID)
        span = (found.min if first <= 0 else found.points[first], found.max if last >= GRID else found.points[last])
        if i in (0, bins):
            span = (found.min, found.min) if i == 0 else (found.max, found.max)
        if spans and span[0] <= spans[-1][1]:
            span = (spans[-1][0], max(span[1], spans.pop()[1]))
        spans.append(span)
    return spans


def _bracket_counts(rows: DataFrame, spans: dict[str, list[tuple[float, float]]]) -> DataFrame:
    """(feature, part, value, n): rows per value inside the brackets, and rows of each gap between them under the
    smallest value there. Parts are numbered in order, brackets with odd numbers."""
    limits = df_of(
        rows,
        [(c, [a for a, _ in s], [b for _, b in s]) for c, s in spans.items()],
        "feature string, starts array<double>, ends array<double>",
    )
    most = max(map(len, spans.values()))
    value = F.col("value")
    part = _reached(value, F.col("starts"), most) + _reached(value, F.col("ends"), most, beyond=True)
    placed = rows.join(F.broadcast(limits), "feature").select("feature", "value", part.alias("part"))
    own = F.when(F.col("part") % 2 == 1, F.col("value"))
    grouped = placed.groupBy("feature", "part", own.alias("own")).agg(F.min("value").alias("value"), F.count(F.lit(1)).alias("n"))
    return materialize(grouped.select("feature", "part", "value", "n"))


def _wanted(bins: int, n: int) -> set[int]:
    """Ranks whose values make the quantiles: one, or two where the quantile lies between."""
    places = [i / bins * (n - 1) for i in range(bins + 1)]
    return {math.floor(p) for p in places} | {math.ceil(p) for p in places}


def _missed(counts: DataFrame, wanted: dict[str, set[int]]) -> set[str]:
    """Features with a wanted rank outside of their brackets, from the rows per part, a few per feature."""
    parts = counts.groupBy("feature", "part").agg(F.sum("n").alias("n")).collect()
    missed, before = set(), dict.fromkeys(wanted, 0)
    for r in sorted(parts, key=lambda r: (r.feature, r.part)):
        start = before[r.feature]
        if r.part % 2 == 0 and any(start <= rank < start + r.n for rank in wanted[r.feature]):
            missed.add(r.feature)
        before[r.feature] += r.n
    return missed


def bin_counts(df: DataFrame, profile: Profile, by: list[str]) -> DataFrame:
    """(by, feature, bin, n, dev, dev2): rows per bin, 0 for values outside the baseline's range, and sums of the
    distance from the baseline's mean and of its square. Tables of different days or sides add up row by row.

    Rows are counted per task first: what is shuffled is at most a row per task, feature and bin.
    """
    limits = df_of(
        df, [(c, e, profile.means[c]) for c, e in profile.edges.items()], "feature string, edges array<double>, center double"
    )
    rows = long_rows(df, list(profile.edges), by).join(F.broadcast(limits), "feature")
    value, edges = F.col("value"), F.col("edges")
    last = F.try_element_at(edges, F.lit(-1))
    place = (
        F.when((F.size(edges) < 2) | (value > last), F.lit(0))
        .when(value == last, F.size(edges) - 1)
        .otherwise(_reached(value, edges, max(map(len, profile.edges.values()))))
    )
    rows = rows.select(*by, "feature", place.alias("bin"), (value - F.col("center")).alias("d"))
    sums = [F.count(F.lit(1)).alias("n"), F.sum("d").alias("dev"), F.sum(F.col("d") * F.col("d")).alias("dev2")]
    return rows.groupBy(*by, "feature", "bin").agg(*sums)


def _by_side(counts: DataFrame) -> DataFrame:
    """(feature, bin) with base and prod, and the sums of both sides, from counts by side."""
    sides = {"base": F.col("side") == "baseline", "prod": F.col("side") == "production"}
    sums = [F.sum(F.when(c, F.col(v)).otherwise(0)).alias(f"{s}{suffix}") for s, c in sides.items() for v, suffix in (("n", ""), ("dev", "_dev"), ("dev2", "_dev2"))]
    return counts.groupBy("feature", "bin").agg(*sums)


def drift_report(counts: DataFrame, profile: Profile) -> DataFrame:
    """Drift report from :func:`bin_counts` by side: one row per feature with any value, a stability index of 0 where
    edges coincide or a side is empty, null means for an empty side. All tables here have a row per feature and bin."""
    table = materialize(_by_side(counts))
    total = table.groupBy("feature").agg(
        *[F.sum(f"{s}{x}").alias(f"total_{s}{x}") for s in ("base", "prod") for x in ("", "_dev", "_dev2")]
    )
    usable = total.where("total_base > 0 AND total_prod > 0").select("feature", "total_base", "total_prod")
    grid = [(c, i) for c, e in profile.edges.items() for i in range(1, len(e))]
    all_bins = df_of(counts, grid, "feature string, bin int").join(usable, "feature")
    parts = all_bins.join(table.select("feature", "bin", "base", "prod"), ["feature", "bin"], "left").fillna(0, ["base", "prod"])
    center = df_of(counts, list(profile.means.items()), "feature string, center double")
    joined = total.join(center, "feature").join(_psi_sum(parts), "feature", "left")
    psi = F.coalesce("psi", F.lit(0.0))
    moments = []
    for side, label in (("base", "baseline"), ("prod", "production")):
        n = F.col(f"total_{side}")
        shift = ratio(F.col(f"total_{side}_dev"), n, None)
        spread = ratio(F.col(f"total_{side}_dev2"), n, None) - shift * shift
        moments += [(F.col("center") + shift).alias(f"{label}_mean"), F.sqrt(F.when(n > 0, F.greatest(spread, F.lit(0.0)))).alias(f"{label}_std")]
    report = joined.select("feature", psi.alias("psi"), *moments)
    order = ["baseline_mean", "production_mean", "baseline_std", "production_std"]
    return report.select(
        "feature", "psi", drift_status(F.col("psi")).alias("status"), drift_action(F.col("psi")).alias("action"), *order
    )


def df_of(like: DataFrame, rows: list[tuple], shape: str) -> DataFrame:
    """A few rows beside a frame of the same session."""
    return like.sparkSession.createDataFrame(rows, shape)


def feature_drift(df: DataFrame, columns: list[str] | None = None, bins: int = 10) -> DataFrame:
    """Drift report: one row per feature, for a stored frame with a ``side`` column; the frame is read three times."""
    profile = baseline_profile(df, {c: bins for c in columns or feature_columns(df)})
    return drift_report(bin_counts(df, profile, ["side"]), profile)


def top_drifted(report: DataFrame, n: int = 10) -> DataFrame:
    return report.orderBy(F.desc(F.round("psi", 9)), "feature").limit(n)


def mean_shift(report: DataFrame) -> DataFrame:
    """Change of the mean in percent of the baseline mean."""
    shift = (F.col("production_mean") - F.col("baseline_mean")) / (F.abs("baseline_mean") + F.lit(1e-10)) * 100
    return report.select("feature", "psi", shift.alias("mean_shift_percent"))


def status_counts(report: DataFrame) -> DataFrame:
    return report.groupBy("status").agg(F.count(F.lit(1)).alias("features"))


def score_drift(df: DataFrame, score: str = "fraud_score") -> DataFrame:
    """Drift of one score column between the sides: 20-bin stability, mean shift, KS and a status."""
    counts = side_counts(df.select("side", score), [score])
    ks = ks_from_counts(counts, "value", ["feature"])
    joined = psi_from_counts(counts, 20).join(side_moments(counts), "feature").join(ks, "feature")
    # From a mean of 0 there is no percentage: null, which counts as no shift at 0 again and as a full one otherwise.
    base, prod = F.col("baseline_mean"), F.col("production_mean")
    shifted = joined.withColumn("mean_shift_percent", ratio(prod - base, base, None) * 100)
    psi = F.col("psi")
    size = F.coalesce(F.abs("mean_shift_percent"), F.when(base != prod, F.lit(100.0)), F.lit(0.0))
    stable = (psi < S.PSI_MODERATE) & (size < 10)
    moderate = (psi < S.PSI_SIGNIFICANT) | (size < 20)
    status = F.when(stable, F.lit("Stable")).when(moderate, F.lit("Moderate drift")).otherwise(F.lit("Significant drift"))
    action = (
        F.when(stable, F.lit("Continue monitoring"))
        .when(moderate, F.lit("Investigate and consider retraining"))
        .otherwise(F.lit("Retrain immediately"))
    )
    return shifted.select(
        "psi",
        "ks_statistic",
        "ks_pvalue",
        "baseline_mean",
        "production_mean",
        "mean_shift_percent",
        "baseline_std",
        "production_std",
        status.alias("status"),
        action.alias("action"),
    )


def stability_trend(days: DataFrame, baseline: DataFrame, spans: dict[str, int]) -> DataFrame:
    """Stability index of each day and of the days before it, against a fixed baseline: one row per day and a column per
    entry of ``spans`` (number of days).

    ``days`` is (day, bin, n) and ``baseline`` (bin, n) of one feature, with bin 0 for values outside; the tables have a
    row per day and bin, so the windows hold days and not transactions.
    """
    bins = baseline.where("bin > 0").select("bin", F.col("n").alias("base"))
    total = baseline.agg(F.sum("n").alias("total_base")).withColumn(EVERYTHING, F.lit(0))
    known = bins.withColumn(EVERYTHING, F.lit(0)).join(total, EVERYTHING)
    sizes = days.groupBy("day").agg(F.sum("n").alias("rows")).withColumn(EVERYTHING, F.lit(0))
    grid = sizes.join(known, EVERYTHING).join(days, ["day", "bin"], "left").fillna(0, ["n"])
    number = F.datediff("day", F.lit("1970-01-01").cast("date"))
    work = grid.withColumn("_day", number)
    out = []
    for name, span in spans.items():
        window = Window.partitionBy("bin").orderBy("_day").rangeBetween(1 - span, 0)
        base = F.greatest(ratio(F.col("base"), F.col("total_base")), F.lit(FLOOR))
        prod = F.greatest(ratio(F.sum("n").over(window), F.sum("rows").over(window)), F.lit(FLOOR))
        work = work.withColumn(f"_{name}", (prod - base) * F.ln(prod / base))
        out.append(F.sum(f"_{name}").alias(name))
    return work.groupBy("day").agg(*out)


def score_histogram(df: DataFrame, score: str = "fraud_score", bins: int = 50) -> DataFrame:
    """Counts of both sides in ``bins`` equal bins from 0 to 1."""
    place = F.least(F.floor(F.col(score) * bins), F.lit(bins - 1)).cast("int")
    return df.groupBy("side", place.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def business_kpis(scored: DataFrame, threshold: float = S.BLOCK_THRESHOLD) -> DataFrame:
    """One row of operating figures for a scored and labelled table."""
    return kpis_of(scored.agg(*kpi_sums(threshold)))


def kpi_sums(threshold: float = S.BLOCK_THRESHOLD) -> list[Column]:
    hit = F.col("fraud_score") >= F.lit(threshold)
    return [
        F.count(F.lit(1)).alias("total_transactions"),
        F.count_if(hit).alias("predicted_fraud_count"),
        F.sum("is_fraud").alias("actual_fraud_count"),
        F.sum(F.when(hit, F.col("is_fraud")).otherwise(0)).alias("caught"),
    ]


def kpis_of(sums: DataFrame) -> DataFrame:
    """Operating figures from :func:`kpi_sums`, which add up over days."""
    total, alerts = F.col("total_transactions"), F.col("predicted_fraud_count")
    other = [c for c in sums.columns if c not in ("total_transactions", "predicted_fraud_count", "actual_fraud_count", "caught")]
    return sums.select(
        *other,
        "total_transactions",
        "predicted_fraud_count",
        (ratio(alerts, total) * 100).alias("predicted_fraud_rate"),
        ((1 - ratio(alerts, total)) * 100).alias("approval_rate"),
        (ratio(F.col("caught"), F.col("actual_fraud_count")) * 100).alias("fraud_detection_rate"),
        (ratio(F.col("caught"), alerts) * 100).alias("precision"),
        "actual_fraud_count",
    )


def _low_detection() -> Column:
    return (F.col("fraud_detection_rate") < S.MIN_DETECTION_RATE) & (F.col("actual_fraud_count") > 0)


def kpi_alerts(kpis: DataFrame) -> DataFrame:
    """One row per alert. Frauds of which none was detected raise an alert; a period without frauds does not."""
    approval, detection, precision = F.col("approval_rate"), F.col("fraud_detection_rate"), F.col("precision")
    low_approval = approval < S.MIN_APPROVAL_RATE
    low_detection = _low_detection()
    low_precision = (precision < S.MIN_PRECISION) & (F.col("predicted_fraud_count") > 0)
    alerts = [
        F.when(low_approval, F.format_string(S.APPROVAL_ALERT, approval)),
        F.when(low_detection, F.format_string(S.DETECTION_ALERT, detection)),
        F.when(low_precision, F.format_string(S.PRECISION_ALERT, precision)),
        F.when(~low_approval & ~low_detection, F.lit(S.NO_ALERT)),
    ]
    return kpis.select(F.explode(F.array_compact(F.array(*alerts))).alias("alert"))


def retrain_decision(report: DataFrame, score: DataFrame, kpis: DataFrame) -> DataFrame:
    """One row: whether to retrain, and every reason."""
    high = report.agg(F.count_if(F.col("psi") >= S.PSI_SIGNIFICANT).alias("high")).withColumn(EVERYTHING, F.lit(0))
    scores = score.select(
        F.col("psi").alias("score_psi"), F.col("mean_shift_percent").alias("shift"), F.lit(0).alias(EVERYTHING)
    )
    one = high.join(scores, EVERYTHING).join(kpis.withColumn(EVERYTHING, F.lit(0)), EVERYTHING)
    approval = F.col("approval_rate")
    found = [
        F.when(F.col("high") >= 3, F.format_string(S.FEATURES_REASON, F.col("high"))),
        F.when(F.col("score_psi") >= S.PSI_SIGNIFICANT, F.format_string(S.SCORE_REASON, F.col("score_psi"))),
        F.when(F.abs("shift") > 20, F.format_string(S.SHIFT_REASON, F.col("shift"))),
        F.when(approval < S.MIN_APPROVAL_RATE, F.format_string(S.APPROVAL_REASON, approval)),
        F.when(_low_detection(), F.format_string(S.DETECTION_REASON, F.col("fraud_detection_rate"))),
    ]
    reasons = F.array_compact(F.array(*found))
    return one.select(
        (F.size(reasons) > 0).alias("should_retrain"),
        F.size(reasons).alias("reason_count"),
        F.concat_ws("; ", reasons).alias("reasons"),
        "score_psi",
        "approval_rate",
        "fraud_detection_rate",
    )


def monitoring_summary(decided: DataFrame) -> DataFrame:
    """The summary as numbered text lines."""
    lines = F.array_compact(
        F.array(
            F.concat(F.lit("Retrain Required: "), F.when(F.col("should_retrain"), F.lit("YES")).otherwise(F.lit("NO"))),
            F.when(F.col("should_retrain"), F.concat(F.lit("Reasons: "), F.col("reasons"))),
            F.concat(F.lit("Score Drift PSI: "), F.format_string("%.4f", F.col("score_psi"))),
            F.concat(F.lit("Approval Rate: "), F.format_string("%.2f", F.col("approval_rate")), F.lit("%")),
            F.concat(
                F.lit("Fraud Detection Rate: "), F.format_string("%.2f", F.col("fraud_detection_rate")), F.lit("%")
            ),
        )
    )
    return decided.select(F.posexplode(lines).alias("line_number", "line"))


def sustained_breach(kpis: DataFrame, days: int = 3, minimum: float = S.MIN_APPROVAL_RATE) -> DataFrame:
    """Runs of at least ``days`` consecutive days with an approval rate below the minimum, per model.

    The input has one row per model and day, so the window holds days, not transactions.
    """
    low = kpis.where(F.col("approval_rate") < minimum)
    order = Window.partitionBy("model").orderBy("day")
    island = F.date_sub("day", F.row_number().over(order))
    return (
        low.withColumn("_island", island)
        .groupBy("model", "_island")
        .agg(
            F.min("day").alias("first_day"),
            F.max("day").alias("last_day"),
            F.count(F.lit(1)).alias("days"),
            F.min("approval_rate").alias("lowest_approval"),
        )
        .where(F.col("days") >= days)
        .drop("_island")
    )
