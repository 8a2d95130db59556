"""Drift from sketches, brackets and counts per bin, against numpy on the same values."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from cardwatch.operators import drift
from cardwatch.plans import monitor


def psi(base, prod, bins):
    """Straight from the definition."""
    base, prod = (np.asarray([v for v in x if v is not None and not np.isnan(v)], float) for x in (base, prod))
    if not len(base) or not len(prod):
        return 0.0
    edges = np.unique(np.percentile(base, np.linspace(0, 100, bins + 1)))
    if len(edges) < 2:
        return 0.0
    shares = [np.maximum(np.histogram(x, edges)[0] / len(x), 1e-10) for x in (base, prod)]
    return float(np.sum((shares[1] - shares[0]) * np.log(shares[1] / shares[0])))


def columns(n, seed=1):
    rng = np.random.default_rng(seed)
    return {
        "feat_smooth": rng.normal(50, 20, n),
        "feat_skewed": np.exp(rng.normal(3, 2, n)),
        "feat_few": rng.integers(0, 4, n).astype(float),
        "feat_flag": (rng.random(n) < 0.02).astype(float),
        "feat_constant": np.full(n, 7.0),
        "feat_spike": np.where(rng.random(n) < 0.6, 0.0, rng.normal(0, 1, n)),
        "feat_holes": np.where(rng.random(n) < 0.3, np.nan, rng.normal(0, 1e6, n)),
        "feat_nothing": np.full(n, np.nan),
    }


def frame(spark, n=4000, share=0.75, shift=1.3):
    data = columns(n)
    cut = int(n * share)
    for name in ("feat_smooth", "feat_skewed"):
        data[name][cut:] *= shift
    rows = [
        ("baseline" if i < cut else "production", *[None if np.isnan(v[i]) and i % 2 else float(v[i]) for v in data.values()])
        for i in range(n)
    ]
    shape = "side string, " + ", ".join(f"{c} double" for c in data)
    return spark.createDataFrame(rows, shape).repartition(7), data, cut


@pytest.mark.parametrize("size, bracket, bins", [(2048, 0.005, 10), (8, 0.0005, 10), (64, 0.005, 20)])
def test_report_against_numpy(spark, monkeypatch, size, bracket, bins):
    """Rough sketches with narrow brackets miss their ranks and are widened: the numbers stay the same."""
    monkeypatch.setattr(drift, "SKETCH_SIZE", size)
    monkeypatch.setattr(drift, "BRACKET", bracket)
    df, data, cut = frame(spark)
    got = {r.feature: r for r in drift.feature_drift(df, list(data), bins).collect()}
    assert set(got) == set(data) - {"feat_nothing"}
    for name, r in got.items():
        base, prod = data[name][:cut], data[name][cut:]
        assert r.psi == pytest.approx(psi(base, prod, bins), abs=1e-9), name
        for value, want in ((r.baseline_mean, np.nanmean(base)), (r.production_mean, np.nanmean(prod)),
                            (r.baseline_std, np.nanstd(base)), (r.production_std, np.nanstd(prod))):
            assert value == pytest.approx(want, rel=1e-9, abs=1e-9), name


def test_brackets_are_widened(spark, monkeypatch):
    monkeypatch.setattr(drift, "SKETCH_SIZE", 8)
    monkeypatch.setattr(drift, "BRACKET", 0.0005)
    calls = []
    real = drift._bracket_counts
    monkeypatch.setattr(drift, "_bracket_counts", lambda rows, spans: calls.append(set(spans)) or real(rows, spans))
    df, data, cut = frame(spark)
    profile = drift.baseline_profile(df, dict.fromkeys(data, 10))
    assert len(calls) > 1 and calls[-1] < calls[0]
    for name in ("feat_smooth", "feat_skewed", "feat_spike"):
        assert profile.edges[name] == pytest.approx(np.unique(np.percentile(data[name][:cut], range(0, 101, 10))))


@pytest.mark.parametrize("side", ["baseline", "production"])
def test_a_side_without_rows(spark, side):
    df, data, _ = frame(spark, 200)
    got = {r.feature: r for r in drift.feature_drift(df.where(F.col("side") == side), list(data)).collect()}
    assert all(r.psi == 0 and r.status == "Stable" for r in got.values())
    empty = "production_mean" if side == "baseline" else "baseline_mean"
    assert all(r[empty] is None for r in got.values()) and got["feat_constant"].asDict().get("baseline_mean") in (7.0, None)
    assert drift.feature_drift(df.limit(0), list(data)).collect() == []


def test_counts_travel_once_per_bin(spark):
    """What the passes over the rows shuffle: partial counts, never the values outside of brackets."""
    df, data, _ = frame(spark)
    profile = drift.baseline_profile(df, dict.fromkeys(data, 10))
    counted = drift.bin_counts(df, profile, ["side"])
    assert counted.count() <= 2 * len(data) * 11
    plan = counted._jdf.queryExecution().executedPlan().toString()
    assert "partial_count(1)" in plan and plan.count("hashpartitioning") == 1 and "BroadcastHashJoin" in plan


def dated(spark, n=3000):
    df, data, cut = frame(spark, n)
    day = F.expr("timestamp_ntz'2024-01-01' + make_dt_interval(CAST(pmod(xxhash64(feat_smooth), 40) AS INT))")
    score = F.round(F.pmod(F.xxhash64("feat_skewed"), F.lit(1000)) / 1000.0, 3)
    return df.withColumns({"ts": day, "fraud_score": score, "is_fraud": F.when(F.pmod(F.xxhash64("feat_smooth"), F.lit(9)) == 0, 1).otherwise(0)})


def test_daily_tables_add_up(spark, tmp_path):
    df = dated(spark).cache()
    names = ["feat_smooth", "feat_skewed", "feat_few"]
    tables = monitor.DailyTables(spark, str(tmp_path))
    tables.start(df.where("side = 'baseline'"), {**dict.fromkeys(names, 10), "fraud_score": 20})
    new = df.where("side = 'production'")
    early = F.col("ts") < F.lit("2024-01-20").cast("timestamp_ntz")
    tables.add(new.where(early))
    files = {p: p.stat().st_mtime_ns for p in (tmp_path / "bins").rglob("*.parquet")}
    tables.add(new.where(~early))
    tables.add(new.where(~early))  # a delivery that comes twice
    assert all(p.exists() and p.stat().st_mtime_ns == t for p, t in files.items())
    whole = tables.report()
    want = {r.feature: r for r in drift.feature_drift(df, names).collect()}
    got = {r.feature: r for r in whole.features.collect()}
    assert set(got) == set(names)
    for name, r in got.items():
        assert r.psi == pytest.approx(want[name].psi) and r.production_std == pytest.approx(want[name].production_std)
    assert whole.scores.first().psi == pytest.approx(drift.score_drift(df).first().psi)
    assert whole.kpis.first().asDict() == pytest.approx(drift.business_kpis(new).first().asDict())
    window = tables.report(dt.date(2024, 1, 5), dt.date(2024, 1, 9))
    part = new.where(F.to_date("ts").between(F.lit("2024-01-05").cast("date"), F.lit("2024-01-09").cast("date")))
    assert window.kpis.first().total_transactions == part.count()
    part = df.where("side = 'baseline'").unionByName(part)
    want = {r.feature: r.psi for r in drift.feature_drift(part, names).collect()}
    assert {r.feature: r.psi for r in window.features.collect()} == pytest.approx(want)


def test_trend_windows(spark, tmp_path):
    df = dated(spark).cache()
    tables = monitor.DailyTables(spark, str(tmp_path))
    tables.start(df.where("side = 'baseline'"), {"fraud_score": 20})
    missing = F.to_date("ts") != F.lit("2024-01-15").cast("date")
    tables.add(df.where("side = 'production'").where(missing))
    trend = {r.day: r for r in tables.trend().collect()}
    rows = df.select("side", "ts", "fraud_score").collect()
    base = [r.fraud_score for r in rows if r.side == "baseline"]
    for day in (dt.date(2024, 1, 1), dt.date(2024, 1, 17), dt.date(2024, 2, 9)):
        for name, span in (("score_psi", 1), ("score_psi_7d", 7), ("score_psi_30d", 30)):
            inside = [r.fraud_score for r in rows if r.side == "production" and r.ts.date() != dt.date(2024, 1, 15)
                      and 0 <= (day - r.ts.date()).days < span]
            assert trend[day][name] == pytest.approx(psi(base, inside, 20), abs=1e-9)
    assert dt.date(2024, 1, 15) not in trend


def test_limits_are_searched_and_not_tried_one_by_one(spark):
    """Arrays of several lengths, equal limits and values beyond the last: the counts of a plain comparison, and a value
    meets no more limits than a search tree is deep."""
    limits = {"a": [1.0, 2.0, 2.0, 5.0], "b": [3.0], "c": [], "d": [float("-inf"), 0.0, 1.0, 2.0, 4.0, 8.0, 9.0, float("inf")]}
    numbers = [float("-inf"), -1.0, 0.0, 1.0, 1.5, 2.0, 3.0, 5.0, 8.5, 9.0, 1e300, float("inf")]
    rows = [(n, v, ls) for n, ls in limits.items() for v in numbers]
    frame = spark.createDataFrame(rows, "name string, value double, limits array<double>")
    counts = [drift._reached(F.col("value"), F.col("limits"), 8, beyond) for beyond in (False, True)]
    got = {(r.name, r.value): (r.reached, r.passed) for r in frame.select("name", "value", counts[0].alias("reached"), counts[1].alias("passed")).collect()}
    assert got == {(n, v): (sum(v >= x for x in ls), sum(v > x for x in ls)) for n, v, ls in rows}
    text = str(counts[0])
    assert "+" not in text and text.count("get(") == 8
