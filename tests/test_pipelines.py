"""Sources, sinks, validation, labels, streams and the shape of plans."""

import datetime as dt
import json
import re

import numpy as np
import pandas as pd
import pytest
from compare import SMALL
from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from cardwatch import schema as S
from cardwatch.operators import features, quality, retrain, scoring
from cardwatch.plans import catalog, monitor, training, validation
from cardwatch.sources import session, transactions
from cardwatch.streaming import jobs, velocity


def test_csv_scan_has_declared_types(spark, tmp_path):
    names = ",".join(f.name for f in S.RAW_TRANSACTIONS)
    line = (
        "TXN_00000001,USER_1,MERCH_1,5411,Grocery Stores,12.5,USD,US,DEVICE_1,1.2.3.4,2024-01-02 03:04:05,1,"
        "2024-01-09 03:04:05,7,3,1,1,0.0,0,1"
    )
    (tmp_path / "t.csv").write_text(f"{names}\n{line}\n")
    r = transactions.read_transactions(spark, str(tmp_path / "t.csv"), "csv").first()
    assert r.ts == dt.datetime(2024, 1, 2, 3, 4, 5) and r.chargeback_ts == dt.datetime(2024, 1, 9, 3, 4, 5)
    assert (r.transaction_id, r.mcc, r.amount, r.is_fraud, r.delay_days) == ("TXN_00000001", "5411", 12.5, 1, 7)


def test_string_ids_work_through_the_features(spark, tmp_path):
    rows = [(f"TXN_{i}", dt.datetime(2024, 1, 1, i), "u", "m", "d", "1.1.1.1", "US", 5.0 * i, 0, "5411") for i in range(5)]
    shape = "transaction_id string, ts timestamp_ntz, user_id string, merchant_id string, device_id string, ip_id string, country string, amount double, is_fraud int, mcc string"
    out = features.all_features(spark.createDataFrame(rows, shape))
    assert len(quality.feature_columns(out)) == 31 and out.count() == 5
    assert {r.model_version for r in retrain.assign_versions(out).collect()} <= {
        retrain.CHALLENGER_VERSION,
        retrain.CHAMPION_VERSION,
    }


def test_sinks(spark, tmp_path):
    tx = transactions.event_transactions(spark, SMALL)
    sided = catalog.sided_features(spark, SMALL)
    report = monitor.monitor(sided, catalog.sided_champion(spark, SMALL), ["feat_hour", "feat_is_night"])
    monitor.save(report, str(tmp_path / "report"))
    lines = [r.value for r in spark.read.text(str(tmp_path / "report" / "monitoring_summary")).collect()]
    assert any(line.startswith("Retrain Required: ") for line in lines)
    stored = spark.read.option("header", True).csv(str(tmp_path / "report" / "drift_report"))
    assert stored.count() == 2 and stored.columns[:4] == ["feature", "psi", "status", "action"]
    transactions.write_json(tx.limit(3).select("transaction_id"), str(tmp_path / "json"))
    assert spark.read.json(str(tmp_path / "json")).count() == 3


def test_validation(spark):
    shape = "transaction_id string, user_id string, merchant_id string, amount double, country string, device_id string, ip_id string, mcc string"
    rows = [
        ("ok", "u", "m", 5.0, "us", "d", "i", "5411"),
        ("large", "u", "m", 10001.0, "US", "d", "i", "5411"),
        ("zero", "u", "m", 0.0, "US", "d", "i", "5411"),
        ("two", None, "m", -1.0, "USA", "d", "i", "5411"),
        ("nan", "u", "m", float("nan"), "US", "d", "i", "5411"),
    ]
    df = spark.createDataFrame(rows, shape)
    good = {r.transaction_id: r for r in quality.valid_requests(df).collect()}
    assert set(good) == {"ok", "large"} and good["ok"].country == "US" and good["ok"].currency == "USD"
    assert good["large"].warnings == ["large amount"] and good["ok"].warnings == []
    bad = [(r.transaction_id, r.error) for r in quality.rejected_requests(df).collect()]
    assert sorted(bad) == [
        ("nan", "amount must be greater than 0"),
        ("two", "amount must be greater than 0"),
        ("two", "country must have 2 letters"),
        ("two", "user_id is required"),
        ("zero", "amount must be greater than 0"),
    ]


def test_feature_matrix_cleans(spark):
    df = spark.createDataFrame([(1, None), (2, float("nan")), (3, float("-inf")), (4, 1.5)], "transaction_id int, feat_x double")
    assert [r.feat_x for r in quality.feature_matrix(df).orderBy("transaction_id").collect()] == [0.0, 0.0, 0.0, 1.5]


def test_defaults_without_store(spark):
    served = scoring.with_history_defaults(transactions.event_transactions(spark, SMALL)).first()
    assert served.feat_tx_count_user_24h == 3 and served.feat_amount_sum_user_24h == served.amount * 3
    assert served.feat_merchant_fraud_rate_historical == 0.01
    assert served.feat_amount_vs_user_avg == pytest.approx((served.amount - 150) / 76)


def test_label_backfill_ignores_duplicates_and_late_labels(spark):
    day = lambda d: dt.datetime(2024, 1, d)
    tx = spark.createDataFrame([(1, 0), (2, 0), (3, 1)], "transaction_id int, is_fraud int")
    labels = spark.createDataFrame(
        [(1, day(5)), (1, day(6)), (2, day(20)), (9, day(1))], "transaction_id int, chargeback_ts timestamp_ntz"
    )
    out = retrain.backfill_labels(tx, labels, day(10)).orderBy("transaction_id").collect()
    assert [r.is_fraud for r in out] == [1, 0, 1]
    assert [r.transaction_id for r in retrain.unmatched_labels(tx, labels).collect()] == [9]


def test_payload_has_no_label_time_or_nulls(spark):
    r = catalog.QUERIES["request_payload"](spark, SMALL).where("transaction_id = 1").first()
    body = json.loads(r.payload)
    assert "is_fraud" not in body and "ts" not in body and "delay_days" not in body
    assert isinstance(body["merchant_category_code"], str) and isinstance(body["user_id"], float)


def test_trailing_sums():
    minutes = np.array([0, 30, 59, 60, 61])
    assert velocity.trailing(minutes, np.ones(5, dtype=int), 60).tolist() == [1, 2, 3, 3, 4]


def test_state_goes_on_between_batches(spark, tmp_path):
    """The stream sees the events in two files, one per batch; the state carries the first into the second."""
    events = spark.read.schema(S.EVENTS).parquet(f"{SMALL}/events.parquet").toPandas().sort_values("ts")
    folder = tmp_path / "in"
    folder.mkdir()
    for i, part in enumerate((events[:500], events[500:])):
        frame = spark.createDataFrame(part, S.EVENTS).coalesce(1)
        pd_part = frame.toPandas()
        pd_part["ts"] = pd_part["ts"].astype("datetime64[us]")
        pd_part.to_parquet(folder / f"events-{i}.parquet", index=False)
    import os

    os.utime(folder / "events-0.parquet", (1, 1))
    stream = spark.readStream.schema(S.EVENTS).option("maxFilesPerTrigger", 1).parquet(str(folder))
    tx = transactions.from_events(stream)
    tx = tx.withColumn("at", jobs.as_instant(tx, "ts"))
    got = jobs.drain(jobs.user_velocity(tx), "two-batches").toPandas()
    minute = events["ts"].dt.floor("min")
    closed = events[minute + pd.Timedelta(minutes=1) <= events["ts"].max() - pd.Timedelta(minutes=10)]
    counts = closed.groupby(["user_id", minute]).size()
    assert got.groupby("user_id")["tx_1h"].count().sum() == len(counts)
    for (user, at), _ in list(counts.items())[-50:]:
        mine = counts[user]
        window = mine[(mine.index > at - pd.Timedelta(hours=24)) & (mine.index <= at)].sum()
        stamp = int(at.value // 60_000_000_000) if at.unit == "ns" else int(at.as_unit("ns").value // 60_000_000_000)
        row = got[(got.user_id == user) & (got.minute == stamp)]
        assert int(row.tx_24h.iloc[0]) == window


def plan(df):
    return df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")


def test_velocity_plan(spark):
    text = plan(catalog.QUERIES["velocity_features"](spark, SMALL))
    tree = text.split("\n\n")[0]
    assert len(re.findall(r"Exchange", tree)) == 2 and len(re.findall(r"\bSort\b", tree)) == 2
    assert "PythonUDF" not in text and "ArrowEvalPython" not in text
    assert "ReadSchema: struct<event_id:bigint,ts:timestamp_ntz,user_id:bigint,value:double>" in text


def test_feature_plan_has_one_shuffle_per_key(spark):
    tx = transactions.event_transactions(spark, SMALL)
    names = [n for n in S.ALL_FEATURES if n in features.HISTORY_FEATURES]
    tree = plan(features.add_history(tx, names)).split("\n\n")[0]
    assert len(re.findall(r"Exchange", tree)) == 4 and "Join" not in tree


def test_threshold_sweep_scans_once(spark):
    tree = plan(catalog.QUERIES["threshold_sweep_100"](spark, SMALL)).split("\n\n")[0]
    assert len(re.findall(r"Scan parquet", tree)) == 1


def test_time_split_reaches_the_scan(spark):
    text = plan(catalog.training_window(spark, SMALL))
    assert "PushedFilters: [IsNotNull(ts), GreaterThanOrEqual(ts" in text


def test_checkpoint_folder_of_the_session_is_used(spark, tmp_path, monkeypatch):
    # The real setting is fixed once the session runs.
    monkeypatch.setattr(session, "CHECKPOINT_CONF", "spark.cardwatch.testFolder")
    spark.conf.set(session.CHECKPOINT_CONF, str(tmp_path))
    try:
        session.materialize(spark.range(3)).count()
        assert any(p.name.startswith("stage-") for p in tmp_path.iterdir())
    finally:
        spark.conf.unset(session.CHECKPOINT_CONF)


def test_rejected_requests_are_no_history(spark):
    base = quality.check_requests(transactions.event_transactions(spark, SMALL).where("user_id < 5"))
    spoilt = F.when(F.col("transaction_id") % 3 == 0, F.array(F.lit("refused"))).otherwise(F.col("errors"))
    all_rows = validation.score_checked(base.withColumn("errors", spoilt))
    alone = validation.score_checked(base.where("transaction_id % 3 != 0"))
    got = {r.transaction_id: r.fraud_score for r in all_rows.collect()}
    want = {r.transaction_id: r.fraud_score for r in alone.collect()}
    assert {k: v for k, v in got.items() if k % 3} == want and all(v is None for k, v in got.items() if k % 3 == 0)


def test_class_weights_need_both_classes(spark):
    day = dt.datetime(2024, 1, 1)
    none = spark.createDataFrame([(i, day, 1.0, 0, "train") for i in range(4)], "transaction_id int, ts timestamp_ntz, amount double, is_fraud int, split string")
    assert tuple(retrain.class_weights(none).first()) == (None, 0.5, None)
    with pytest.raises(ValueError, match="both frauds"):
        training.weighted(none, balanced=True)


def test_stored_tables_need_a_folder_on_a_cluster(spark, monkeypatch):
    monkeypatch.setattr(session, "checkpoint_root", lambda _: None)
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.materialize(spark.range(3))


def test_days_are_written_once(spark, tmp_path):
    """Each day's folder holds a few files, however many tasks computed the rows."""
    days = spark.range(2000).selectExpr("id", "date_add(DATE '2024-01-01', CAST(id % 5 AS INT)) AS day").repartition(8)
    path = transactions.write_table(days, str(tmp_path / "days"), partition_by=["day"])
    assert all(len(list(p.glob("*.parquet"))) == 1 for p in (tmp_path / "days").glob("day=*"))
    assert spark.read.parquet(path).count() == 2000


def test_monitoring_builds_features_once(spark):
    frame = catalog.monitoring_frame(spark, SMALL)
    plan = frame._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "Window" not in plan


def test_streams_go_on_where_they_stopped(spark, tmp_path):
    """The same sink and progress folders: the second run reads the new file only."""
    events = spark.read.schema(S.EVENTS).parquet(f"{SMALL}/events.parquet")
    folder, sink, progress = (str(tmp_path / n) for n in ("in", "out", "progress"))
    seen = []
    for part in ("event_id < 300", "event_id >= 300"):
        events.where(part).coalesce(1).write.mode("append").parquet(folder)
        tx = transactions.from_events(spark.readStream.schema(S.EVENTS).parquet(folder))
        stream = jobs.deduplicated(tx.withColumn("at", jobs.as_instant(tx, "ts"))).select("transaction_id")
        seen.append(jobs.drain(stream, "resumed", sink=sink, progress=progress).count())
    assert seen == [300, events.count()]


def test_late_and_unknown_labels(spark):
    day = lambda d: dt.datetime(2024, 1, 1) + dt.timedelta(days=d)
    stored = spark.createDataFrame([(1, day(0), 5.0), (2, day(0), 5.0)], "transaction_id int, ts timestamp_ntz, amount double")
    labels = spark.createDataFrame([(1, day(90)), (2, day(91)), (3, day(5))], "transaction_id int, chargeback_ts timestamp_ntz")
    got = {r.transaction_id: r.label_status for r in jobs.label_join(labels, stored).collect()}
    assert got == {1: "matched", 2: "late", 3: "unknown"}


SAMPLES = [
    # An ordinary purchase, a doubtful one and one with nothing but what is required.
    ("ok", "u1", "m1", 45.5, "us", "d1", "1.1.1.1", "5411", "Grocery Stores", "USD", None),
    ("large", "u2", "m2", 15000.0, "NG", "d2", "2.2.2.2", "7995", "Gambling", None, dt.datetime(2024, 1, 2)),
    ("bare", "u3", "m3", 9.0, "GB", "d3", "3.3.3.3", "5812", None, None, None),
]


def test_complete_requests(spark):
    shape = "transaction_id string, user_id string, merchant_id string, amount double, country string, device_id string, ip_id string, mcc string, merchant_category string, currency string, ts timestamp_ntz"
    now = F.lit("2024-05-01 10:00:00").cast("timestamp_ntz")
    df = spark.createDataFrame(SAMPLES, shape)
    got = {r.transaction_id: r for r in quality.complete_requests(df, now).collect()}
    assert got["ok"].errors == [] and got["ok"].country == "US" and got["ok"].ts == dt.datetime(2024, 5, 1, 10)
    assert got["large"].errors == [] and got["large"].warnings == ["large amount"] and got["large"].currency == "USD"
    assert got["large"].ts == dt.datetime(2024, 1, 2) and got["large"].user_email_domain is None
    assert got["bare"].errors == ["merchant_category is required"] and got["bare"].is_first_transaction is None
    without = quality.complete_requests(df.drop("merchant_category", "ts"), now)
    assert all("merchant_category is required" in r.errors for r in without.collect())


def test_gradient_tells_a_fit_that_stopped_early(spark):
    prepared = catalog.model_input(spark, SMALL)
    largest = lambda model: max(abs(r.gradient) for r in training.logistic_gradient(model, prepared).collect())
    assert largest(training.fit_logistic(prepared)) < 1e-4 < largest(training.fit_logistic(prepared, iterations=1))


def test_first_rounds_are_a_fit_of_so_many(spark, tmp_path):
    """Cutting the trees gives what a shorter fit gives, also after storing, and the search does not fit the best again."""
    rows = spark.range(3000).selectExpr(
        "CAST(hash(id, 1) % 7 + abs(id % 13) > 6 AS int) AS is_fraud", "CAST(hash(id, 1) % 100 AS double) AS a", "CAST(id % 13 AS double) AS b", "0D AS c"
    )
    assembler = VectorAssembler(inputCols=["a", "b", "c"], outputCol="vector")

    def fit(rounds):
        trees = GBTClassifier(featuresCol="vector", labelCol="is_fraud", maxIter=rounds, subsamplingRate=0.8, seed=42)
        return Pipeline(stages=[assembler, trees]).fit(rows)

    long, short = fit(4), fit(2)
    cut = training.first_rounds(long, 2)
    cut.write().save(str(tmp_path / "model"))
    want = [r.probability for r in short.transform(rows).select("probability").collect()]
    for model in (cut, training.load_model(str(tmp_path / "model"))):
        assert [r.probability for r in model.transform(rows).select("probability").collect()] == want
        assert training.feature_importance(model, spark).collect() == training.feature_importance(short, spark).collect()
    assert training.first_rounds(long, 4) is long


@pytest.mark.parametrize("patience, rounds", [(1, 2), (2, 4), (3, 8)])
def test_blocks_of_rounds_share_a_fit(spark, monkeypatch, patience, rounds):
    """The first two blocks are one fit, and the best round is the one that block after block would find."""
    monkeypatch.setattr(training, "TREE_BLOCK", 2)
    fits, losses = [], [0.5, 0.6, 0.4, 0.7, 0.7, 0.3, 0.2, 0.7]

    class Model:
        def __init__(self, n):
            self.n = n
            self.stages = [self]

        def evaluateEachIteration(self, _):
            return losses[: self.n]

    def fit(pipeline, _):
        fits.append(pipeline.getStages()[-1].getMaxIter())
        return Model(fits[-1])

    monkeypatch.setattr(training.Pipeline, "fit", fit)
    monkeypatch.setattr(training, "first_rounds", lambda model, best: (model.n, best))
    rows = "id AS transaction_id", "timestamp_ntz'2024-01-01' + make_dt_interval(CAST(id AS int)) AS ts", "CAST(id % 2 AS int) AS is_fraud", "1D AS feat_x"
    made, best = training.fit_trees(spark.range(40).selectExpr(*rows, "'train' AS split"), 8, patience)
    assert fits == {2: [4], 4: [4, 8], 8: [4, 8]}[rounds] and made == fits[-1]
    done = 2
    while (want := losses.index(min(losses[:done])) + 1) + patience > done and done < 8:
        done *= 2
    assert best == want and done >= rounds


def test_model_input_is_computed_once(spark):
    """The border of the split comes from the stored rows and not from a second run of the features."""
    made = spark.sparkContext.accumulator(0)

    def day(i):
        made.add(1)
        return dt.datetime(2024, 1, 1) + dt.timedelta(days=i)

    rows = spark.range(40).selectExpr("id AS transaction_id", "1D AS amount", "CAST(id % 2 AS int) AS is_fraud", "id AS feat_x")
    prepared = training.prepare(rows.withColumn("ts", F.udf(day, "timestamp_ntz")(F.col("transaction_id").cast("int"))))
    assert prepared.groupBy("split").count().count() == 2 and prepared.columns[-1] == "split"
    assert made.value == 40
