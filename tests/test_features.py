"""Hand-made and random histories against direct computations in Python."""

import datetime as dt
import math
import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from cardwatch import schema as S
from cardwatch.operators import features as f
from cardwatch.sources import transactions

START = dt.datetime(2024, 3, 1)
SCHEMA = (
    "transaction_id bigint, ts timestamp_ntz, user_id string, merchant_id string, device_id string, ip_id string, "
    "country string, amount double, is_fraud int, chargeback_ts timestamp_ntz"
)
NAMES = [n for n in S.ALL_FEATURES if n in f.HISTORY_FEATURES]


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def row(i, minutes, user="u", country="US", amount=10.0, fraud=0, device="d", back=None):
    at = START + dt.timedelta(minutes=minutes)
    late = None if back is None else START + dt.timedelta(minutes=back)
    return (i, at, user, "m", device, "ip", country, amount, fraud, late)


def random_rows(n, seed, keys=3, span=2000):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        fraud = int(rng.random() < 0.2)
        minutes = rng.randrange(span) // 7 * 7
        rows.append(
            row(
                i,
                minutes,
                user=f"u{rng.randrange(keys)}",
                country=rng.choice(["US", "NG", "DE", None]),
                amount=rng.choice([5.0, 10.0, 10.0, 99.99, 600.0]),
                fraud=fraud,
                device=f"d{rng.randrange(2)}",
                back=minutes + rng.randrange(900) if fraud else None,
            )
        )
    return rows


def direct(rows):
    """The features of every row by looking at all rows."""
    fields = "id ts user merchant device ip country amount fraud back".split()
    table = [dict(zip(fields, r)) for r in rows]
    out = {}
    hour, day = dt.timedelta(hours=1), dt.timedelta(days=1)
    for r in table:
        mine = [o for o in table if o["user"] == r["user"]]
        past = sorted((o for o in mine if (o["ts"], o["id"]) < (r["ts"], r["id"])), key=lambda o: (o["ts"], o["id"]))
        device = [o for o in table if o["device"] == r["device"]]
        within = lambda rows, width: [o for o in rows if r["ts"] - width <= o["ts"] <= r["ts"]]
        before = lambda rows, width: [o for o in rows if r["ts"] - width <= o["ts"] < r["ts"]]
        day_rows = within(mine, day)
        counts = {}
        for o in past:
            counts[o["country"]] = counts.get(o["country"], 0) + 1
        entropy = -sum(k / len(past) * math.log2(k / len(past)) for k in counts.values()) if past else 0
        last_country = next((o["country"] for o in reversed(past) if o["country"] is not None), None)
        out[r["id"]] = {
            "feat_tx_count_user_1h": len(within(mine, hour)) - 1,
            "feat_tx_count_user_24h": len(day_rows) - 1,
            "feat_amount_sum_user_24h": round(sum(o["amount"] for o in day_rows) - r["amount"], 2),
            "feat_amount_avg_user_24h": sum(o["amount"] for o in day_rows) / len(day_rows),
            "feat_time_since_last_tx_mins": (r["ts"] - past[-1]["ts"]).total_seconds() / 60 if past else 999999.0,
            "feat_unique_users_per_device_24h": len({o["user"] for o in before(device, day)}),
            "feat_unique_countries_per_device_7d": len(
                {o["country"] for o in before(device, 7 * day)} - {None}
            ),
            "feat_unique_countries_user_7d": len({o["country"] for o in before(mine, 7 * day)} - {None}),
            "feat_user_country_entropy": entropy,
            "feat_user_fraud_rate_historical": sum(o["fraud"] for o in past) / len(past) if past else 0.0,
            "feat_device_age_days": (r["ts"] - min(o["ts"] for o in device)).total_seconds() / 86400,
            "feat_country_change": int(None not in (r["country"], last_country) and r["country"] != last_country),
        }
        known = sum(1 for o in mine if o["fraud"] and o["back"] < r["ts"])
        out[r["id"]]["user_fraud_rate_label_aware"] = known / len(past) if past else 0.0
    return out


def check(spark, rows):
    expected = direct(rows)
    names = list(next(iter(expected.values())))
    got = f.add_history(frame(spark, rows), names).collect()
    assert len(got) == len(rows)
    for r in got:
        for name, value in expected[r.transaction_id].items():
            assert r[name] == pytest.approx(value, abs=1e-9), (name, r)


@pytest.mark.parametrize("seed", [1, 2])
def test_random_history_with_ties_and_nulls(spark, seed):
    check(spark, random_rows(200, seed))


@pytest.mark.parametrize("seed", [3, 4])
def test_random_history_in_slices(sliced, seed):
    check(sliced, random_rows(200, seed))


def test_one_key_holds_all_rows(sliced):
    check(sliced, random_rows(200, 5, keys=1))


def test_all_rows_at_one_time(sliced):
    check(sliced, [row(i, 0, country="US" if i % 2 else "DE") for i in range(100)])


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 3000), st.sampled_from(["US", "NG", None])), min_size=1, max_size=25))
def test_any_history(spark, items):
    check(spark, [row(i, minutes, country=country) for i, (minutes, country) in enumerate(items)])


def test_window_border_is_closed(spark):
    rows = [row(1, 0), row(2, 60), row(3, 121)]
    got = {r.transaction_id: r for r in f.add_history(frame(spark, rows), ["feat_tx_count_user_1h"]).collect()}
    assert [got[i].feat_tx_count_user_1h for i in (1, 2, 3)] == [0, 1, 0]
    half_open = f.add_history(frame(spark, rows), ["tx_count_user_1h_inclusive"]).collect()
    assert sorted((r.transaction_id, r.tx_count_user_1h_inclusive) for r in half_open) == [(1, 1), (2, 1), (3, 1)]


def test_no_leakage_from_later_rows(spark):
    rows = random_rows(150, 9)
    cut = START + dt.timedelta(minutes=1000)
    names = [*NAMES, "user_fraud_rate_label_aware"]
    full = {r.transaction_id: r for r in f.add_history(frame(spark, rows), names).collect()}
    early = [r for r in rows if r[1] <= cut]
    for r in f.add_history(frame(spark, early), names).collect():
        assert [r[n] for n in names] == pytest.approx([full[r.transaction_id][n] for n in names], abs=1e-9)


def test_past_percentile(spark):
    rows = random_rows(150, 11)
    got = {r.transaction_id: r.feat_amount_percentile_user for r in f.add_past_percentile(frame(spark, rows)).collect()}
    for r in rows:
        past = [o[7] for o in rows if o[2] == r[2] and (o[1], o[0]) < (r[1], r[0])]
        smaller, same = sum(a < r[7] for a in past), sum(a == r[7] for a in past)
        expected = (smaller + (same + 2) / 2) / (len(past) + 1) if past else 0.5
        assert got[r[0]] == pytest.approx(expected)


def test_single_row_user_has_no_deviation(spark):
    rows = [row(1, 0, user="a", amount=5.0), row(2, 1, user="b"), row(3, 2, user="b", amount=30.0)]
    out = f.add_full_table_zscore(frame(spark, rows), "user_id", "z").collect()
    got = {r.transaction_id: r.z for r in out}
    assert got[1] is None and got[3] == pytest.approx(10 / (math.sqrt(200) + 1))


def test_null_key_is_a_key(spark):
    rows = [row(1, 0, user=None), row(2, 1, user=None)]
    got = sorted(f.add_history(frame(spark, rows), ["feat_tx_count_user_1h"]).collect(), key=lambda r: r.transaction_id)
    assert [r.feat_tx_count_user_1h for r in got] == [0, 1]


def test_history_expires(spark):
    rows = [row(1, 0), row(2, 60), row(3, 60 + 7 * 1440 + 1)]
    got = {r.transaction_id: r for r in f.latest_history(frame(spark, rows), "user_id", ["country"]).collect()}
    assert got[1].last_country is None and got[2].last_country == "US" and got[3].last_country is None


def test_time_zone_does_not_matter(spark):
    rows = random_rows(40, 12)
    names = ["feat_tx_count_user_1h", "feat_time_since_last_tx_mins"]
    before = sorted((r.transaction_id, r[-2], r[-1]) for r in f.add_history(frame(spark, rows), names).collect())
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        assert sorted((r.transaction_id, r[-2], r[-1]) for r in f.add_history(frame(spark, rows), names).collect()) == before
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


EDGE = "transaction_id bigint, ts timestamp_ntz, user_id bigint, merchant_id bigint, device_id bigint, ip_id bigint, country string, amount double, is_fraud int"


def edge_frame(spark, rows):
    start = dt.datetime(2024, 1, 1)
    full = [
        (i, start + dt.timedelta(minutes=i), r.get("user", 1), 1, r.get("device", 1), 1, "US", r.get("amount", 5.0), 0)
        for i, r in enumerate(rows)
    ]
    return spark.createDataFrame(full, EDGE)


def test_null_devices_are_no_entity(spark):
    df = edge_frame(spark, [{"user": u, "device": None} for u in range(4)] + [{"user": u, "device": 9} for u in range(3)])
    got = f.history_features(df, ["feat_unique_users_per_device_24h"]).orderBy("transaction_id").collect()
    assert [r[1] for r in got] == [0, 0, 0, 0, 0, 1, 2]


def test_nan_amount_does_not_end_the_job(spark):
    df = edge_frame(spark, [{"amount": 5.0}, {"amount": float("nan")}, {"amount": float("inf")}, {"amount": 7.0}])
    out = f.all_features(df).orderBy("transaction_id").collect()
    assert out[3].feat_amount_sum_user_24h == 5.0 and out[3].feat_tx_count_user_24h == 3


def test_deviation_of_large_amounts(spark):
    amounts = [5e6, 5e6 + 0.01, 5e6, 5e6 + 0.01, 5e6]
    got = f.history_features(edge_frame(spark, [{"amount": a} for a in amounts]), ["feat_amount_vs_user_avg"])
    last = got.orderBy("transaction_id").collect()[-1][1]
    exact = -0.005 / ((4 * 0.005**2 / 3) ** 0.5 + 1)
    assert last == pytest.approx(exact, abs=1e-9)


def ranked(rows):
    """Ranks among earlier rows of the user, row by row; rows are (id, user, hour, amount)."""
    out = []
    for i, (_, user, at, amount) in enumerate(rows):
        if amount is None:
            out.append(None)
            continue
        past = [r for j, r in enumerate(rows) if r[1] == user and r[3] is not None and ((r[2], r[0], j) < (at, rows[i][0], i))]
        below, same = sum(r[3] < amount for r in past), sum(r[3] == amount for r in past)
        out.append(0.5 if not past else (below + (same + 2) / 2) / (len(past) + 1))
    return out


@pytest.mark.parametrize("slice_rows", [None, 40])
def test_past_percentile_of_any_amounts(spark, slice_rows):
    """Outliers, equal amounts, missing ones, a hot user with one amount in most rows, rows without a user."""


    rng = random.Random(2)
    amounts = [1e12, -3.0, 0.0, 0.01, None, 5.0, 5.0, 5.0, 7.25]
    rows = [(i, rng.choice([1, 1, 1, 1, 2, None]), i // 2, rng.choice(amounts) if i % 5 else float(rng.randrange(300))) for i in range(600)]
    start = dt.datetime(2024, 1, 1)
    given = [(i, u, start + dt.timedelta(hours=h), a) for i, u, h, a in rows]
    df = spark.createDataFrame(given, "transaction_id long, user_id long, ts timestamp_ntz, amount double")
    if slice_rows:
        spark.conf.set("spark.cardwatch.sliceRows", str(slice_rows))
    try:
        got = {r.transaction_id: r.feat_amount_percentile_user for r in f.add_past_percentile(df).collect()}
    finally:
        spark.conf.unset("spark.cardwatch.sliceRows")
    want = dict(zip([r[0] for r in rows], ranked(rows)))
    assert len(got) == 600 and all(got[i] is None if w is None else abs(got[i] - w) < 1e-12 for i, w in want.items())


def test_past_percentile_has_one_shuffle_and_no_join(spark):
    tx = transactions.event_transactions(spark, "/root/testdata/sf0.001")
    tree = f.add_past_percentile(tx)._jdf.queryExecution().executedPlan().toString()
    assert tree.count("Exchange hashpartitioning") == 1 and "Join" not in tree


def test_replayed_ids_keep_their_own_ranks(spark):
    start = dt.datetime(2024, 1, 1)
    rows = [(1, 1, start, 10.0), (2, 1, start + dt.timedelta(hours=1), 20.0), (2, 1, start + dt.timedelta(hours=2), 5.0)]
    df = spark.createDataFrame(rows, "transaction_id long, user_id long, ts timestamp_ntz, amount double")
    got = sorted((r.ts.hour, r.feat_amount_percentile_user) for r in f.add_past_percentile(df).collect())
    assert got == [(0, 0.5), (1, 1.0), (2, pytest.approx(1 / 3))]
