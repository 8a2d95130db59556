"""The behavioural features, declared once and computed with one shuffle per entity key."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cardwatch import schema as S
from cardwatch.functions.expressions import (
    DAY_US,
    HOUR_US,
    cents,
    cyclic,
    epoch_micros,
    flag,
    is_high_risk_country,
)
from cardwatch.operators import ranks
from cardwatch.operators.timeline import (
    SLICE,
    Step,
    Track,
    accumulate,
    add_slice,
    hot_cuts,
    replay,
    sliding_distinct,
    sliding_sum,
)
from cardwatch.sources.session import materialize

TIE = "transaction_id"
US = "_us"
CENTS = "TRY_CAST(round(amount * 100) AS BIGINT)"


@dataclass(frozen=True)
class Feature:
    """A feature read off the history of one key: the tracks it needs and a SQL expression over them."""

    key: str
    tracks: list[Track]
    value: str


def _past_count(key: str) -> Track:
    return Track(f"_{key}_past", here="1")


def _past_fraud(key: str) -> Track:
    return Track(f"_{key}_fraud", here="is_fraud")


def _window_count(key: str, hours: int) -> Track:
    return sliding_sum(f"_{key}_count_{hours}h", US, "1", hours * HOUR_US)


def _window_cents(key: str, hours: int) -> Track:
    return sliding_sum(f"_{key}_cents_{hours}h", US, CENTS, hours * HOUR_US)


def _open_count(key: str, hours: int) -> Track:
    """Rows in (at - width, at], the row itself and its peers included."""
    width = hours * HOUR_US
    later = ((f"open {width}", f"{US} + {width}", "-1"),)
    return Track(f"_{key}_open_{hours}h", here="1", later=later, frame="upto")


def _previous(key: str, column: str) -> Track:
    return Track(f"_{key}_prev_{column}", here=column, kind="last")


def _first_time(key: str) -> Track:
    return Track(f"_{key}_first_us", here=US, kind="min", frame="upto")


def _distinct(key: str, column: str, width: int) -> Track:
    return sliding_distinct(f"_{key}_{column}_{width // HOUR_US}h", US, column, width, f"{key}_id")


def _moments(key: str) -> list[Track]:
    return [
        Track(f"_{key}_past", here="1"),
        Track(f"_{key}_sum", here=CENTS),
        Track(f"_{key}_squares", here=f"CAST({CENTS} AS DECIMAL(19, 0)) * CAST({CENTS} AS DECIMAL(18, 0))"),
    ]


def _known_fraud(key: str) -> Track:
    """Frauds of the key whose chargeback has arrived; each enters at its chargeback time, not at its own."""
    arrival = ("chargeback", "_chargeback_us", "CASE WHEN is_fraud = 1 THEN 1 END")
    return Track(f"_{key}_known", later=(arrival,), frame="earlier")


def _entropy_gain(by: str) -> Track:
    """Change of sum(k*log2 k) over the values seen so far when the row's value is counted once more."""
    seen = f"_seen_{by}"
    gain = f"({seen} + 1D) * log2({seen} + 1D) - CASE WHEN {seen} > 0 THEN {seen} * log2({seen}) ELSE 0D END"
    return Track(f"_gain_{by}", here=gain, pre=(by, Step(seen, "1")))


def _entropy(key: str, by: str) -> str:
    n = f"CAST(_{key}_past AS DOUBLE)"
    return f"CASE WHEN _{key}_past > 0 THEN log2({n}) - _gain_{by} / {n} ELSE 0D END"


def _minutes_since(key: str, otherwise: float) -> str:
    return f"coalesce(({US} - _{key}_prev_{US}) / 60e6D, {otherwise}D)"


def _days_since_first(key: str) -> str:
    return f"({US} - _{key}_first_us) / 86400e6D"


def _rate(top: str, bottom: str) -> str:
    return f"CASE WHEN {bottom} > 0 THEN CAST({top} AS DOUBLE) / ({bottom}) ELSE 0D END"


def _past_rate(key: str, extra: int = 0) -> str:
    return _rate(f"_{key}_fraud", f"_{key}_past + {extra}")


def _past_zscore(key: str) -> str:
    """(amount - past mean) / (past sample deviation + 1), 0 with fewer than two past rows.

    The sums are whole numbers of cents and of cents squared, so that no digits cancel before the only division.
    """
    n, total, squares = (f"_{key}_{part}" for part in ("past", "sum", "squares"))
    whole = f"CAST({total} AS DECIMAL(19, 0))"
    top = f"CAST(CAST({n} AS DECIMAL(18, 0)) * {squares} - {whole} * CAST({total} AS DECIMAL(18, 0)) AS DOUBLE)"
    variance = f"greatest({top} / {n} / ({n} - 1) / 10000D, 0D)"
    mean = f"{total} / 100D / {n}"
    return f"CASE WHEN {n} >= 2 THEN (amount - {mean}) / (sqrt({variance}) + 1) ELSE 0D END"


_ENTITIES = {"user": "user_id", "merchant": "merchant_id", "device": "device_id"}

HISTORY_FEATURES: dict[str, Feature] = {
    "feat_tx_count_user_1h": Feature("user_id", [_window_count("user", 1)], "_user_count_1h - 1"),
    "feat_tx_count_user_24h": Feature("user_id", [_window_count("user", 24)], "_user_count_24h - 1"),
    "feat_amount_sum_user_24h": Feature(
        "user_id", [_window_cents("user", 24)], f"(_user_cents_24h - coalesce({CENTS}, 0)) / 100D"
    ),
    "feat_amount_avg_user_24h": Feature(
        "user_id",
        [_window_cents("user", 24), _window_count("user", 24)],
        "_user_cents_24h / 100D / _user_count_24h",
    ),
    "feat_time_since_last_tx_mins": Feature(
        "user_id", [_previous("user", US)], _minutes_since("user", S.NO_PREVIOUS_TX_MINUTES)
    ),
    "feat_tx_count_merchant_1h": Feature("merchant_id", [_window_count("merchant", 1)], "_merchant_count_1h - 1"),
    "feat_unique_users_per_device_24h": Feature(
        "device_id", [_distinct("device", "user_id", DAY_US)], "_device_user_id_24h"
    ),
    "feat_unique_countries_per_device_7d": Feature(
        "device_id", [_distinct("device", "country", 7 * DAY_US)], "_device_country_168h"
    ),
    "feat_unique_countries_per_device_24h": Feature(
        "device_id", [_distinct("device", "country", DAY_US)], "_device_country_24h"
    ),
    "feat_unique_users_per_ip_24h": Feature("ip_id", [_distinct("ip", "user_id", DAY_US)], "_ip_user_id_24h"),
    "feat_device_age_days": Feature("device_id", [_first_time("device")], _days_since_first("device")),
    "feat_ip_age_days": Feature("ip_id", [_first_time("ip")], _days_since_first("ip")),
    "feat_country_change": Feature(
        "user_id", [_previous("user", "country")], "CASE WHEN country != _user_prev_country THEN 1 ELSE 0 END"
    ),
    "feat_unique_countries_user_7d": Feature(
        "user_id", [_distinct("user", "country", 7 * DAY_US)], "_user_country_168h"
    ),
    "feat_user_country_entropy": Feature(
        "user_id", [_past_count("user"), _entropy_gain("country")], _entropy("user", "country")
    ),
    **{
        f"feat_{name}_fraud_rate_historical": Feature(key, [_past_count(name), _past_fraud(name)], _past_rate(name))
        for name, key in _ENTITIES.items()
    },
    "feat_amount_vs_user_avg": Feature("user_id", _moments("user"), _past_zscore("user")),
    "feat_amount_vs_merchant_avg": Feature("merchant_id", _moments("merchant"), _past_zscore("merchant")),
    # Variants and base-table columns.
    "tx_count_user_1h_inclusive": Feature("user_id", [_open_count("user", 1)], "_user_open_1h"),
    "tx_count_user_24h_inclusive": Feature("user_id", [_open_count("user", 24)], "_user_open_24h"),
    "tx_count_merchant_1h_inclusive": Feature("merchant_id", [_open_count("merchant", 1)], "_merchant_open_1h"),
    "country_change_first_is_change": Feature(
        "user_id", [_previous("user", "country")], "CASE WHEN country <=> _user_prev_country THEN 0 ELSE 1 END"
    ),
    **{
        f"{name}_fraud_rate_smoothed": Feature(key, [_past_count(name), _past_fraud(name)], _past_rate(name, 1))
        for name, key in _ENTITIES.items()
    },
    **{
        f"{name}_fraud_rate_label_aware": Feature(
            key, [_past_count(name), _known_fraud(name)], _rate(f"_{name}_known", f"_{name}_past")
        )
        for name, key in _ENTITIES.items()
    },
    "user_transaction_count": Feature("user_id", [_past_count("user")], "_user_past + 1"),
    "time_since_last_transaction": Feature("user_id", [_previous("user", US)], _minutes_since("user", 0.0)),
}


ROW_FEATURES: dict[str, Callable[[DataFrame], Column]] = {
    "feat_is_high_risk_country": lambda df: is_high_risk_country(F.col("country")),
    "feat_is_small_amount": lambda df: flag(F.col("amount") < S.SMALL_AMOUNT),
    "feat_is_large_amount": lambda df: flag(F.col("amount") > S.LARGE_AMOUNT),
    "feat_hour": lambda df: F.hour("ts"),
    "feat_day_of_week": lambda df: F.weekday("ts"),
    "feat_is_weekend": lambda df: flag(F.weekday("ts").isin(5, 6)),
    "feat_is_night": lambda df: flag(F.hour("ts").between(0, 5)),
    "feat_hour_sin": lambda df: cyclic(F.hour("ts"), 24)[0],
    "feat_hour_cos": lambda df: cyclic(F.hour("ts"), 24)[1],
    "feat_day_sin": lambda df: cyclic(F.weekday("ts"), 7)[0],
    "feat_day_cos": lambda df: cyclic(F.weekday("ts"), 7)[1],
}


def add_history(df: DataFrame, names: list[str], source: DataFrame | None = None) -> DataFrame:
    """Add point-in-time features; features of the same key share its shuffle, sort and windows.

    ``source`` may name a cheaper frame with the same rows; row counts and the slices of hot keys are taken from it.
    """
    columns = df.columns
    by_key: dict[str, list[str]] = {}
    for name in names:
        by_key.setdefault(HISTORY_FEATURES[name].key, []).append(name)
    kept = [*columns, US]
    source = df if source is None else source
    aware = any(name.endswith("label_aware") for name in names)

    def timed(frame: DataFrame) -> DataFrame:
        out = frame.withColumn(US, epoch_micros(frame, "ts"))
        return out.withColumn("_chargeback_us", epoch_micros(frame, "chargeback_ts")) if aware else out

    work, base = timed(df), timed(source)
    if aware:
        kept.append("_chargeback_us")
    total = source.count()
    cuts = {key: hot_cuts(base, [key], F.col(US), total) for key in by_key}
    for key, wanted in by_key.items():
        tracks = [t for name in wanted for t in HISTORY_FEATURES[name].tracks]
        work = replay(work, [key], US, TIE, tracks, cuts[key], base)
        work = work.selectExpr(*kept, *[f"{HISTORY_FEATURES[n].value} AS {n}" for n in wanted])
        kept += wanted
    return work.select(*columns, *names)


INPUTS = "transaction_id ts user_id merchant_id device_id ip_id country amount is_fraud chargeback_ts".split()


def input_columns(names: list[str]) -> list[str]:
    """Columns of the transaction table that the named history features read."""
    used = {TIE, "ts"}
    for name in names:
        feature = HISTORY_FEATURES[name]
        parts = [feature.key, feature.value]
        for track in feature.tracks:
            parts += [track.here or "", *[part for moment in track.later for part in moment[1:]]]
            parts += [track.pre[0], track.pre[1].value] if track.pre else []
        text = " ".join(parts)
        used |= {c for c in INPUTS if re.search(rf"(?<!\w)_?{c.removesuffix('_ts')}(_us|_ts)?(?!\w)", text)}
    return [c for c in INPUTS if c in used]


def history_features(df: DataFrame, names: list[str]) -> DataFrame:
    """Only the id and the named features, so that the scan reads no other columns."""
    return add_history(df.select(*input_columns(names)), names).select(TIE, *names)


def add_row_features(df: DataFrame, names: list[str]) -> DataFrame:
    return df.withColumns({name: ROW_FEATURES[name](df) for name in names})


def amount_stats(df: DataFrame, key: str) -> DataFrame:
    """Mean and sample deviation of the amount per key; a key with one row has no deviation."""
    return df.groupBy(key).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg("amount").alias("mean_amount"),
        F.stddev_samp("amount").alias("std_amount"),
    )


def add_full_table_zscore(df: DataFrame, key: str, name: str) -> DataFrame:
    """(amount - mean) / (deviation + 1) with the statistics of the whole table.

    Statistics are aggregated before they are joined back; the join side is chosen by measured size and a hot key of
    the large side is split by adaptive execution.
    """
    stats = amount_stats(df, key).select(F.col(key).alias("_key"), "mean_amount", "std_amount")
    joined = df.join(stats, df[key].eqNullSafe(stats["_key"]), "left")
    value = (F.col("amount") - F.col("mean_amount")) / (F.col("std_amount") + 1)
    return joined.withColumn(name, value).select(*df.columns, name)


def add_full_table_percentile(
    df: DataFrame,
    key: str = "user_id",
    name: str = "feat_amount_percentile_user",
    source: DataFrame | None = None,
) -> DataFrame:
    """Average rank of the amount among all rows of its key, as a share of the rows.

    Equal amounts are counted once per (key, amount) first, so only distinct amounts are ordered.
    """
    source = df if source is None else source
    counts = source.where(F.col("amount").isNotNull()).groupBy(key, "amount").agg(F.count(F.lit(1)).alias("_peers"))
    counts = materialize(counts)
    sizes = counts.groupBy(key).agg(F.sum("_peers").alias("_n"))
    cuts = hot_cuts(counts, [key], F.col("amount"))
    ranked = accumulate(counts, [key], "amount", [], [Step("_below", "_peers")], cuts)
    ranked = ranked.join(sizes.withColumnRenamed(key, "_k2"), ranked[key].eqNullSafe(F.col("_k2"))).drop("_k2")
    rank = F.col("_below").cast("double") + (F.col("_peers").cast("double") + 1) / 2
    table = ranked.select(
        F.col(key).alias("_key"), F.col("amount").alias("_amount"), (rank / F.col("_n").cast("double")).alias(name)
    )
    match = df[key].eqNullSafe(table["_key"]) & (df["amount"] == table["_amount"])
    return df.join(table, match, "left").select(*df.columns, name)


def add_past_percentile(df: DataFrame, key: str = "user_id", name: str = "feat_amount_percentile_user") -> DataFrame:
    """Average rank of the amount among the rows of its key up to and including itself, as a share; the first row has 0.5.

    One shuffle brings the rows of a key, or of a slice of a hot key, together in time order; earlier smaller amounts are
    counted there for many keys at once (:mod:`cardwatch.operators.ranks`). Rows of a hot key add what the earlier slices
    hold, from counts per slice and amount. Nothing depends on how large amounts are, and rows that share an id keep
    their own ranks.
    """
    extra = ["_us", "_cents", SLICE]
    work = df.withColumns({"_us": epoch_micros(df, "ts"), "_cents": cents(F.col("amount"))})
    cuts = hot_cuts(work, [key], F.col("_us"))
    sliced = work.withColumn(SLICE, F.lit(-1)) if cuts is None else add_slice(work, [key], F.col("_us"), cuts)
    if cuts is not None:
        sliced = materialize(sliced)
    ordered = sliced.repartition(key, SLICE).sortWithinPartitions(key, SLICE, "_us", TIE)
    shape = T.StructType([*ordered.schema, *[T.StructField(c, T.LongType()) for c in ("_past", "_same", "_smaller")]])
    counted = ordered.mapInArrow(ranks.counter(key, SLICE, "_cents"), shape)
    if cuts is not None:
        earlier = _earlier_slices(sliced, key).withColumnsRenamed({key: "_key", SLICE: "_s", "_cents": "_c"})
        match = counted[key].eqNullSafe(F.col("_key")) & (F.col(SLICE) == F.col("_s")) & (F.col("_cents") == F.col("_c"))
        counted = counted.join(earlier, match, "left")
        counted = counted.withColumns({f"_{c}": F.col(f"_{c}") + F.coalesce(f"_{c}_e", F.lit(0)) for c in ("past", "same", "smaller")})
    value = F.when(F.col("_past") == 0, F.lit(0.5)).otherwise((F.col("_smaller") + (F.col("_same") + 2) / 2) / (F.col("_past") + 1.0))
    return counted.withColumn(name, value).select(*df.columns, name)


def _earlier_slices(sliced: DataFrame, key: str) -> DataFrame:
    """For every slice and amount of a hot key, the rows of earlier slices: all, those with the amount, those below it.

    Slices are the leaves of a binary tree. On each level the left child counts for the right one: a running sum over
    the amounts of both. A count per slice and amount appears once per level, and levels are the logarithm of the
    number of slices of one key.
    """
    cells = sliced.where((F.col(SLICE) >= 0) & F.col("_cents").isNotNull())
    cells = materialize(cells.groupBy(key, SLICE, "_cents").agg(F.count(F.lit(1)).alias("n")))
    levels = max(1, int(cells.agg(F.max(SLICE)).first()[0] or 0).bit_length())
    nodes = cells.select(
        key, SLICE, "_cents", "n", F.explode(F.sequence(F.lit(0), F.lit(levels - 1))).alias("_level")
    ).withColumns({"_node": F.expr(f"shiftright({SLICE}, _level + 1)"), "_right": F.expr(f"shiftright({SLICE}, _level) & 1")})
    group = [key, "_level", "_node"]
    # Per amount of a node, so that a running sum tells smaller amounts from equal ones.
    sums = {"l": F.sum(F.when(F.col("_right") == 0, F.col("n")).otherwise(0)).alias("l")}
    amounts = materialize(nodes.groupBy(*group, "_cents").agg(*sums.values()))
    below = accumulate(amounts, group, "_cents", [], [Step("_below", "l")], hot_cuts(amounts, group, F.col("_cents")))
    every = amounts.groupBy(*group).agg(F.sum("l").alias("_all"))
    names = {c: f"_g{i}" for i, c in enumerate([*group, "_cents"])}
    below, every = below.withColumnsRenamed(names), every.withColumnsRenamed({c: f"_h{i}" for i, c in enumerate(group)})
    right = nodes.where("_right = 1")

    def same(columns: list[str], prefix: str) -> Column:
        match = F.lit(True)
        for i, c in enumerate(columns):
            match &= F.col(c).eqNullSafe(F.col(f"{prefix}{i}"))
        return match

    joined = right.join(below, same([*group, "_cents"], "_g")).join(every, same(group, "_h"))
    return joined.groupBy(key, SLICE, "_cents").agg(
        F.sum("_all").alias("_past_e"), F.sum("l").alias("_same_e"), F.sum("_below").alias("_smaller_e")
    )


def past_percentile(df: DataFrame, key: str, name: str) -> DataFrame:
    """(transaction_id, name) of :func:`add_past_percentile`, which then carries no other columns through its shuffle."""
    return add_past_percentile(df.select(key, "ts", TIE, "amount"), key, name).select(TIE, name)


def latest_history(df: DataFrame, key: str, fields: list[str], ttl_days: int = 7) -> DataFrame:
    """State of an entity just before each row: the latest earlier values, null once older than the time to live."""
    work = df.withColumn("_us", epoch_micros(df, "ts"))
    state = f"named_struct('seen', {US}, " + ", ".join(f"'{f}', {f}" for f in fields) + ")"
    cuts = hot_cuts(work, [key], F.col(US), df.count())
    out = replay(work, [key], US, TIE, [Track("_state", here=state, kind="last")], cuts)
    fresh = F.col(US) - F.col("_state.seen") <= F.lit(ttl_days * DAY_US)
    values = [F.when(fresh, F.col(f"_state.{f}")).alias(f"last_{f}") for f in fields]
    age = F.when(fresh, (F.col(US) - F.col("_state.seen")) / F.lit(60e6)).alias("history_age_mins")
    return out.select(*df.columns, age, *values)


def all_features(df: DataFrame, amount: str = "past") -> DataFrame:
    """The input with all 31 features.

    amount="past" takes amount deviations and percentiles from earlier rows only; amount="full" takes them from the
    whole table, later rows included.
    """
    history = [n for n in S.ALL_FEATURES if n in HISTORY_FEATURES]
    # Joins come first, while the rows are narrow.
    if amount == "full":
        history = [n for n in history if n not in S.FEATURE_FAMILIES["amount"]]
        out = add_full_table_zscore(df, "user_id", "feat_amount_vs_user_avg")
        out = add_full_table_zscore(out, "merchant_id", "feat_amount_vs_merchant_avg")
        out = add_full_table_percentile(out, source=df)
    else:
        out = add_past_percentile(df)
    out = add_history(out, history, df)
    out = add_row_features(out, [n for n in S.ALL_FEATURES if n in ROW_FEATURES])
    return out.select(*df.columns, *S.ALL_FEATURES)
