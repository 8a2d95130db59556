"""Ordered history per key, with hot keys cut into time slices.

A plain ``Window.partitionBy(key).orderBy(time)`` puts a whole key into one task, and a sliding RANGE frame visits every
row of the frame again for every row. Here

* a sliding sum is a running sum: each row adds its value at its own time and takes it away when it leaves the window,
  so the work per row does not depend on how many rows the window holds;
* a key with too many rows is cut at quantiles of its own times. Each slice is summed on its own, and a table with one
  row per slice carries the totals of the earlier slices over.

Results do not depend on where the cuts fall; a table below the slice size has none and needs one shuffle per key.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

SLICE_ROWS_CONF = "spark.cardwatch.sliceRows"
DEFAULT_SLICE_ROWS = 5_000_000
CUT_POINTS = 16384
ACCURACY = 50_000
FAN = 64
SLICE = "_slice"


@dataclass(frozen=True)
class Step:
    """One value carried along the history of a key; ``value`` is a SQL expression.

    kind: sum, min, last (latest non-null value) or next (value of the following row).
    frame: before = earlier rows in (time, tie) order; earlier = rows at a smaller time; upto = these and all peers.
    """

    name: str
    value: str
    kind: str = "sum"
    frame: str = "before"


@dataclass(frozen=True)
class Track:
    """A value of the result of :func:`replay`.

    ``here`` is contributed at the row's own time, each (label, time, value) of ``later`` at another time; equal labels
    mean equal times. All are SQL expressions. ``pre`` is a (column, step) to run first per (key, column); ``here`` and
    ``later`` may read it.
    """

    name: str
    here: str | None = None
    later: tuple = ()
    kind: str = "sum"
    frame: str = "before"
    pre: tuple | None = None


@dataclass(frozen=True)
class Cuts:
    """Slice borders of the hot keys, fewer than twice the number of slices of the table. ``total`` counts the table."""

    table: DataFrame
    total: int


def slice_rows(spark: SparkSession) -> int:
    return int(spark.conf.get(SLICE_ROWS_CONF, str(DEFAULT_SLICE_ROWS)))


def _null_safe(left: DataFrame, right: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """Broadcast join on keys where null equals null; the right side is bounded by the number of slices."""
    renamed = right.withColumnsRenamed({k: f"_r_{k}" for k in keys})
    condition = None
    for key in keys:
        match = left[key].eqNullSafe(renamed[f"_r_{key}"])
        condition = match if condition is None else condition & match
    return left.join(F.broadcast(renamed), condition, how).drop(*[f"_r_{k}" for k in keys])


def hot_cuts(df: DataFrame, keys: list[str], at: Column, total: int | None = None) -> Cuts | None:
    """Find keys with more rows than one slice should hold, and cut points of ``at`` for each of them.

    The table comes from statistics, so it only steers balance. The slice size does not grow with the table: a hot key
    holds more than one slice of rows, so there are fewer hot keys than slices and fewer than twice as many cuts (at
    10^12 rows and the default size, 400,000 numbers).
    ``total`` is the row count where the caller knows it; a plain Parquet scan answers it from file footers.
    """
    limit = slice_rows(df.sparkSession)
    total = df.count() if total is None else total
    if total <= limit:
        return None
    size = limit
    points = df.select(*keys, at.alias("_at"))
    hot = points.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > size)
    # No key needs more slices than the whole table would.
    fine = min(CUT_POINTS, 4 * -(-total // size))
    grid = ", ".join(f"{i / fine}D" for i in range(1, fine))
    slices = F.least(F.lit(fine), F.ceil(F.col("_n") / F.lit(size)).cast("int"))
    thin = F.transform(
        F.sequence(F.lit(1), slices - 1),
        lambda i: F.get(F.col("_points"), F.floor(i * F.lit(fine) / slices).cast("int") - 1),
    )
    rows = (
        _null_safe(points, hot, keys, "inner")
        .groupBy(*keys, "_n")
        .agg(F.expr(f"percentile_approx(_at, array({grid}), {ACCURACY})").alias("_points"))
        .select(*keys, F.array_sort(F.array_distinct(thin)).alias("_cuts"))
        .collect()
    )
    if not rows:
        return None
    nested = [tuple(r[k] for k in keys) + ([r._cuts[i : i + FAN] for i in range(0, len(r._cuts), FAN)],) for r in rows]
    at_type = points.schema["_at"].dataType
    shape = T.StructType(
        [T.StructField(k, points.schema[k].dataType) for k in keys]
        + [T.StructField("_cuts", T.ArrayType(T.ArrayType(at_type)))]
    )
    return Cuts(df.sparkSession.createDataFrame(nested, shape), total)


def add_slice(df: DataFrame, keys: list[str], at: Column, cuts: Cuts) -> DataFrame:
    """Number of cuts below ``at`` for rows of hot keys, -1 for all others. Equal times share a slice."""
    joined = _null_safe(df, cuts.table, keys)
    table = F.col("_cuts")
    chunk = F.size(F.filter(table, lambda c: F.get(c, F.lit(0)) < at))
    inside = F.size(F.filter(F.get(table, chunk - 1), lambda c: c < at))
    position = F.when(chunk == 0, F.lit(0)).otherwise((chunk - 1) * FAN + inside)
    return joined.withColumn(SLICE, F.when(table.isNull(), F.lit(-1)).otherwise(position)).drop("_cuts")


def _windowed(
    df: DataFrame, keys: list[str], at: str, tie: list[str], steps: list[Step], zero: bool = True
) -> DataFrame:
    rows = f"PARTITION BY {', '.join(keys)} ORDER BY {', '.join([at, *tie])}"
    times = f"PARTITION BY {', '.join(keys)} ORDER BY {at}"
    frames = {
        "before": f"({rows} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)",
        "earlier": f"({times} RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)",
        "upto": f"({times} RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)",
    }
    by_row, by_time = [], []
    for step in steps:
        frame = frames[step.frame]
        if step.kind == "next":
            sql = f"lead({step.value}) OVER ({rows})"
        elif step.kind == "last":
            sql = f"last({step.value}, true) OVER {frames['before']}"
        else:
            sql = f"{step.kind}({step.value}) OVER {frame}"
        if step.kind == "sum" and zero:
            sql = f"coalesce({sql}, 0)"
        exact = step.kind in ("next", "last") or step.frame == "before"
        (by_row if exact else by_time).append(f"{sql} AS {step.name}")
    # Sorted by (time, tie) first, the rows need no second sort for the frames by time.
    out = df.selectExpr("*", *by_row) if by_row else df
    return out.selectExpr("*", *by_time) if by_time else out


def accumulate(
    df: DataFrame,
    keys: list[str],
    at: str,
    tie: list[str],
    steps: list[Step],
    cuts: Cuts | None = None,
    source: DataFrame | None = None,
) -> DataFrame:
    """Add one column per step. ``at`` must be a whole number where a frame is ``earlier``.

    ``source`` may name a cheaper frame with the same rows to take the totals of the slices from.
    """
    if cuts is None:
        return _windowed(df, keys, at, tie, steps)

    sliced = add_slice(df, keys, F.col(at), cuts)
    counted = sliced if source is None else add_slice(source, keys, F.col(at), cuts)
    order = F.struct(F.col(at), *[F.col(t) for t in tie])
    parts = []
    for step in steps:
        value = F.expr(step.value)
        agg = {
            "sum": F.sum(value),
            "min": F.min(value),
            "last": F.max_by(value, F.when(value.isNotNull(), order)),
            "next": F.min_by(value, order),
        }[step.kind]
        parts.append(agg.alias(f"_p_{step.name}"))
    totals = counted.where(F.col(SLICE) >= 0).groupBy(*keys, SLICE).agg(*parts)
    past = Window.partitionBy(*keys).orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)
    future = Window.partitionBy(*keys).orderBy(SLICE)
    carried = []
    for step in steps:
        part = F.col(f"_p_{step.name}")
        over = {
            "sum": F.sum(part).over(past),
            "min": F.min(part).over(past),
            "last": F.last(part, ignorenulls=True).over(past),
            "next": F.lead(part).over(future),
        }[step.kind]
        carried.append(over.alias(f"_c_{step.name}"))
    carry = totals.select(*keys, SLICE, *carried)

    local = _windowed(sliced, [*keys, SLICE], at, tie, steps, zero=False)
    merged = _null_safe(local, carry, [*keys, SLICE])
    combined = {}
    for step in steps:
        mine, other = F.col(step.name), F.col(f"_c_{step.name}")
        if step.kind == "min":
            combined[step.name] = F.least(mine, other)
        elif step.kind in ("last", "next"):
            combined[step.name] = F.coalesce(mine, other)
        else:
            combined[step.name] = F.coalesce(mine + other, mine, other, F.lit(0))
    return merged.withColumns(combined).drop(SLICE, *[f"_c_{s.name}" for s in steps])


def _typed_null(value: str) -> str:
    return f"CASE WHEN false THEN {value} END"


def _events(work: DataFrame, keys: list[str], at: str, tie: str, tracks: list[Track], columns: list[str]) -> DataFrame:
    """Every row at its own time, with ``columns`` as its payload, and its contributions at other times without one."""
    nulls = {t.name: _typed_null(t.here or t.later[0][2]) for t in tracks}

    def entry(when: str, tied: str, row: str, filled: dict[str, str]) -> str:
        values = "".join(f", '_v_{name}', {filled.get(name, null)}" for name, null in nulls.items())
        return f"named_struct('_at', {when}, '_tie', {tied}, '_row', {row}{values})"

    row = f"struct({', '.join(columns)})"
    entries = [entry(at, tie, row, {t.name: t.here for t in tracks if t.here is not None})]
    moments: dict[str, tuple[str, dict]] = {}
    for track in tracks:
        for label, when, value in track.later:
            moments.setdefault(label, (when, {}))[1][track.name] = value
    for when, filled in moments.values():
        entries.append(entry(when, _typed_null(tie), _typed_null(row), filled))
    flat = work.selectExpr(*keys, f"inline(array({', '.join(entries)}))")
    return flat.where("_row IS NOT NULL OR _at IS NOT NULL")


def replay(
    df: DataFrame,
    keys: list[str],
    at: str,
    tie: str,
    tracks: list[Track],
    cuts: Cuts | None = None,
    source: DataFrame | None = None,
) -> DataFrame:
    """Run all tracks of one key over the table in time order; every row comes back once, with a column per track.

    Where ``df`` carries results of earlier replays, ``source`` is the table before them: statistics and slice totals
    are taken from it, so that they do not run the earlier replays again.
    """
    tracks = list({t.name: t for t in tracks}.values())
    steps = [Step(t.name, f"_v_{t.name}", t.kind, t.frame) for t in tracks]
    pre = {t.pre[1].name: t.pre for t in tracks if t.pre}.values()
    base = df if source is None else source
    work = df if cuts is not None else df.repartition(*keys)
    for extra, step in pre:
        pair = [*keys, extra]
        pair_cuts = None if cuts is None else hot_cuts(base, pair, F.col(at), cuts.total)
        work = accumulate(work, pair, at, [tie], [step], pair_cuts, source)
        if cuts is not None and source is not None:
            base = accumulate(base, pair, at, [tie], [step], pair_cuts)
    flat = _events(work, keys, at, tie, tracks, df.columns)
    counted = None if cuts is None or source is None else _events(base, keys, at, tie, tracks, [tie])
    out = accumulate(flat, keys, "_at", ["_tie"], steps, cuts, counted)
    return out.where("_row IS NOT NULL").selectExpr("_row.*", *[t.name for t in tracks])


def sliding_sum(name: str, at: str, value: str, width: int) -> Track:
    """Sum of ``value`` over the closed window [at - width, at], peers included."""
    return Track(name, here=value, later=((f"after {width}", f"{at} + {width + 1}", f"-({value})"),), frame="upto")


def sliding_distinct(name: str, at: str, column: str, width: int, key: str) -> Track:
    """Number of different values of ``column`` in [at - width, at), without keeping the values.

    Rows without a ``key`` belong to no entity: they count nothing and see nothing.
    A row counts until the same value shows up again or the window has passed, whichever comes first.
    """
    following = f"_next_{name}"
    latest = f"{key} IS NOT NULL AND {column} IS NOT NULL AND ({following} IS NULL OR {following} > {at})"
    end = f"CASE WHEN {latest} THEN least({following}, {at} + {width}) END"
    return Track(
        name,
        here=f"CASE WHEN {latest} THEN 1 END",
        later=((name, end, f"CASE WHEN {latest} THEN -1 END"),),
        frame="earlier",
        pre=(column, Step(following, at, "next")),
    )
