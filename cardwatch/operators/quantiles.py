"""Exact order statistics of large columns, without gathering values in one place."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cardwatch.operators.timeline import Step, accumulate, hot_cuts
from cardwatch.sources.session import materialize

EVERYTHING = "_all"
BUCKETS = 1024


def value_counts(df: DataFrame, by: list[str], value: str, weights: dict[str, Column] | None = None) -> DataFrame:
    """Rows per (by, value), stored because rank operators read it more than once; duplicates combine before the shuffle."""
    weights = weights or {"n": F.count(F.lit(1))}
    work = df if by else df.withColumn(EVERYTHING, F.lit(0))
    keys = by or [EVERYTHING]
    counts = work.where(F.col(value).isNotNull()).groupBy(*keys, value)
    return materialize(counts.agg(*[agg.alias(name) for name, agg in weights.items()]))


def running(counts: DataFrame, by: list[str], at: str, names: list[str], frame: str = "before") -> DataFrame:
    """Running sums of ``names`` over ascending ``at`` within each group, as columns cum_<name>."""
    keys = by or [EVERYTHING]
    steps = [Step(f"cum_{n}", n, "sum", frame) for n in names]
    return accumulate(counts, keys, at, [], steps, hot_cuts(counts, keys, F.col(at)))


def totals(counts: DataFrame, by: list[str], names: list[str]) -> DataFrame:
    keys = by or [EVERYTHING]
    return counts.groupBy(*keys).agg(*[F.sum(n).alias(f"total_{n}") for n in names])


def with_totals(df: DataFrame, counts: DataFrame, by: list[str], names: list[str]) -> DataFrame:
    """Totals of each group beside its rows. Groups are named columns or the whole table, so their table is short."""
    keys = by or [EVERYTHING]
    return df.join(totals(counts, by, names), keys)


def exact_quantiles(counts: DataFrame, by: list[str], value: str, probs: list[float], weight: str = "n") -> DataFrame:
    """Quantiles with linear interpolation from a value_counts table: one row per group and probability."""
    keys = by or [EVERYTHING]
    filled = counts.where(F.col(weight) > 0)
    ranked = with_totals(running(filled, by, value, [weight]), filled, by, [weight])
    ranked = ranked.selectExpr(
        *keys, value, f"cum_{weight} AS _first", f"cum_{weight} + {weight} AS _last", f"total_{weight} - 1 AS _top"
    )
    # Few rows hold a wanted rank; plain comparisons, which compile, find them before any array is built.
    places = [f"floor({float(p)!r}D * _top)" for p in probs]
    holds = " OR ".join(f"(_first <= least({at} + 1, _top) AND {at} < _last)" for at in places)

    def wanted(p: Column) -> Column:
        place = p * F.col("_top")
        low = F.floor(place)
        high = F.least(low + 1, F.col("_top"))
        return F.struct(
            p.alias("prob"),
            (place - low).alias("part"),
            ((low >= F.col("_first")) & (low < F.col("_last"))).alias("is_low"),
            ((high >= F.col("_first")) & (high < F.col("_last"))).alias("is_high"),
        )

    grid = F.array(*[F.lit(float(p)) for p in probs])
    hits = ranked.where(holds).select(
        *keys, value, F.explode(F.filter(F.transform(grid, wanted), lambda w: w["is_low"] | w["is_high"])).alias("w")
    )
    ends = hits.groupBy(*keys, F.col("w.prob").alias("prob")).agg(
        F.max(F.when(F.col("w.is_low"), F.col(value))).alias("low"),
        F.max(F.when(F.col("w.is_high"), F.col(value))).alias("high"),
        F.max("w.part").alias("part"),
    )
    low, high, part = F.col("low"), F.col("high"), F.col("part")
    return ends.select(*keys, "prob", (low + (high - low) * part).alias("quantile"))


def row_at_rank(df: DataFrame, at: Column, tie: Column, rank: int):
    """(at, tie) of the row with ``rank`` rows before it in their order, whatever the size of the table.

    Whole numbers are found by narrowing a histogram, texts by adding to a prefix: first ``at``, then ``tie`` among
    the rows with that value. Each round reads one column and brings back at most BUCKETS counts (one per next
    character for texts); the table is never sorted.
    """
    points = df.select(at.alias("at"), tie.alias("tie")).where(F.col("at").isNotNull())
    found = {}
    for name in ("at", "tie"):
        text = isinstance(points.schema[name].dataType, T.StringType)
        place = (_text_at_rank if text else _number_at_rank)(points.select(name), name, rank)
        if place is None:
            return None
        found[name], rank = place
        points = points.where(F.col(name).eqNullSafe(F.lit(found[name])))
    return found


def _pick(counts: list, rank: int):
    """The (value, rank within it) of the ``rank``th row, from ordered (value, rows)."""
    for value, n in counts:
        if rank < n:
            return value, rank
        rank -= n
    return None


def _number_at_rank(points: DataFrame, name: str, rank: int):
    span = points.agg(F.min(name).alias("lo"), F.max(name).alias("hi"), F.count(F.lit(1)).alias("n")).first()
    if rank >= span.n:
        return None
    low, high = span.lo, span.hi
    while low is not None and low < high:
        width = (high - low) // BUCKETS + 1
        bucket = F.floor((F.col(name) - F.lit(low)) / F.lit(width)).cast("int")
        inside = points.where(F.col(name).between(low, high))
        counts = inside.groupBy(bucket.alias("b")).agg(F.count(F.lit(1)).alias("n")).orderBy("b").collect()
        b, rank = _pick(counts, rank)
        low, high = low + b * width, min(high, low + (b + 1) * width - 1)
    return low, rank


def _text_at_rank(points: DataFrame, name: str, rank: int):
    prefix = ""
    while True:
        here = F.when(F.col(name).startswith(prefix), F.substring(name, len(prefix) + 1, 1))
        counts = points.where(F.col(name).startswith(prefix)).groupBy(here.alias("c")).agg(F.count(F.lit(1)).alias("n"))
        picked = _pick(counts.orderBy("c").collect(), rank)
        if picked is None:
            return None
        step, rank = picked
        if not step:  # the rows that end here
            return prefix, rank
        prefix += step


def bucket_of(value: Column, edges: list[float]) -> Column:
    """How many of the ascending edges are <= value: a search tree of comparisons that compiles with the stage."""

    def search(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        middle = (low + high) // 2
        return F.when(value >= F.lit(edges[middle]), search(middle + 1, high)).otherwise(search(low, middle))

    return search(0, len(edges))
