"""Severity of toxic text by cumulative-link ordinal regression over sparse text features."""

import math
import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cardwatch.sources.session import materialize

#: The largest number of labelled rows that a model is fitted on, of features that it keeps, and the labelled rows that
#: have to hold a feature.
SAMPLE_ROWS = 8000
FEATURES = 2048
LEAST_ROWS = 3
GRADES = 4

_WORD = re.compile(r"\w+")


def features_of(word: str) -> tuple[str, ...]:
    """A word stands for itself and, if longer, for its first four letters, which inflected and joined words share."""
    return (word, word[:4] + "*") if len(word) > 4 else (word,)


@dataclass(frozen=True)
class SeverityModel:
    """P(grade > k) = 1 / (1 + exp(limits[k] - margin)): one weight per feature for all grades, one limit per grade."""

    weights: dict[str, float] = field(default_factory=dict)
    limits: tuple[float, ...] = (math.inf,) * (GRADES - 1)


def feature_counts(text: str | None, known) -> Counter:
    """How often each known feature occurs in the whole text."""
    out = Counter()
    for word, n in Counter(_WORD.findall((text or "").lower())).items():
        for f in features_of(word):
            if f in known:
                out[f] += n
    return out


def fit_ordinal(rows, columns, values, grades, n_columns, rounds=400, rate=0.1, penalty=1e-4):
    """Weights and ordered limits of the likeliest cumulative logit, by gradient steps with momentum (Adam).

    The sparse matrix is given by its entries. Limits are kept in order by stepping their logarithmic distances.
    """
    n, k = len(grades), GRADES - 1
    share = np.clip([(grades > j).mean() for j in range(k)], 1e-4, 1 - 1e-4)
    start = -np.log(share / (1 - share))
    state = np.concatenate([np.zeros(n_columns), start[:1], np.log(np.maximum(np.diff(start), 1e-2))])
    m, v = np.zeros_like(state), np.zeros_like(state)
    sigmoid = lambda x: 1 / (1 + np.exp(-np.clip(x, -40, 40)))
    for step in range(1, rounds + 1):
        w, limits = state[:n_columns], np.cumsum(np.concatenate([state[n_columns : n_columns + 1], np.exp(state[n_columns + 1 :])]))
        margin = np.bincount(rows, values * w[columns], n)
        above = np.concatenate([np.ones((n, 1)), sigmoid(margin[:, None] - limits), np.zeros((n, 1))], axis=1)
        slope = above * (1 - above)  # of P(grade > j - 1) by the margin
        at = np.arange(n)
        p = np.maximum(above[at, grades] - above[at, grades + 1], 1e-12)
        g_margin = -(slope[at, grades] - slope[at, grades + 1]) / p / n
        g_limits = np.zeros(k + 2)
        np.add.at(g_limits, grades, slope[at, grades] / p / n)
        np.add.at(g_limits, grades + 1, -slope[at, grades + 1] / p / n)
        g_limits = g_limits[1:-1]
        tail = np.cumsum(g_limits[::-1])[::-1]
        gradient = np.concatenate(
            [np.bincount(columns, values * g_margin[rows], n_columns) + penalty * w, tail[:1], tail[1:] * np.exp(state[n_columns + 1 :])]
        )
        m, v = 0.9 * m + 0.1 * gradient, 0.999 * v + 0.001 * gradient**2
        state = state - rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    limits = np.cumsum(np.concatenate([state[n_columns : n_columns + 1], np.exp(state[n_columns + 1 :])]))
    return state[:n_columns], tuple(limits.tolist())


def fit_severity(
    docs: DataFrame,
    labels: DataFrame,
    sample_rows: int = SAMPLE_ROWS,
    id_col: str = "doc_id",
    text_col: str = "text",
    features: int = FEATURES,
    least_rows: int = LEAST_ROWS,
) -> SeverityModel:
    """Fit on at most ``sample_rows`` labelled rows, taken by a hash of the id from all labelled rows.

    The model keeps the ``features`` features, held by at least ``least_rows`` of these rows, whose shares among toxic
    and other rows differ most surely. Scoring reads whole texts and all rows, whatever the size of the model.

    ``labels`` has the id and ``toxic`` (0 or 1; the largest of several, rows with null are left out). Labels know two
    grades only. Toxic rows are graded 1 to 3 by the third of the toxic rows that their number of telling features
    falls into; features are telling that toxic rows hold eight times as often as others. Without rows of both kinds
    the model finds every text to have severity 0. The sample and the chosen features are bounded; only they reach
    the driver.
    """
    chosen = (
        labels.where(F.col("toxic").isNotNull() & F.col(f"`{id_col}`").isNotNull())
        .groupBy(F.col(f"`{id_col}`").alias("id"))
        .agg((F.max("toxic") > 0).alias("toxic"))
        .orderBy(F.xxhash64("id"), "id")
        .limit(sample_rows)
    )
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("body")).join(F.broadcast(chosen), "id")

    def count(batches):
        class Every:
            def __contains__(self, _):
                return True

        for batch in batches:
            found = [feature_counts(t, Every()) for t in batch.column(2).to_pylist()]
            yield pa.record_batch(
                [batch.column(0), batch.column(1), pa.array([list(c) for c in found], pa.list_(pa.string())), pa.array([list(c.values()) for c in found], pa.list_(pa.int32()))],
                ["id", "toxic", "feature", "n"],
            )

    counted = materialize(
        rows.select("id", "toxic", "body").mapInArrow(count, "id long, toxic boolean, feature array<string>, n array<int>")
    )
    totals = counted.agg(F.count_if("toxic").alias("bad"), F.count_if(~F.col("toxic")).alias("good")).first()
    if not totals.bad or not totals.good:
        return SeverityModel()
    bad, good = (F.col("bad") + 0.5) / (totals.bad + 1), (F.col("good") + 0.5) / (totals.good + 1)
    z = (bad - good) / F.sqrt(bad * (1 - bad) / totals.bad + good * (1 - good) / totals.good + 1e-9)
    telling = (
        counted.select("toxic", F.explode("feature").alias("feature"))
        .groupBy("feature")
        .agg(F.count_if("toxic").alias("bad"), F.count_if(~F.col("toxic")).alias("good"))
        .where(F.col("bad") + F.col("good") >= least_rows)
        .select("feature", F.abs(z).alias("z"), (bad / good).alias("lift"))
        .orderBy(F.desc("z"), "feature")
        .limit(features)
        .collect()
    )
    place = {r.feature: i for i, r in enumerate(telling)}
    strong = np.array([r.lift >= 8 for r in telling])

    def keep(batches):
        for batch in batches:
            cells = [
                [(place[f], c) for f, c in zip(fs, ns) if f in place]
                for fs, ns in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())
            ]
            yield pa.record_batch(
                [batch.column(1), pa.array([[a for a, _ in x] for x in cells], pa.list_(pa.int32())), pa.array([[b for _, b in x] for x in cells], pa.list_(pa.int32()))],
                ["toxic", "place", "n"],
            )

    data = counted.mapInArrow(keep, "toxic boolean, place array<int>, n array<int>").collect()
    at = np.repeat(np.arange(len(data)), [len(r.place) for r in data])
    columns = np.array([p for r in data for p in r.place], np.int64)
    counts = np.array([c for r in data for c in r.n], np.float64)
    toxic = np.array([r.toxic for r in data])
    signal = np.bincount(at, counts * strong[columns], len(data)) if len(columns) else np.zeros(len(data))
    thirds = np.quantile(signal[toxic], [1 / 3, 2 / 3])
    grades = np.where(toxic, 1 + (signal > thirds[0]) + (signal > thirds[1]), 0)
    weights, limits = fit_ordinal(at, columns, np.log1p(counts), grades, len(place))
    return SeverityModel({f: float(weights[i]) for f, i in place.items()}, limits)


def add_severity(docs: DataFrame, model: SeverityModel, text_col: str = "text") -> DataFrame:
    """The table with ``expected_severity`` (0 to 3) and ``toxic`` (a grade above 0 is likelier than not), which
    replace columns of those names.

    A null, empty or blank text has the margin of no features. Whole texts count; a feature enters with the logarithm
    of one plus its occurrences, so that a long text does not hide it. Ids are not read. There is no shuffle.
    """
    weights, cache = model.weights, {}

    @F.pandas_udf("double")
    def margin(texts: pd.Series) -> pd.Series:
        def one(text):
            counts: dict[str, int] = {}
            for word, n in Counter(_WORD.findall((text or "").lower())).items():
                own = cache.get(word)
                if own is None:
                    if len(cache) > 1 << 19:
                        cache.clear()
                    own = cache[word] = tuple(f for f in features_of(word) if f in weights)
                for f in own:
                    counts[f] = counts.get(f, 0) + n
            return float(sum(weights[f] * math.log1p(n) for f, n in counts.items()))

        return texts.map(one)

    above = [F.lit(0.0) if math.isinf(x) else 1 / (1 + F.exp(F.lit(x) - F.col("margin"))) for x in model.limits]
    total = above[0]
    for x in above[1:]:
        total = total + x
    rest = [F.col(f"`{c}`") for c in docs.columns if c not in ("expected_severity", "toxic")]
    scored = docs.select(F.struct(*rest).alias("row"), margin(F.col(f"`{text_col}`").cast("string")).alias("margin"))
    return scored.select("row.*", total.alias("expected_severity"), (above[0] > 0.5).alias("toxic"))
