"""Quality selection by importance resampling between hashed n-gram models."""

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cardwatch.llm.words import batch_words, mix
from cardwatch.sources.session import materialize

#: Buckets of hashed words and word pairs, and the most target rows that the target's model is fitted on.
BUCKETS = 1 << 16
TARGET_ROWS = 20_000
#: Vectors of counts that are added up in one place, and rounds of it: enough for 32^4 tasks.
MERGE_WAYS = 32
MERGE_ROUNDS = 4

_PAIR = np.uint64(0xC2B2AE3D27D4EB4F)


def ngram_buckets(words: np.ndarray) -> np.ndarray:
    """Buckets of all words and neighbouring pairs of one text."""
    pairs = mix(words[:-1] * _PAIR + words[1:])
    return (np.concatenate([words, pairs]) % np.uint64(BUCKETS)).astype(np.int64)


def _texts(column):
    for rows, words, ends in batch_words(column):
        start = 0
        for row, end in zip(rows, ends):
            yield row, words[start:end]
            start = end


def _count(batches):
    """One row per task: n-grams by bucket of the target rows and of all rows."""
    totals = np.zeros((2, BUCKETS), np.int64)
    for batch in batches:
        target = batch.column(1).to_pylist()
        for row, words in _texts(batch.column(0)):
            found = np.bincount(ngram_buckets(words), minlength=BUCKETS) if len(words) > 4000 else None
            for k in (0, 1) if target[row] else (1,):
                if found is None:
                    np.add.at(totals[k], ngram_buckets(words), 1)
                else:
                    totals[k] += found
    yield pa.record_batch([pa.array([totals.tobytes()])], ["counts"])


def _add(table: pa.Table) -> pa.Table:
    total = np.zeros(2 * BUCKETS, np.int64)
    for data in table.column("counts"):
        total += np.frombuffer(data.as_buffer(), np.int64)
    return pa.table([table.column("way").slice(0, 1), pa.array([total.tobytes()])], ["way", "counts"])


def log_ratios(
    docs: DataFrame, targets: DataFrame, target_rows: int = TARGET_ROWS, id_col: str = "doc_id", text_col: str = "text"
) -> np.ndarray:
    """log p(bucket | target) - log p(bucket | all documents), with one added to every count.

    ``targets`` has the ids of the target documents in ``id``; at most ``target_rows`` of them, taken by a hash of the
    id, enter the target's model. All documents enter the other. Tasks add up their own counts, vectors of a fixed
    size, of which at most ``MERGE_WAYS`` are added in one place and round.
    """
    chosen = targets.where("id IS NOT NULL").distinct().orderBy(F.xxhash64("id"), "id").limit(target_rows)
    flagged = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("body")).join(
        F.broadcast(chosen.withColumn("target", F.lit(True))), "id", "left"
    )
    counts = flagged.select("body", F.coalesce("target", F.lit(False)).alias("target")).mapInArrow(_count, "counts binary")
    counts = counts.select(F.spark_partition_id().cast("long").alias("way"), "counts")
    for _ in range(MERGE_ROUNDS):
        wider = counts.select(F.floor(F.col("way") / MERGE_WAYS).cast("long").alias("way"), "counts")
        counts = wider.groupBy("way").applyInArrow(_add, "way long, counts binary")
    counts = counts.first()
    totals = np.frombuffer(counts.counts, np.int64).reshape(2, BUCKETS) if counts else np.zeros((2, BUCKETS), np.int64)
    logs = np.log(totals + 1.0) - np.log(totals.sum(axis=1, keepdims=True) + BUCKETS)
    return logs[0] - logs[1]


def kth_largest(table: DataFrame, column: str, k: int):
    """(value, rank): the kth largest value and its rank among the rows equal to it, by narrowing a histogram.

    Each round counts 256 bins between the extremes of what is left; only the counts reach the driver.
    """
    low, high = table.agg(F.min(column), F.max(column)).first()
    while low < high:
        bin_ = F.least(F.lit(255), F.floor((F.col(column) - F.lit(low)) / F.lit(high - low) * 256))
        bins = (
            table.where(F.col(column).between(low, high))
            .groupBy(bin_.alias("bin"))
            .agg(F.count("*").alias("n"), F.min(column).alias("low"), F.max(column).alias("high"))
            .orderBy(F.desc("bin"))
            .collect()
        )
        for b in bins:
            if k <= b.n:
                low, high = b.low, b.high
                break
            k -= b.n
    return low, k


def resample(
    docs: DataFrame, ratios: np.ndarray, keep: float = 0.8, seed: int = 17, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``doc_id``, ``log_weight`` and ``gumbel_key`` of a sample of ``keep`` of all rows, without replacement.

    A text's weight is the ratio of its probabilities under the two models, the sum of its n-grams' log ratios. Adding
    Gumbel noise and taking the largest keys draws rows in proportion to their weights. Noise is a hash of seed, id and
    text, so that a lost task draws the same again. The smaller id wins between equal keys; rows alike in both stay
    together, also at the border. Null, empty and blank texts have weight 0 in the logarithm; null ids come last
    among equal keys. An empty table gives an empty sample. Other columns are not read.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(ratios)

    def weigh(batches):
        values = shared.value
        for batch in batches:
            out = np.zeros(batch.num_rows)
            for row, words in _texts(batch.column(1)):
                out[row] = values[ngram_buckets(words)].sum() if len(words) else 0.0
            yield pa.record_batch([batch.column(0), batch.column(2), pa.array(out)], ["id", "h", "log_weight"])

    source = docs.select(
        F.col(f"`{id_col}`").cast("long").alias("id"),
        F.col(f"`{text_col}`").alias("body"),
        F.xxhash64(F.lit(seed), F.col(f"`{id_col}`"), F.col(f"`{text_col}`")).alias("h"),
    )
    uniform = (F.shiftrightunsigned("h", 11).cast("double") + 0.5) / float(1 << 53)
    scored = materialize(
        source.mapInArrow(weigh, "id long, h long, log_weight double").select(
            "id", "log_weight", (F.col("log_weight") - F.log(-F.log(uniform))).alias("key"), F.coalesce("id", F.lit((1 << 63) - 1)).alias("tie")
        )
    )
    k = math.floor(keep * scored.count())
    if not k:
        return scored.where("false").select(F.col("id").alias("doc_id"), "log_weight", F.col("key").alias("gumbel_key"))
    border, rank = kth_largest(scored, "key", k)
    equal = scored.where(F.col("key") == F.lit(border)).select((-F.col("tie")).alias("tie"))
    last = -kth_largest(equal, "tie", rank)[0]
    inside = (F.col("key") > F.lit(border)) | ((F.col("key") == F.lit(border)) & (F.col("tie") <= F.lit(last)))
    return scored.where(inside).select(F.col("id").alias("doc_id"), "log_weight", F.col("key").alias("gumbel_key"))
