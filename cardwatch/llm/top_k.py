"""Exact nearest vectors by inner product with the threshold algorithm over sorted per-dimension lists."""

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from cardwatch.sources.session import materialize

#: Queries in one broadcast, candidates in one block of sorted lists, and entries of each list that are read before the
#: first look at the bound.
QUERY_CHUNK = 8192
BLOCK = 16384
STEP = 64


class Lists:
    """A block of candidates with its sorted per-dimension lists."""

    def __init__(self, ids: np.ndarray, values: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, self.values = ids[order], values[order]
        self.order = np.ascontiguousarray(np.argsort(self.values, axis=0, kind="stable").T)

    def search(self, query: np.ndarray, own: int, k: int, best: list[tuple[float, int]]) -> list[tuple[float, int]]:
        """The k best of ``best`` and this block as (-score, id).

        Every list is read from the end that helps the query, twice as far each time. What it shows is scored at once
        by random access. The bound is the score of a candidate that has the value last read in every list; below the
        kth score no unseen candidate can matter. Equal to it, one with a smaller id still can, so reading goes on.
        """
        n = len(self.ids)
        rising, falling = np.flatnonzero(query < 0), np.flatnonzero(query > 0)
        if not len(rising) and not len(falling):  # all scores are 0: the smallest ids win
            ids = self.ids[self.ids != own][:k]
            return sorted(best + [(0.0, int(i)) for i in ids])[:k]
        seen, scored = np.zeros(n, bool), np.zeros(n, bool)
        depth = 0
        while depth < n:
            stop = min(n, max(STEP, 2 * depth))
            seen[self.order[rising, depth:stop].ravel()] = True
            seen[self.order[falling, n - stop : n - depth].ravel()] = True
            fresh = np.flatnonzero(seen & ~scored)
            scored[fresh] = True
            fresh = fresh[self.ids[fresh] != own]
            scores = self.values[fresh] @ query
            if len(best) == k:
                near = scores >= -best[-1][0]
                fresh, scores = fresh[near], scores[near]
            if len(fresh) > 8 * k:  # only the k highest and what ties with them
                near = scores >= np.partition(scores, len(scores) - k)[len(scores) - k]
                fresh, scores = fresh[near], scores[near]
            top = np.lexsort((self.ids[fresh], -scores))[:k]
            best = sorted(best + [(-float(scores[i]), int(self.ids[fresh[i]])) for i in top])[:k]
            last = np.concatenate([self.order[rising, stop - 1], self.order[falling, n - stop]])
            used = np.concatenate([rising, falling])
            if len(best) == k and float(self.values[last, used] @ query[used]) < -best[-1][0] or scored.all():
                break
            depth = stop
        return best


def _blocks(batches, size):
    """(ids, matrix) of candidates with equally long vectors."""
    held: dict[int, tuple[list, list]] = {}
    for batch in batches:
        vectors = batch.column(1)
        flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
        lengths = np.diff(vectors.offsets.to_numpy())
        starts = np.cumsum(lengths) - lengths
        ids = batch.column(0).to_numpy(zero_copy_only=False)
        for d in np.unique(lengths):
            rows = np.flatnonzero(lengths == d)
            matrix = flat[starts[rows][:, None] + np.arange(d)]
            own = held.setdefault(int(d), ([], []))
            own[0].append(ids[rows])
            own[1].append(matrix)
            while sum(map(len, own[0])) >= size:
                all_ids, all_rows = np.concatenate(own[0]), np.concatenate(own[1])
                yield all_ids[:size], all_rows[:size]
                own = held[int(d)] = ([all_ids[size:]], [all_rows[size:]])
    for ids, rows in held.values():
        if sum(map(len, ids)):
            yield np.concatenate(ids), np.concatenate(rows)


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """``id`` and ``v``, floor(256 * x) of every component; without rows whose id or vector is null, and without
    vectors that hold null, NaN or an infinity."""
    v = F.col(f"`{vector_col}`")
    bad = F.exists(v, lambda x: F.coalesce(F.isnan(x) | (F.abs(x) == float("inf")), F.lit(True)))
    return vectors.where(v.isNotNull() & F.col(f"`{id_col}`").isNotNull()).where(~bad).select(
        F.col(f"`{id_col}`").cast("long").alias("id"),
        F.transform(v, lambda x: F.floor(x.cast("double") * 256).cast("double")).alias("v"),
    )


def exact_top_k(candidates: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """``query_id``, ``rank``, ``vec_id`` and ``score``: each query's ``k`` highest inner products, ties to smaller ids.

    Both tables have ``id`` and ``v`` (whole numbers as doubles, none null), as ``usable`` gives them. A query's
    candidates are all rows with another id and a vector of the same length; with fewer than ``k`` all are returned.
    A query row that is there twice is answered once. Empty tables give no rows.

    Queries go to the executors in broadcasts of about ``QUERY_CHUNK`` rows, one after the other: what a chunk finds is
    stored, and its broadcast is given up before the next chunk is read, so that neither the driver nor an executor ever
    holds more than one. Candidates stay where they are, are read in blocks of bounded size, and each task sends k rows
    per query. So no pair is ever a row.
    """
    spark, schema = candidates.sparkSession, "query_id long, vec_id long, score long"
    queries = materialize(queries.dropDuplicates(["id"]))
    chunks = max(1, math.ceil(queries.count() / QUERY_CHUNK))

    def search_in(shared):
        def search(batches):
            best = {q: [] for q, _ in shared.value}
            for ids, values in _blocks(batches, BLOCK):
                lists = Lists(ids, values)
                for q, vector in shared.value:
                    if len(vector) == values.shape[1]:
                        best[q] = lists.search(vector, q, k, best[q])
            out = [(q, i, int(-s)) for q, found in best.items() for s, i in found]
            columns = list(zip(*out)) or [(), (), ()]
            yield pa.record_batch([pa.array(c, pa.int64()) for c in columns], ["query_id", "vec_id", "score"])

        return candidates.select("id", "v").mapInArrow(search, schema)

    found = None
    for chunk in range(chunks):
        rows = queries.where(F.pmod(F.xxhash64("id"), F.lit(chunks)) == chunk).collect()
        shared = spark.sparkContext.broadcast([(r.id, np.array(r.v, np.float64)) for r in rows])
        part = search_in(shared)
        if chunks > 1:
            part = materialize(part)
            shared.destroy()
        found = part if found is None else found.union(part)
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
