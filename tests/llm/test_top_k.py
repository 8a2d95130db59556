"""Exact neighbours against the whole score matrix."""

import math

import numpy as np
import pytest

import cardwatch.llm.top_k as top_k
from cardwatch.llm.queries import QUERIES
from cardwatch.llm.top_k import exact_top_k, usable

SMALL = "/root/testdata/sf0.01"
SCHEMA = "vec_id long, embedding array<float>, id string"


def by_matrix(rows, k=5, every=50):
    ok = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, x in dict((i, v) for i, v in ok if i % every == 0).items():
        scores = sorted((-sum(a * b for a, b in zip(x, y)), i) for i, y in ok if i != q and len(y) == len(x))
        out += [(q, r, i, -s) for r, (s, i) in enumerate(scores[:k], 1)]
    return sorted(out)


@pytest.mark.parametrize("block,step,chunk", [(16384, 64, 8192), (37, 3, 2)])
def test_query(spark, monkeypatch, block, step, chunk):
    monkeypatch.setattr(top_k, "QUERY_CHUNK", chunk)
    monkeypatch.setattr(top_k, "BLOCK", block)
    monkeypatch.setattr(top_k, "STEP", step)
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SMALL}/embeddings.parquet").collect()]
    got = QUERIES["op9_top_k"](spark, SMALL).collect()
    assert sorted(map(tuple, got)) == by_matrix(rows)


def test_ties_and_awkward_rows(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.integers(-1, 2, 6).astype(float).tolist()) for i in range(300)]
    rows += [(300, [0.0] * 6), (301, None), (302, [1.0, None, 0.0]), (350, [math.nan] * 6), (303, [math.inf] * 6)]
    rows += [(400, []), (401, []), (450, [1.0]), (None, [1.0] * 6), (7, [1.0] * 6), (7, [1.0] * 6)]
    frame = usable(spark.createDataFrame([(a, b, "x") for a, b in rows], SCHEMA), "vec_id", "embedding")
    got = exact_top_k(frame, frame.where("id % 50 = 0"))
    assert sorted(map(tuple, got.collect())) == by_matrix(rows)


def test_empty_tables(spark):
    none = usable(spark.createDataFrame([], SCHEMA), "vec_id", "embedding")
    assert exact_top_k(none, none).collect() == []
