"""Cuts, order and round trips of fill-in-the-middle, against regular expressions and SQL."""

import hashlib
import re

import duckdb
import numpy as np
import pytest
from compare import difference
from frames import AWKWARD, awkward, empty
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import cardwatch.llm.infill as infill
from cardwatch.llm.infill import RankIndex, boundaries, cut_points, fill_in_middle, index_of, restored
from cardwatch.llm.queries import ORACLES, QUERIES

UNITS = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")
SMALL = "/root/testdata/sf0.001"
TEXTS = st.text(st.sampled_from("ab é\n\t\x0b\x1c\u2003😀<P>")) | st.text(max_size=60)


def ends(text):
    return [m.end() for m in UNITS.finditer(text)]


@settings(max_examples=300, deadline=None)
@given(TEXTS, st.integers(1, 7))
def test_boundaries_in_windows(text, window):
    whole = infill.WINDOW
    infill.WINDOW = window
    try:
        parts = list(boundaries(text))
    finally:
        infill.WINDOW = whole
    assert [int(x) for p in parts for x in p] == ends(text)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 10_000) | st.integers(1, 9), max_size=900), st.sampled_from([1, 2, 16, 127]), st.integers(1, 400))
def test_index_is_exact(steps, error, batch):
    offsets = np.cumsum(np.array(steps, np.int64))
    index = RankIndex(error)
    for at in range(0, len(offsets), batch):
        index.add(offsets[at : at + batch])
    index.freeze()
    assert [index.offset(i) for i in range(len(offsets))] == offsets.tolist()
    assert all(abs(r.astype(int)).max() <= error for r in index.residuals)


def test_index_is_small():
    text = "some words of even length " * 40_000
    index = index_of(text)
    assert index.size == 200_001 and len(index.segments) < 50
    assert index.offset(199_999) == len(text) - 1
    with pytest.raises(ValueError):
        RankIndex(128)


@settings(max_examples=200, deadline=None)
@given(TEXTS, st.integers(0, 2**32 - 1), st.integers(0, 2**32 - 1))
def test_cut_points(text, one, other):
    stops = [0, *ends(text)]
    low, high = sorted((one % len(stops), other % len(stops)))
    assert cut_points(text, one, other) == (len(stops) - 1, stops[low], stops[high])


def expected(doc_id, text):
    body, units = text or "", UNITS.findall(text or "")
    digest = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    low, high = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    p, m, s = ("".join(units[a:b]) for a, b in ((0, low), (low, high), (high, None)))
    if not body or any(x in body for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return len(units), "plain", None, None, None, body
    if h[3] % 100 < 80:
        return len(units), "spm", p, m, s, f"<S>{s}<P>{p}<M>{m}"
    return len(units), "psm", p, m, s, f"<P>{p}<S>{s}<M>{m}"


def test_rows(spark):
    texts = ["a b", " <", "<P", "S> x <", "<S>", "tail  \n", "😀 é\x1cb\u2003c d", "M>" * 9, "<M <S <P " * 20]
    docs = [(1000 * i + j, t) for j, t in enumerate(texts) for i in range(12)]
    df = spark.createDataFrame([(d, t, "own", "mine") for d, t in docs], "doc_id long, text string, form string, body string")
    made = fill_in_middle(df).withColumn("back", restored(F.col("output"), F.col("form"))).collect()
    fields = ("n_tokens", "form", "prefix", "middle", "suffix", "output")
    assert sorted((r.doc_id, *[r[f] for f in fields]) for r in made) == sorted((d, *expected(d, t)) for d, t in docs)
    assert {r.form for r in made} == {"plain", "spm", "psm"}
    assert all(r.back == r.text and r.body == "mine" for r in made)


def test_awkward_rows(spark):
    got = fill_in_middle(awkward(spark)).collect()
    assert sorted(((r.doc_id, r.output) for r in got), key=str) == sorted(
        ((r[0], expected(r[0], r[1])[-1]) for r in AWKWARD), key=str
    )
    assert set(awkward(spark).columns) <= set(got[0].__fields__)
    assert fill_in_middle(empty(spark)).collect() == []


def test_query_on_awkward_rows(spark, tmp_path):
    awkward(spark).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert difference(QUERIES["op12_fill_in_middle"](spark, str(tmp_path)), con, ORACLES["op12_fill_in_middle"]) is None


def test_query_restores(spark):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    for r in QUERIES["op12_fill_in_middle"](spark, SMALL).collect():
        assert r.restored_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()
