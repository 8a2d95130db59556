"""Piece hits and bit-parallel distances against the whole distance table."""

import random

from frames import awkward, empty
from hypothesis import given, settings
from hypothesis import strategies as st

from cardwatch.llm.decontaminate import Items, best_match, find_items, one_edit, pieces, plain
from cardwatch.llm.queries import QUERIES

SMALL = "/root/testdata/sf0.01"


def table_distance(item, text):
    """Smallest distance of ``item`` to a part of ``text``, row by row."""
    row = list(range(len(item) + 1))
    best = row[-1]
    for c in text:
        new = [0]
        for i, x in enumerate(item, 1):
            new.append(min(row[i] + 1, new[i - 1] + 1, row[i - 1] + (x != c)))
        row, best = new, min(best, new[-1])
    return best


@settings(max_examples=150, deadline=None)
@given(st.text("ab c", min_size=1, max_size=40), st.text("ab c", max_size=60), st.integers(0, 12))
def test_myers(item, text, budget):
    want = table_distance(item, text)
    assert best_match(item, text, budget) == (want if want <= budget else None)


@settings(max_examples=300, deadline=None)
@given(st.text("abcd", min_size=4, max_size=30), st.lists(st.tuples(st.integers(0, 29), st.sampled_from("xy-+")), max_size=6), st.text("abcd", max_size=9))
def test_no_edit_pattern_is_missed(item, edits, around):
    text = list(item)
    for at, kind in edits:
        at = min(at, len(text))
        if kind == "+":
            text.insert(at, "z")
        elif at < len(text):
            text[at : at + 1] = [] if kind == "-" else [kind]
    text = around + "".join(text) + around
    for percent in (10, 20, 34):
        want = table_distance(item, text)
        budget = len(item) * percent // 100
        got = dict(Items([(7, item)], percent).find(text))
        assert got == ({7: want} if want <= budget else {})


@given(st.text("ab", max_size=8), st.text("ab", max_size=10))
def test_one_edit(piece, text):
    want = min(table_like(piece, text[:n]) for n in range(len(text) + 1)) <= 1
    assert one_edit(piece, text) == want


def table_like(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_pieces_cover_the_item():
    assert "".join(p for _, p in pieces("abcdefghij", 3)) == "abcdefghij" and len(pieces("abcdefghij", 3)) == 4


def test_edited_passages_are_found(spark):
    rng = random.Random(5)
    words = ["w%03d" % i for i in range(400)]
    items = [(i, " ".join(rng.choices(words, k=40))) for i in range(20)]
    docs = []
    for i in range(200):
        noise = [" ".join(rng.choices(words, k=60)) for _ in range(2)]
        own = list(items[i % 20][1]) if i % 2 else []
        for _ in range(i % 18 if i % 2 else 0):
            own[rng.randrange(len(own))] = "#"
        docs.append((i, noise[0] + "\n" + "".join(own).upper() + "  " + noise[1]))
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    got = {
        (r.doc_id, h.item_id): h.distance
        for r in find_items(frame, spark.createDataFrame(items, "item_id long, text string")).collect()
        for h in r.hits
    }
    want = {}
    for d, t in docs:
        if d % 2:
            distance = table_distance(items[d % 20][1], plain(t))
            if distance <= len(items[d % 20][1]) // 10:
                want[d, d % 20] = distance
    assert got == want and len(want) > 80


def test_a_benchmark_in_parts(spark, monkeypatch):
    """The same hits, rows and columns, one broadcast after the other."""
    bench = spark.createDataFrame([(i, t) for i, t in enumerate(["a SHARED line,", "short", "é", None, "word and more words. word", "first line"])], "item_id long, text string")
    docs = awkward(spark).selectExpr("*", "id AS row", "pos AS key", "'x' AS hits")

    def found():
        got = find_items(docs, bench)
        assert got.columns == docs.columns
        return sorted(((r.doc_id, r.row, r.key, sorted(tuple(h) for h in r.hits)) for r in got.collect()), key=str)

    whole = found()
    monkeypatch.setattr("cardwatch.llm.decontaminate.CHUNK_CHARS", 9)
    assert found() == whole and sum(bool(r[3]) for r in whole) > 4


def test_awkward_rows(spark):
    bench = spark.createDataFrame([(1, None), (2, ""), (3, " \n"), (4, "a SHARED line,"), (4, "a SHARED line,"), (5, "é")], "item_id long, text string")
    got = find_items(awkward(spark), bench).select("doc_id", "hits", "pos").collect()
    found = {r.doc_id: [tuple(h) for h in r.hits] for r in got}
    assert len(got) == 11 and found[3] == [] and found[4] == []
    assert found[1] == [(4, 0)] * 2 and (5, 0) in found[8]
    assert find_items(empty(spark), bench).collect() == []
    none = spark.createDataFrame([], "item_id long, text string")
    assert all(r.hits == [] for r in find_items(awkward(spark), none).collect())


def test_query_finds_exact_passages(spark):
    docs = {r.doc_id: plain(r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    items = {r.item_id: plain(r.text) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()}
    got = {(r.doc_id, r.item_id): r.distance for r in QUERIES["op2_decontamination"](spark, SMALL).collect()}
    exact = {(d, i) for d, t in docs.items() for i, x in items.items() if x in t}
    assert exact and {k for k, v in got.items() if v == 0} == exact
