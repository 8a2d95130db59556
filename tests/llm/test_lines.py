"""Line deduplication against a plain loop."""

from frames import AWKWARD, awkward, empty

import cardwatch.llm.skew as skew
from cardwatch.llm.lines import SPACES, UPPER, LOWER, drop_repeated_lines


def by_loop(rows, least=10):
    key = lambda line: line.strip(SPACES).translate(str.maketrans(UPPER, LOWER))
    first = {}
    for doc, text in rows:
        for line in (text or "").split("\n"):
            if doc is not None:
                first[key(line)] = min(first.get(key(line), doc), doc)
    out = []
    for doc, text in rows:
        lines = (text or "").split("\n")
        stay = [x for x in lines if doc is None or len(key(x)) < least or first[key(x)] == doc]
        out.append((doc, "\n".join(stay), len(lines), len(lines) - len(stay)))
    return sorted(out, key=str)


def test_awkward_rows(spark):
    got = drop_repeated_lines(awkward(spark))
    assert got.columns == ["doc_id", "text", "pos", "id", "n_lines", "n_dropped"]
    rows = sorted(((r.doc_id, r.text, r.n_lines, r.n_dropped) for r in got.collect()), key=str)
    assert rows == by_loop([r[:2] for r in AWKWARD])


def test_many_copies(spark):
    rows = [(i, f"shared by everyone here\nown line number {i}\nshared by everyone here") for i in range(300)]
    got = drop_repeated_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(((r.doc_id, r.text, r.n_lines, r.n_dropped) for r in got), key=str) == by_loop(rows)


def test_empty_table(spark):
    assert drop_repeated_lines(empty(spark)).collect() == []


def test_hot_lines(spark, monkeypatch):
    """Lines of hot and of other hashes in one table: the broadcast and the shuffle take their own."""
    monkeypatch.setattr(skew, "HOT_ROWS", 20)
    rows = [(i, f"shared by everyone here\nshared by a few, number {i % 40}\nown line number {i}") for i in range(300)]
    got = drop_repeated_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(((r.doc_id, r.text, r.n_lines, r.n_dropped) for r in got), key=str) == by_loop(rows)


def test_hot_keys_are_bounded():
    assert skew.hot_rows(0) == skew.HOT_ROWS
    for total in (10**6, 10**9 + 7, 10**14):
        assert total // skew.hot_rows(total) <= skew.HOT_KEYS
