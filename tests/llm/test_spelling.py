"""Spelling variants against all pairs of words, tile by tile and in whole tables."""

import random
import re
import zlib
from collections import Counter

import pyarrow as pa
import pytest
from frames import awkward, empty

import cardwatch.llm.spelling as spelling
from cardwatch.llm.queries import QUERIES
from cardwatch.llm.spelling import count_words, near_words, roots, spelling_groups

SMALL = "/root/testdata/sf0.001"


def one_edit(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) > len(b):
        a, b = b, a
    at = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[at:] == b[at + 1 :] or a[at + 1 :] == b[at + 1 :] and len(a) == len(b)


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def counted(rows):
    """Words and their numbers as the contract says, row by row."""
    out = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = lower(run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 7:
                out[run] += 1
    return out


def grouped(words, times=10):
    """All pairs, by the letters that an edit can lead to."""
    by_gap = {}
    for w in words:
        for i in range(len(w)):
            by_gap.setdefault((w[:i], w[i + 1 :]), set()).add(w)
        for i in range(len(w) + 1):
            by_gap.setdefault((w[:i], w[i:]), set()).add(w)
    form, near = {}, {}
    for w in words:
        found = {x for i in range(len(w)) for x in by_gap[w[:i], w[i + 1 :]]}
        found |= {x for i in range(len(w) + 1) for x in by_gap[w[:i], w[i:]]}
        found = {x for x in found if one_edit(w, x)}
        best = min(found, key=lambda x: (-words[x], x), default=None)
        near[w] = len(found)
        form[w] = best if best and words[best] >= times * words[w] else None
    out = set()
    for w in words:
        root = w
        while form[root]:
            root = form[root]
        out.add((w, form[w], root, words[w], near[w], words[form[w]] if form[w] else None))
    return out


def rows(df):
    got = [tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect()]
    assert len(got) == len(set(got))
    return set(got)


def test_one_edit():
    assert one_edit("abcd", "abd") and one_edit("aab", "aaab") and one_edit("abc", "abx") and one_edit("abc", "xabc")
    assert not one_edit("abc", "abc") and not one_edit("abc", "bca") and not one_edit("abc", "abcde")


def few_letters(seed, n, letters="aábé"):
    rng = random.Random(seed)
    return {"".join(rng.choice(letters) for _ in range(rng.randint(1, 12))): rng.choice((2, 3, 25, 300)) for _ in range(n)}


@pytest.mark.parametrize("tile", [256, 8])
def test_dense_words(spark, monkeypatch, tile):
    """Few letters, so that most groups are too large for a tile and are halved down to single letters."""
    monkeypatch.setattr(spelling, "TILE", tile)
    words = few_letters(tile, 1500)
    df = spark.createDataFrame(list(words.items()), "word string, n long")
    assert rows(spelling_groups(df)) == grouped(words)


def test_tiles_in_small_batches(monkeypatch):
    """The tile function alone: groups that go over several batches, and a bound of few cells."""
    words = sorted(w for w in few_letters(1, 900, "ab") if len(w) in (7, 8))
    table = {"word": words, "n": [2] * len(words), "m": [8] * len(words), "a": [0] * len(words), "b": [0] * len(words)}
    batch = pa.RecordBatch.from_pydict(
        {
            **{k: pa.array(v, pa.int32() if k in "mab" else None) for k, v in table.items()},
            "cap": pa.array([9] * len(words), pa.int32()),
            "key": pa.array([5] * len(words)),
        }
    )
    whole = [r for b in spelling._tiles(iter([batch])) for r in b.to_pylist()]
    monkeypatch.setattr(spelling, "CELLS", 64)
    cut = [r for b in spelling._tiles(batch.slice(i, 3) for i in range(0, len(words), 3)) for r in b.to_pylist()]
    assert whole == cut
    assert len(whole) > 20
    for r in whole:
        pairs = [x for x in words if one_edit(r["word"], x) and 8 in (len(x), len(r["word"]))]
        assert r["n_near"] == len(pairs) and r["best"] == min(pairs)


def test_long_words_and_letters_outside_latin_1(spark):
    long = "x" * 900 + "é" + "y" * 900
    words = {long: 100, long[1:]: 2, "z" + long: 3, "слово здесь": 40, "слово зде": 1, "слово здес": 2, "naïveté": 50, "naivete": 5, "naiveté": 5}
    assert rows(spelling_groups(spark.createDataFrame(list(words.items()), "word string, n long"))) == grouped(words)


def test_chains_ties_and_repeats(spark):
    words = {"abcdefg": 20_000, "abcdefh": 2_000, "abcdexh": 200, "abcyexh": 20, "zbcyexh": 2, "abcyexx": 2}
    df = spark.createDataFrame([(w, n // 2, "x") for w, n in words.items()] * 2 + [(None, 3, "x"), ("", 3, "x"), ("abcdefg", None, "x")], "word string, n long, best string")
    got = rows(spelling_groups(df))
    assert got == grouped(words) and ("zbcyexh", "abcyexh", "abcdefg", 2, 1, 20) in got
    tie = {"aaaaaaab": 20, "aaaaaaac": 20, "aaaaaaad": 2}
    assert ("aaaaaaad", "aaaaaaab", "aaaaaaab", 2, 2, 20) in rows(spelling_groups(spark.createDataFrame(list(tie.items()), "word string, n long")))


def test_empty(spark):
    assert count_words(empty(spark)).collect() == []
    assert spelling_groups(spark.createDataFrame([], "word string, n long")).collect() == []
    assert roots(spark.createDataFrame([], "word string, form string")).collect() == []
    assert near_words(spark.createDataFrame([("abc", 1)], "word string, n long").select("word", "n")).first().n_near == 0


def test_awkward_rows(spark):
    frame = awkward(spark)
    assert {r.word: r.n for r in count_words(frame).collect()} == counted((r.doc_id, r.text) for r in frame.collect())


def test_query(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()
    words = {w: n for w, n in counted(docs).items() if n >= 2}
    assert rows(QUERIES["op11_spelling_groups"](spark, SMALL)) == grouped(words)
