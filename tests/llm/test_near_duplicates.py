"""Groups of near duplicates against all pairs."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from frames import AWKWARD, awkward, empty

import cardwatch.llm.near_duplicates as near
import cardwatch.llm.skew as skew
from cardwatch.llm.components import connected_components
from cardwatch.llm.lines import LOWER, UPPER
from cardwatch.llm.near_duplicates import divide_skip, hot_lists, meeting_places, merge_skip, near_duplicate_groups, near_duplicate_links
from cardwatch.llm.words import word_hashes

SMALL = "/root/testdata/sf0.001"
FOLD = str.maketrans(UPPER, LOWER)


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(FOLD))
    return frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()


def by_pairs(rows):
    sets = [(i, shingles(t)) for i, t in rows]
    lists = defaultdict(list)
    for n, (_, s) in enumerate(sets):
        for g in s:
            lists[g].append(n)
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for n, (_, s) in enumerate(sets):
        for m, k in Counter(x for g in s for x in lists[g] if x < n).items():
            if 100 * k >= 75 * (len(s) + len(sets[m][1]) - k):
                root[find(n)] = find(m)
    least = defaultdict(lambda: None)
    for n, (i, _) in enumerate(sets):
        if i is not None and (least[find(n)] is None or i < least[find(n)]):
            least[find(n)] = i
    return sorted(((i, len(s), least[find(n)]) for n, (i, s) in enumerate(sets)), key=str)


def clusters(seed=3):
    """Chains and stars of edited copies, unrelated texts with one common passage, and short texts."""
    rng = random.Random(seed)
    vocabulary = ["w%d" % i for i in range(3000)]
    passage = rng.choices(vocabulary, k=60)
    rows = []
    for c in range(6):
        text = rng.choices(vocabulary, k=rng.choice([8, 30, 120]))
        for _ in range(40):
            if rng.random() < 0.5:  # chains drift away from where they began
                base = text = list(text)
            else:
                base = list(text)
            for _ in range(rng.randrange(3)):
                base[rng.randrange(len(base))] = rng.choice(vocabulary)
            rows.append(" ".join(base))
    rows += [" ".join(passage + rng.choices(vocabulary, k=rng.randrange(4, 60))) for _ in range(80)]
    rows += [" ".join(rng.choices(vocabulary[:4], k=rng.randrange(0, 4))) for _ in range(40)]
    rng.shuffle(rows)
    return [(1000 - i, t) for i, t in enumerate(rows)]


@pytest.mark.parametrize(
    "ranges,block,held,hot", [(4_000_000, 2048, 2_000_000, 10_000), (500, 7, 2_000_000, 12), (500, 64, 900, 30)]
)
def test_clusters(spark, monkeypatch, ranges, block, held, hot):
    """Small ranges and blocks, and lists and keys that are hot from a few entries on."""
    monkeypatch.setattr(near, "RANGE_ROWS", ranges)
    monkeypatch.setattr(near, "BLOCK", block)
    monkeypatch.setattr(near, "BLOCK_SHINGLES", held)
    monkeypatch.setattr(near, "HOT_LIST", hot)
    monkeypatch.setattr(skew, "HOT_ROWS", hot)
    rows = clusters()
    got = near_duplicate_groups(spark.createDataFrame(rows, "doc_id long, text string").repartition(5))
    assert sorted(map(tuple, got.collect()), key=str) == by_pairs(rows)


def test_given_documents(spark):
    frame = spark.read.parquet(f"{SMALL}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in frame.collect()]
    assert sorted(map(tuple, near_duplicate_groups(frame).collect()), key=str) == by_pairs(rows)


def test_awkward_rows(spark):
    got = near_duplicate_groups(awkward(spark)).collect()
    assert sorted(map(tuple, got), key=str) == by_pairs([r[:2] for r in AWKWARD])
    assert near_duplicate_groups(empty(spark)).collect() == []


def test_divide_skip_finds_all_pairs():
    rng = np.random.default_rng(2)
    sets = [np.unique(rng.integers(0, 40, rng.integers(1, 40)).astype(np.uint64)) for _ in range(60)]
    sizes, labels = [len(s) for s in sets], list(range(60))
    got = {tuple(sorted(p)) for p in divide_skip(sets, sizes, labels, range(60), 60)}
    want = {
        (a, b) for a in range(60) for b in range(a + 1, 60)
        if 100 * len(np.intersect1d(sets[a], sets[b])) >= 60 * len(np.union1d(sets[a], sets[b]))
    }
    assert got == want


def test_components_of_long_paths(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(100 + i, 90) for i in range(20)] + [(7, 7)]
    got = dict(map(tuple, connected_components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert got == {**{i: 0 for i in range(61)}, 90: 90, **{100 + i: 90 for i in range(20)}}
    assert connected_components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_words_of_long_and_mixed_texts():
    text = ("Ünï word\x0bWORD\r\n " * 200_000 + "x" * 3_000_000 + " end").encode()
    hashes, starts = word_hashes(np.frombuffer(text, np.uint8))
    words = text.split()
    assert len(hashes) == len(words) and [text[s : s + 2] for s in starts[-2:].tolist()] == [b"xx", b"en"]
    assert len(set(hashes.tolist())) == 4 and hashes[1] == hashes[2]


def test_place_with_very_many_texts(spark):
    meets = spark.range(20_000_000).selectExpr("id AS node", "7L AS t")
    assert [tuple(r) for r in meeting_places(meets).collect()] == [(7, 0, 20_000_000)]


def test_merge_skip_counts_lists():
    rng = random.Random(5)
    for _ in range(300):
        lists = [sorted(rng.sample(range(60), rng.randrange(0, 40))) for _ in range(rng.randrange(1, 12))]
        counts = Counter(x for members in lists for x in members)
        for least in (1, 2, 3, len(lists), len(lists) + 1):
            assert list(merge_skip(lists, least)) == sorted((x, k) for x, k in counts.items() if k >= least)


def links_by_pairs(texts):
    sets = [shingles(t) for t in texts]
    linked = lambda a, b: a and b and 100 * len(a & b) >= 75 * len(a | b)
    return [sum(bool(linked(a, b)) for j, b in enumerate(sets) if j != i) for i, a in enumerate(sets)], sets


@pytest.mark.parametrize("hot", [10_000, 12])
def test_links_of_every_row(spark, monkeypatch, hot):
    monkeypatch.setattr(near, "HOT_LIST", hot)
    monkeypatch.setattr(skew, "HOT_ROWS", hot)
    monkeypatch.setattr(near, "BLOCK", 16)
    rows = clusters(4) + [(2000 + i, "the same words in each of these rows") for i in range(20)]
    counts, sets = links_by_pairs([t for _, t in rows])
    members, links = near_duplicate_links(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    members = members.collect()
    assert sorted((r.doc_id, r.n_shingles, r.n_links) for r in members) == sorted(
        (i, len(s), k) for (i, _), s, k in zip(rows, sets, counts)
    )
    node = {r.doc_id: r.node for r in members}
    node_of = {s: node[i] for (i, _), s in zip(rows, sets)}
    distinct = [s for s in node_of if s]
    want = {
        tuple(sorted((node_of[a], node_of[b]))) for n, a in enumerate(distinct) for b in distinct[:n]
        if 100 * len(a & b) >= 75 * len(a | b)
    }
    got = [tuple(r) for r in links.collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_links_of_awkward_rows(spark):
    members, links = near_duplicate_links(awkward(spark))
    counts, sets = links_by_pairs([r[1] for r in AWKWARD])
    assert sorted(((r.doc_id, r.n_shingles, r.n_links) for r in members.collect()), key=str) == sorted(
        ((r[0], len(s), k) for r, s, k in zip(AWKWARD, sets, counts)), key=str
    )
    members, links = near_duplicate_links(empty(spark))
    assert members.collect() == [] and links.collect() == []


def test_hot_lists_are_few(spark, monkeypatch):
    """A list that half of the texts share is hot wherever it is long enough, and no list beyond the bound."""
    monkeypatch.setattr(near, "HOT_LIST", 50)
    rows = [(i, f"one two three four five a{i} b{i} c{i} d{i} e{i}" if i % 2 else f"f{i} g{i} h{i}") for i in range(200)]
    source = spark.createDataFrame(rows, "id long, body string").repartition(2)
    sized = source.mapInArrow(near._sizes(5), near._SIZED)
    hashes, held = hot_lists(sized, 10_000)
    assert held.tolist() == [100] and len(hashes) == 1
    monkeypatch.setattr(near, "HOT_LISTS", 10)
    assert len(hot_lists(sized, 10_000)[0]) == 0
