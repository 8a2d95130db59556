"""Token counts against whole texts given to the library."""

import pytest
from frames import AWKWARD, awkward, empty
from tokenizers import Tokenizer

from cardwatch.llm.queries import QUERIES, tokenizer_file
from cardwatch.llm.token_counts import balanced, count_tokens

SMALL = "/root/testdata/sf0.001"
FILE = tokenizer_file("word_bpe_49k.json")


@pytest.fixture(scope="module")
def whole():
    tokenizer = Tokenizer.from_file(FILE)
    return lambda text: len(tokenizer.encode(text or "", add_special_tokens=False).ids)


def test_awkward_rows(spark, whole):
    got = count_tokens(awkward(spark), FILE).collect()
    want = [(i, len((t or "").encode()), whole(t)) for i, t, *_ in AWKWARD]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert count_tokens(empty(spark), FILE).collect() == []


def test_query(spark, whole):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    got = QUERIES["op4_token_counts"](spark, SMALL).collect()
    assert len(got) == len(docs)
    assert all((r.n_tokens, r.over_limit) == (whole(docs[r.doc_id]), whole(docs[r.doc_id]) > 2048) for r in got)


def test_calls_hold_equal_bytes():
    calls = list(balanced([b"x" * 10] * 100 + [b"y" * 500], 100))
    assert [sum(map(len, c)) for c in calls] == [100] * 10 + [500]
