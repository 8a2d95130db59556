"""Encoding against the model's library, and round trips."""

import pytest
import sentencepiece
from frames import AWKWARD, awkward, empty
from hypothesis import given, settings
from hypothesis import strategies as st

import cardwatch.llm.pieces as pieces
from cardwatch.llm.pieces import SPACE, Encoder, decode, decode_ids, encode
from cardwatch.llm.queries import QUERIES, tokenizer_file

SMALL = "/root/testdata/sf0.001"
FILE = tokenizer_file("piece_bpe_32k.model")
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=FILE)
OWN = Encoder(FILE)


@settings(max_examples=400, deadline=None)
@given(st.text(st.sampled_from("aehtinos .,\n\tTé ß😀▁z1'_")) | st.text(max_size=40))
def test_any_text(text):
    ids = OWN.encode([text])[0].tolist()
    assert ids == LIBRARY.encode(text)
    assert decode_ids(ids, OWN.vocabulary.raw) == text.replace(SPACE, " ")


@pytest.mark.parametrize("text", ["", " ", "  ", "   a", "a   b", "a" * 3000, " " * 50, "x\n\n y", "the " * 500, "▁▁b", "aaaaabaaaa"])
def test_edges(text):
    assert OWN.encode([text])[0].tolist() == LIBRARY.encode(text)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(st.sampled_from("aehtinos .\n\tTé😀▁'_"), max_size=30), max_size=8), st.integers(1, 20), st.integers(1, 30))
def test_batches_of_any_size(texts, chars, indexed):
    """Long texts in parts, small indexes, and words forgotten between batches."""
    before = pieces.CHARS, pieces.INDEX_CHARS, pieces.CACHED_WORDS
    pieces.CHARS, pieces.INDEX_CHARS, pieces.CACHED_WORDS = chars, indexed, chars
    try:
        assert [x.tolist() for x in OWN.encode(texts)] == LIBRARY.encode(texts)
    finally:
        pieces.CHARS, pieces.INDEX_CHARS, pieces.CACHED_WORDS = before


def test_halves():
    """The last merge of pieces, against merging their letters."""
    v = OWN.vocabulary
    for piece, i in list(v.ids.items())[::37]:
        assert v.whole[i] == (v.merge(piece) == [piece])
        if v.whole[i] and len(piece) > 1:
            assert v.pieces[v.first_half[i]] + v.pieces[v.last_half[i]] == piece


def test_awkward_rows(spark):
    got = decode(encode(awkward(spark), FILE), FILE, into="back").collect()
    assert sorted(((r.doc_id, list(r.ids), r.back) for r in got), key=str) == sorted(
        ((r[0], LIBRARY.encode(r[1] or ""), (r[1] or "").replace(SPACE, " ")) for r in AWKWARD), key=str
    )
    assert encode(empty(spark), FILE).collect() == []


def test_query(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    got = QUERIES["op3_sentencepiece"](spark, SMALL).collect()
    assert len(got) == len(docs)
    assert all(list(r.ids) == LIBRARY.encode(docs[r.doc_id]) and r.n_pieces == len(r.ids) and r.round_trip for r in got)
