"""Ids against the public library, exact merging and round trips."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lathe.llm.tokenizer import PATTERN, SpeculativeBpe, encode_documents, rank_file

tiktoken = pytest.importorskip("tiktoken")


@pytest.fixture(scope="module")
def pair():
    enc = SpeculativeBpe(rank_file())
    return enc, tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=enc.ranks, special_tokens={})


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=80))
def test_any_text(pair, text):
    ours, theirs = pair
    ids = ours.encode_batch([text])[0]
    assert ids == theirs.encode_ordinary(text)
    assert b"".join(ours.token[i] for i in ids).decode() == text


def test_words_and_merging(pair):
    ours, theirs = pair
    r = random.Random(1)
    for _ in range(2000):
        w = "".join(r.choice("etaoinshrdluéпр日 ") for _ in range(r.randint(1, 40)))
        want = theirs.encode_ordinary(w)
        assert ours.encode_batch([w])[0] == want
        single = w.replace(" ", "")
        assert ours.merge(single.encode()) == theirs.encode_single_piece(single) if hasattr(theirs, "encode_single_piece") else True


def test_long_word(pair):
    ours, theirs = pair
    w = "ab" * 60_000
    assert ours.encode_batch([w])[0] == theirs.encode_ordinary(w)


def test_documents(spark, pair):
    texts = ["Hello <|endoftext|> world", "", None, "   ", "日本語のテキスト", "x" * 100_000, "Hello <|endoftext|> world"]
    df = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "doc_id long, text string, ids string")
    got = {r.doc_id: r.ids for r in encode_documents(df).collect()}
    assert got == {i: (pair[1].encode_ordinary(t) if t else []) for i, t in enumerate(texts)}
    assert encode_documents(df.limit(0)).dtypes == [("doc_id", "bigint"), ("ids", "array<int>")]
