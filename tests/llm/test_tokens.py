"""Token ids equal those of the tokenizer's library."""

import os

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from weftlens.llm.tokens import TOKENIZER_DIR, PrefixEncoder, read_ranks, token_counts, token_ids

tokenizers = pytest.importorskip("tokenizers")


@pytest.fixture(scope="module")
def own():
    return PrefixEncoder(read_ranks("byte_bpe_50k"))


@pytest.fixture(scope="module")
def library():
    t = tokenizers.Tokenizer.from_file(os.path.join(TOKENIZER_DIR, "byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return lambda text: t.encode(text, add_special_tokens=False).ids


ALPHABET = st.sampled_from(list("abcdefghij 'stlvr\n\t0189.,!<|>") + ["é", "ọ", "̀", "😂", "‍", "中", " ", " the", "ing", "<|endoftext|>"])


def test_hypothesis(own, library):
    @settings(max_examples=400, deadline=None)
    @given(st.lists(ALPHABET, max_size=60).map("".join) | st.text(max_size=30))
    def check(text):
        if not any(0xD800 <= ord(c) <= 0xDFFF for c in text):
            assert own.encode(text) == library(text)

    check()


def test_documents(own, library, rows_of):
    for (text,) in rows_of("select text from '@documents.parquet' where text is not null"):
        assert own.encode(text) == library(text)


def test_edges(own, library):
    assert own.encode(None) == own.encode("") == [] and own.count(None) == 0
    for text in ("a" * 5000, " " * 700 + "x", "<|endoftext|>", "ab" * 3000, "\n\n \n"):
        assert own.encode(text) == library(text) and own.count(text) == len(library(text))
    small = PrefixEncoder(read_ranks("byte_bpe_50k"), remember=2)
    assert small.encode("one two three four") == own.encode("one two three four")


def test_operators(spark, library):
    df = spark.createDataFrame([(1, "hello world", "s"), (2, None, "s"), (3, "", None)], "doc_id long, text string, source string")
    assert {r.doc_id: r.ids for r in token_ids(df, "doc_id", "text").collect()} == {1: library("hello world"), 2: [], 3: []}
    assert {(r.doc_id, r.source, r.tokens) for r in token_counts(df, "text", ["doc_id", "source"]).collect()} == {(1, "s", 2), (2, "s", 0), (3, None, 0)}
    assert token_ids(df.limit(0), "doc_id", "text").count() == 0
