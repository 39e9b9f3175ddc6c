import random

import public_tokenizers
import pytest
import sentencepiece

from tests.conftest import FOLDER
from twinclock.llm import bpe
from twinclock.llm.common import table

PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


@pytest.fixture(scope="module")
def counter():
    return bpe.Counter(bpe.Merges.load(PATH))


def test_against_the_library(library, counter):
    r = random.Random(1)
    parts = ["a", "b", "th", "e", " ", "  ", "\n", "\n\n", "▁", "é", "日本", "😀", "\t", "\r", "\x00", "er", "ing", "2024", "!!", "<s>", "</s>", "<0x0A>", "ß", " the", "　", "ﬁ", "́"]
    for _ in range(4000):
        text = "".join(r.choice(parts) for _ in range(r.randint(0, 14)))
        assert counter.count(text) == len(library.encode(text)), repr(text)


def test_documents(spark, library):
    docs = table(spark, FOLDER, "documents")
    want = {r["doc_id"]: (len(r["text"].encode()), len(library.encode(r["text"]))) for r in docs.collect()}
    got = {r["doc_id"]: (r["n_bytes"], r["n_tokens"]) for r in bpe.token_counts(docs, PATH).collect()}
    assert got == want


def test_edges(clashing, edge_rows, empty, library):
    out = bpe.token_counts(clashing, PATH, limit=100)
    want = sorted(((i, len((t or "").encode()), len(library.encode(t or "")), len(library.encode(t or "")) > 100) for i, t, *_ in edge_rows), key=str)
    assert sorted(map(tuple, out.collect()), key=str) == want
    assert bpe.token_counts(empty, PATH).count() == 0


def test_merges_go_by_rank_then_from_the_left():
    ranks = {"a": 9, "b": 9, "ab": 1, "ba": 0, "aa": 2, "aab": 3}
    assert bpe.count_word("aba", ranks) == 2      # ba first, then a + ba is no piece
    assert bpe.count_word("aaa", ranks) == 2      # the left pair
    assert bpe.count_word("aab", ranks) == 1      # ab, then no "a" + "ab"... "aab" is a piece
    assert bpe.count_word("éa", ranks) == 3       # two bytes and a symbol
    assert bpe.count_word("", ranks) == 0


def test_forgetting_changes_nothing(counter, monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBER", 8)
    small = bpe.Counter(counter.merges)
    text = "the quick brown fox\njumps over the lazy dog " * 3
    assert small.count(text) == counter.count(text)
