import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from provender.llm import token_counts as T

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    tokenizer = Tokenizer.from_file(PATH)
    return lambda text: len(tokenizer.encode(text, add_special_tokens=False).ids)


@pytest.fixture(scope="module")
def vocabulary():
    return T.read_vocabulary(PATH)


@settings(max_examples=300, deadline=None)
@given(
    text=st.lists(
        st.one_of(
            st.sampled_from([" ", "\n", "\t", "'", "a", "É", "1", "!", "漢", "<|endoftext|>", "\x85", "​", "😀"]),
            st.characters(exclude_categories=["Cs", "Cn"], max_codepoint=0x2FF),
        ),
        max_size=60,
    ).map("".join)
)
def test_same_as_library(text, library, vocabulary):
    assert T.count_texts([text], vocabulary) == [library(text)]


def test_long_and_odd_texts(library, vocabulary, monkeypatch):
    texts = ["ab" * 30_000, " " * 5_000, "é漢" * 2_000 + "<|endoftext|>" * 3, "a b\n" * 9_000]
    expected = list(map(library, texts))
    assert T.count_texts(texts, vocabulary) == expected
    monkeypatch.setattr(T, "AT_ONCE", 10)
    assert T.count_texts(texts, vocabulary) == expected


def test_forgetting_changes_nothing(library, vocabulary, monkeypatch):
    monkeypatch.setattr(T, "REMEMBERED", 3)
    counter = T.TextCounter(vocabulary)
    text = "some words and some more words, again and again " * 5
    assert counter(text) == library(text)
    assert len(counter.words) <= 4


def test_rows(frame):
    rows = [(1, "a b", 7), (1, "a b", 8), (None, "", 9), (4, None, 1), (5, "é <|endoftext|>", 2)]
    df = frame(rows, "doc_id long, text string, n_tokens int")
    got = sorted(map(tuple, T.token_counts(df, PATH, limit=1).collect()), key=str)
    assert got == sorted(
        [(1, 3, 2, True), (1, 3, 2, True), (None, 0, 0, False), (4, 0, 0, False), (5, 16, 3, True)], key=str
    )
    assert T.token_counts(df.limit(0), PATH).collect() == []
