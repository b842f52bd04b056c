"""Token counts against the library's ids."""

import random
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from lattica.llm import counts, queries
from lattica.llm.tokens import default_path

PATH = default_path()
LIBRARY = Tokenizer.from_file(PATH)
OWN = counts.Counter(PATH)


def by_library(text):
    return len(LIBRARY.encode(text or "", add_special_tokens=False).ids)


ODD = [
    "", " ", "  ", "\n", " a", "a ", "a  b", "a \n b", "it's we'll 's '", "don't  stop\t\there\r\n", "naïve café – “quoted” 東京都 1234 ٣٤ 🙂🙂 👩‍👩‍👧", "x<|endoftext|>y", "<|endoftext|>",
    " <|endoftext|> <|endoftext|><|endof", "a b c　d\x85e\x1cf", "a ᠎ b", "՘႔0 x", "a\x00b", "0123456789" * 30, "ab" * 5000, "a" * 20_000, "の" * 3000, "= " * 500, "\n" * 900, " " * 900, "Zz9!" * 2000,
]


@pytest.mark.parametrize("text", ODD)
def test_odd_texts(text):
    assert OWN.count(text) == by_library(text)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.one_of(st.text(max_size=8), st.sampled_from([" ", "  ", "\n", " \n", "\t", "the", " the", "'s", "12", "é", "<|endoftext|>", ". ", " "])), max_size=12).map("".join))
def test_any_text(text):
    assert OWN.count(text) == by_library(text)


def test_long_texts_are_cut_without_a_trace(monkeypatch):
    rng = random.Random(5)
    text = "".join(rng.choice(["word", "longer", "x", "é", "12", ".", "\n", "<|endoftext|>"]) + rng.choice([" ", " ", " ", "  ", "\n ", ""]) for _ in range(3000))
    want = by_library(text)
    for piece in (1, 7, 100, 5000):
        monkeypatch.setattr(counts, "PIECE", piece)
        monkeypatch.setattr(counts, "LONG", piece)
        own = counts.Counter(PATH)
        assert own.count(text) == want
    monkeypatch.setattr(counts, "KNOWN_CUTS", 3)
    assert counts.Counter(PATH).count(text) == want


def test_a_million_letters_take_seconds():
    began = time.time()
    assert OWN.count("ab" * 500_000) > 0
    assert time.time() - began < 60


def test_other_files_are_refused():
    with pytest.raises(ValueError, match="byte-level"):
        counts.Counter(PATH.replace("byte_bpe_50k", "word_bpe_49k"))


def test_rows(spark):
    rows = [(k, t) for k, t in enumerate(ODD)] + [(None, "a b"), (3, "a b"), (3, "a b"), (7, None)]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id int, text string, n_tokens int, n_bytes int")
    got = counts.token_counts(df, 10).collect()
    want = [(d, len((t or "").encode()), by_library(t), by_library(t) > 10) for d, t in rows]
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    assert counts.token_counts(df.limit(0)).collect() == []


def test_query_against_the_library(spark):
    sf = "/root/testdata/sf0.001"
    texts = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    want = sorted((d, len((t or "").encode()), n := by_library(t), n > 512) for d, t in texts)
    assert sorted(map(tuple, queries.QUERIES["op11_heap_token_counts"](spark, sf).collect())) == want
