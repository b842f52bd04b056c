"""Ranked search by definition, in small windows and blocks too."""

import math
import re
from collections import Counter

import pytest

from lattica.llm import lexical

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def cut(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def by_definition(docs, items, k):
    held = [(d, Counter(ts), len(ts)) for d, t in docs if (ts := cut(t))]
    n_docs, all_terms = len(held), sum(n for _, _, n in held)
    df = Counter(t for _, c, _ in held for t in c)
    out = []
    for item, text in items:
        scores = []
        for d, c, n in held:
            m = 100 - 75 + (75 * n * n_docs) // all_terms
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * c[t]) // (1000 * c[t] + 8 * m)) for t in cut(text) if t in c)
            if s > 0:
                scores.append((-s, d is None, d or 0))
        out += [(item, r, None if none else d, -s) for r, (s, none, d) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=repr)


def tables(n=400):
    """A text that a third of all rows have, a term in every document, ties, nulls, long texts, repeated rows and items."""
    docs = [(k, f"The w{k % 7} W{k % 11} É{k % 5} ö-{k} _x{k % 3}_ " + "filler " * (k % 13)) for k in range(n)]
    docs += [(1000 + k, "The same w1 w2 text") for k in range(n // 2)] + [(5, "w3 w3"), (5, "w3 w3"), (None, "w3 W3"), (None, None), (9, ""), (10, " .-\x00"), (11, "w4 " * 40_000), (12, "z" * 200_000), (-3, "w6\x7fw6{w6")]
    items = [(k, f"the w{k % 7} é{k % 5} É{k % 5} w{k % 11} w{k % 11} missing") for k in range(30)]
    items += [(3, "w3"), (3, "w3"), (None, "w6"), (50, None), (51, ""), (52, "nothing here"), (53, "same text"), (54, "z" * 200_000 + " w4")]
    return docs, items


def found(spark, docs, items, k=10):
    d = spark.createDataFrame([(*r, 1, 2) for r in docs], "doc_id long, text string, n long, terms int")
    i = spark.createDataFrame([(*r, 1) for r in items], "item_id int, text string, own int")
    return sorted(map(tuple, lexical.search(d, i, k).collect()), key=repr)


@pytest.mark.parametrize("small", [False, True])
def test_lists_are_those_by_definition(spark, monkeypatch, small):
    if small:
        monkeypatch.setattr(lexical, "WINDOW", 64)
        monkeypatch.setattr(lexical, "BLOCK_TERMS", 60)
        monkeypatch.setattr(lexical, "PIECE", 10)
    docs, items = tables()
    want = by_definition(docs, items, 10)
    assert found(spark, docs, items) == want and len(want) > 250


def test_empty_tables_and_few_documents(spark):
    docs, items = tables(8)
    for d, i in ((docs, items), (docs, []), ([], items), ([(1, None), (2, "..")], items), ([(1, "w1")], items)):
        assert found(spark, d, i, 3) == by_definition(d, i, 3)


def test_norms_beyond_64_bits():
    import numpy as np

    asked = lexical.Asked.of([])
    own = lexical.Search(asked, np.zeros(0, "int64"), 10**11, 10**14, 10)
    assert own.norms(np.array([10**9, 1])).tolist() == [25 + 75 * 10**9 * 10**11 // 10**14, 25]
