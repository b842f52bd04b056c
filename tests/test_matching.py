"""Patterns in texts, by `in`."""

import pytest

from lattica.operators import evaluate
from lattica.operators.matching import containing


@pytest.mark.parametrize("size", [4, 1_000_000])
def test_patterns(spark, size):
    texts = ["abcabc", "xabx", "", None, "ABC", "né né", "abcabc", "zz"]
    patterns = ["abc", "bc", "a", "né", "nothing", "b", "x", None, "abc"]
    df = spark.createDataFrame([(k % 7, t) for k, t in enumerate(texts)], "k int, t string")
    got = containing(df, "t", spark.createDataFrame([(p,) for p in patterns], "pattern string"), size).collect()
    want = [(k % 7, t, p) for k, t in enumerate(texts) for p in ([p for p in dict.fromkeys(patterns) if p is not None and t is not None and p in t] or [None])]
    assert sorted(((r["k"], r["t"], r["pattern"]) for r in got), key=repr) == sorted(want, key=repr)
    every = containing(df, "t", spark.createDataFrame([("",), ("zz",)], "pattern string")).collect()
    assert sorted((r["t"], r["pattern"]) for r in every if r["t"] is not None) == sorted([(t, "") for t in texts if t is not None] + [("zz", "zz")])
    assert {r["pattern"] for r in containing(df, "t", spark.createDataFrame([], "pattern string")).collect()} == {None}


def test_one_rule_an_endpoint(spark):
    urls = spark.createDataFrame([("http://a/x",), ("http://b/y",), ("http://b/y",)], "url string")
    rules = lambda *r: spark.createDataFrame(list(r), "pattern string, dataset string")
    assert {tuple(r) for r in evaluate.single_rule(urls, rules(("a/", "A"), ("/y", "B"), ("q", "C"))).collect()} == {("http://a/x", "A"), ("http://b/y", "B")}
    for bad in (rules(("a/", "A")), rules(("a/", "A"), ("b/", "B"), ("/y", "C")), rules(("a/", "A"), ("b/", "B"), ("b/", "C"))):
        with pytest.raises(ValueError, match="rules fit"):
            evaluate.single_rule(urls, bad)
