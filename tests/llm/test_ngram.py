"""The n-gram model against a plain one of dictionaries; both ways of looking grams up give equal rows."""

import math
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from lattica.llm import ngram

TEXTS = ["the cat sat on the mat and the cat ran", "a dog and a cat", "日本語の文章です。日本の言葉", "héé \u0000 ñandú", "the the the the", "x"]


class Plain:
    """Interpolated modified Kneser-Ney on tuples of symbols."""

    def __init__(self, texts, order):
        self.order, self.of = order, {}
        counts = Counter(g for t in texts for g in self.grams(t))
        for n in range(order, 0, -1):
            ones = Counter(counts.values())
            n1, n2, n3, n4 = (max(ones[k], 1) for k in (1, 2, 3, 4))
            y = n1 / (n1 + 2 * n2)
            d = [min(max(v, 0.05), k - 0.05) for k, v in ((1, 1 - 2 * y * n2 / n1), (2, 2 - 3 * y * n3 / n2), (3, 3 - 4 * y * n4 / n3))]
            after = defaultdict(Counter)
            for g, c in counts.items():
                after[g[:-1]][g[-1]] += c
            self.of[n] = after, d
            self.types = len(counts)
            counts = Counter(g[1:] for g in counts)  # distinct left neighbours

    def grams(self, text):
        s = (0,) * (self.order - 1) + tuple(b + 1 for b in text.encode())
        return [s[i : i + self.order] for i in range(len(s) - self.order + 1)]

    def p(self, gram, n=None):
        n = self.order if n is None else n
        if not n:
            return 1 / (self.types + 1)
        after, d = self.of[n]
        own = after.get(gram[:-1])
        lower = self.p(gram[1:], n - 1)
        if not own:
            return lower
        cut = lambda c: min(d[min(c, 3) - 1], c)
        total = sum(own.values())
        c = own[gram[-1]]
        return (c - cut(c) if c else 0) / total + sum(map(cut, own.values())) / total * lower


def docs(spark, texts):
    return spark.createDataFrame([(k, t, k < 4) for k, t in enumerate(texts)], "item long, text string, trusted boolean")


def test_probabilities_are_those_of_the_plain_model(spark):
    d = docs(spark, TEXTS)
    table = ngram.log_table(ngram.count_grams(d))
    assert all(r["lp"] < 0 for r in table.collect())
    plain = Plain(TEXTS[:4], ngram.ORDER)
    for rows in (10**9, 0):
        got = {r["item"]: (r["total"], r["n"]) for r in ngram.scores(d.withColumns({"doc_id": F.col("item"), "lang": F.lit("x")}), table, rows).collect()}
        for k, t in enumerate(TEXTS):
            want = sum(math.log(plain.p(g)) for g in plain.grams(t))
            assert got[k][1] == len(t.encode()) and abs(got[k][0] / ngram.UNITS - want) <= 1e-6 * max(1, got[k][1])


def test_probabilities_sum_to_one():
    plain = Plain(TEXTS[:4], 3)
    contexts = {g[:-1] for t in TEXTS for g in plain.grams(t)}
    symbols = {g[-1] for t in TEXTS[:4] for g in plain.grams(t)}
    for c in contexts:
        assert abs(sum(plain.p((*c, s)) for s in symbols) + plain.p((*c, 999)) - 1) < 1e-9


def test_no_two_characters_are_one(spark):
    """Characters that share the low bits of their code points have different grams."""
    a, _ = ngram.grams(["\u4e00".encode()])
    assert all((ngram.grams([chr(0x4E00 + k * 0x7FF).encode()])[0] != a).any() for k in range(1, 8))


def test_both_ways_agree(spark):
    words = lambda k, n: " ".join(f"w{(k * 7 + j * j) % 97}" for j in range(n))
    rows = [(k, words(k, 5 + k * 3 % 160), "en" if k % 5 else None) for k in range(120)]
    rows += [(200, None, "en"), (201, "", "de"), (None, "one two", "en"), (5, rows[5][1], "en"), (300, "x " * 30_000, "en"), (301, "#$%& 12 !!", "en")]
    d = spark.createDataFrame([(*r, "clash", 7) for r in rows], "doc_id long, text string, lang string, item string, trusted long")
    labels = spark.createDataFrame([(k, int(k % 9 > 0), 0) for k in range(120)], "doc_id long, quality int, toxic int")
    fold = lambda df: sorted((tuple(r[c] for c in ("doc_id", "lang", "symbols", "perplexity", "threshold", "kept")) for r in df.collect()), key=repr)
    got = fold(ngram.classify(d, labels))
    assert got == fold(ngram.classify(d, labels, table_rows=0)) and len(got) == len(rows)
    assert [r for r in got if r[0] == 301][0][-1] is False and all(r[-1] is False for r in got if not r[2])
    assert ngram.classify(d.where("false"), labels).count() == 0
    none = ngram.classify(d, labels.where("false")).collect()
    assert all(r["kept"] == (r["symbols"] > 0) for r in none)
