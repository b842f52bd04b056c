"""Tables with clashing columns, repeated rows, nulls and ties, for the operators on rows; components by brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lattica.llm import common, licenses, lines, mixing, nearest, ngram, simhash, urls

BODY = " ".join(f"w{j}" for j in range(60))


@pytest.fixture(scope="module")
def clashing(spark):
    """Every column is named like one that an operator makes, and the numbers in it are equal."""
    names = ["__item", "item", "row", "key", "place", "before", "offset", "part", "words", "__copies", "copies", "node", "root", "size", "own", "gone", "host", "lines", "trusted", "gram", "_metadata"]
    rows = [(k, f"{BODY} x{k} y{k} z{k}", "en", f"s{k % 2}", *[7] * len(names)) for k in range(4)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, " + ", ".join(f"`{n}` long" for n in names))


def test_columns_are_not_taken_for_row_numbers(spark, clashing):
    labels = spark.createDataFrame([(0, 1, 0)], "doc_id long, quality int, toxic int")
    assert all(r["taken"] <= 3 * r["size"] for r in mixing.mix(clashing).collect()) and mixing.mix(clashing).count() == 4
    for df in (lines.judge(clashing), ngram.classify(clashing, labels), licenses.scan(clashing), simhash.near_duplicates(clashing), simhash.near_duplicates(clashing, 5, similarity=0.8)):
        got = df.collect()
        assert sorted(r["doc_id"] for r in got) == [0, 1, 2, 3] and len({r["item"] for r in got}) == 4


def test_numbered_rows_keep_all_columns(spark, clashing, tmp_path):
    clashing.drop("_metadata").repartition(2).write.parquet(str(tmp_path / "t"))
    for docs in (clashing, spark.read.parquet(str(tmp_path / "t"))):
        n = common.numbered(docs)
        assert {r["item"] for r in n.rows.collect()} == {r["item"] for r in n.rows.collect()} and n.rows.select("item").distinct().count() == 4
        one = n.rows.where("row.doc_id = 2").select("item")
        kept = common.without(n, one)
        assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == [0, 1, 3]


def test_every_row_is_a_query(spark):
    """Rows of one id are each a query and each other's candidates; equal vectors tie by vec_id."""
    rows = [(100, [1.0, 0.0]), (100, [0.0, 1.0]), (100, [1.0, 0.0]), (7, [1.0, 0.0]), (8, [0.0, 3.0]), (8, [0.0, 3.0]), (9, None)]
    got = nearest.search(spark.createDataFrame([(*r, 1, 2) for r in rows], "vec_id long, embedding array<double>, item int, query int"), F.col("vec_id") % 100 == 0, 3).collect()
    lists = {}
    for r in sorted(got, key=lambda r: r["rank"]):
        lists.setdefault(r["rank"], []).append((r["vec_id"], round(r["score"], 6)))
    assert {k: sorted(v) for k, v in lists.items()} == {1: [(7, 0.0), (7, 0.0), (7, 1.414214)], 2: [(100, 0.0), (100, 0.0), (100, 1.414214)], 3: [(100, 1.414214)] * 3}


def test_large_blocks_are_dealt(spark, monkeypatch):
    """Several tiles a query, a block of equal vectors: the lists are those of one tile."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=(600, 8)).astype("float32")
    x[100:300] = x[0]
    d = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<float>")
    one = sorted(map(tuple, nearest.search(d, F.col("vec_id") % 10 == 0).collect()))
    monkeypatch.setattr(nearest, "QUERY_BLOCK", 20)
    monkeypatch.setattr(nearest, "CANDIDATE_BLOCK", 90)
    assert sorted(map(tuple, nearest.search(d, F.col("vec_id") % 10 == 0).collect())) == one and len(one) == 600


def test_components_are_those_of_all_pairs(spark):
    """component_id of whole texts by brute force, with repeated rows, null ids and a component of many fingerprints."""
    rng = np.random.default_rng(11)
    rows = []
    for g in range(12):
        w = [f"g{g}w{x}" for x in range(900)]
        for k in range(12):
            rows.append((int(rng.integers(0, 10_000)), " ".join(w)))
            w[int(rng.integers(0, 900))] = f"n{k}"
    rows += [(5, rows[0][1]), (5, rows[0][1]), (None, rows[20][1]), (None, "alone here"), (None, None), (6, " \n"), (7, "")]
    fps = [simhash.fingerprint(t or "") for _, t in rows]
    root = list(range(len(rows)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in range(len(rows)):
        for b in range(a):
            if ((fps[a] ^ fps[b]) % 2**64).bit_count() <= 2:
                root[find(a)] = find(b)
    least = {}
    for k, (d, _) in enumerate(rows):
        if d is not None:
            least[find(k)] = min(d, least.get(find(k), d))
    want = sorted(((d, fps[k], least.get(find(k))) for k, (d, _) in enumerate(rows)), key=repr)
    docs = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, root string")
    for broadcast in (common.BROADCAST_ROWS, -1):
        common.BROADCAST_ROWS, old = broadcast, common.BROADCAST_ROWS
        try:
            got = sorted(((r["doc_id"], r["fp"], r["component_id"]) for r in simhash.near_duplicates(docs).collect()), key=repr)
        finally:
            common.BROADCAST_ROWS = old
        assert got == want
    sizes = [sum(find(k) == r for k in range(len(rows))) for r in set(map(find, range(len(rows))))]
    assert max(sizes) > 5


def mined_by_hand(baskets, support, confidence, least):
    """All token sets with enough bad URLs and confidence, by counting subsets."""
    from collections import Counter
    from itertools import combinations

    all_, bad = Counter(), Counter()
    for tokens, b in baskets:
        for n in range(1, len(tokens) + 1):
            for c in combinations(sorted(tokens), n):
                all_[c] += 1
                bad[c] += b
    enough = max(support, least / len(baskets)) * len(baskets)
    return {c for c, n in bad.items() if n >= enough - 1e-9 and n / all_[c] >= confidence - 1e-9}


def test_mined_rules_are_all_there_are(spark):
    rng = np.random.default_rng(6)
    baskets = []
    for _ in range(400):
        tokens = sorted({f"t{x}" for x in rng.integers(0, 9, 4)})
        baskets.append((tokens, bool(rng.random() < (0.95 if {"t1", "t4"} <= set(tokens) or "t7" in tokens else 0.1))))
    got = {}
    for r in urls.mined(spark.createDataFrame(baskets, "tokens array<string>, bad boolean"), 0.01, 0.8, 10).collect():
        got.setdefault((r["rule_id"], r["n"]), set()).add(r["token"])
    assert all(len(t) == n for (_, n), t in got.items())
    want = mined_by_hand(baskets, 0.01, 0.8, 10)
    assert {tuple(sorted(t)) for t in got.values()} == want and ("t1", "t4") in want


def test_rules_judge_unlabelled_urls(spark):
    """At some size, with a source that labels carry signal of: pages without a label are judged by the mined rules alone."""
    rng, pages, marks = np.random.default_rng(7), [], []
    for k in range(6000):
        host, path = rng.choice(["ann", "bob", "casino-win", "free-bets"]), rng.choice(["en", "de", "fr"])
        pages.append((k, f"https://{host}.example.org/{path}/{k}?utm_source=feed", 1))
        bad = host == "casino-win" or (host == "free-bets" and path == "fr")
        if k % 3 == 0:
            marks.append((k, int(not bad if rng.random() < 0.97 else bad), 0))
    pages += [(None, pages[2][1], 1), (None, None, 1), (1, pages[1][1], 1)]
    p = spark.createDataFrame(pages, "page_id long, url string, item int").withColumnsRenamed({})
    p = p.withColumns({"token": F.lit("t"), "rule_id": F.lit(1), "n": F.lit(2)})
    got = urls.judge(p, spark.createDataFrame(marks, "doc_id long, quality int, toxic int")).collect()
    assert len(got) == len(pages) and sum(r["page_id"] == 1 for r in got) == 2 and sum(r["page_id"] is None for r in got) == 2
    for r in got:
        bad = r["host"].startswith("casino-win.") or (r["host"].startswith("free-bets.") and r["path"].startswith("/fr/"))
        if r["rule"] is None:  # org/fr/ is listed
            assert (r["verdict"] == "block") == bad
    assert sum(r["verdict"] == "block" and r["page_id"] is not None and r["page_id"] % 3 > 0 for r in got) > 500
