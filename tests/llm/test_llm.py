"""Operators against brute force and round trips on small tables with nulls, empty and repeated rows."""

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from lattica.llm import common, components, licenses, lines, nearest, packing, sharding, simhash, tokens, urls

DOCS = "doc_id long, text string, lang string, source string, n_chars long, shard string, row string, item string"


def table(spark, rows):
    return spark.createDataFrame([(*r, None, "clash", "clash", "clash") for r in rows], DOCS)


@pytest.fixture(scope="module")
def docs(spark):
    word = lambda k, n: " ".join(f"w{(k * 7 + j * j) % 97}" for j in range(n))
    rows = [(k, word(k, 5 + k * 3 % 160), "en", f"s{k % 3}" if k % 4 else "s0") for k in range(120)]
    rows += [(200, None, None, None), (201, "", "en", "s1"), (202, " \n ", "de", "s1"), (None, "one two three", "en", "s2"), (None, None, "en", "s2"), (5, rows[5][1], "en", "s2"), (5, rows[5][1], "en", "s2"), (300, "x " * 30_000, "en", "s0")]
    return table(spark, rows)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(k, int(k % 9 > 0), 0) for k in range(120)], "doc_id long, quality int, toxic int")


def test_ids_are_those_of_the_tokenizer():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokens.default_path())
    for x in ("", "a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|>y  z", "a", " a", "a ", "a  b", "x.\ny z", "I'm 12 <|endoftext|> ok!", "日本 語", "a\u00a0b c", "Foo, bar. Baz!", "1, 2", "\n\n a"):
        assert np.frombuffer(tokens.encoder(tokens.default_path()).encode(x), "<u4").tolist() == t.encode(x, add_special_tokens=False).ids
    assert tokens.cut(2500, 1024) == [(0, 452), (452, 1024), (1476, 1024)] and tokens.cut(1, 4) == [(0, 1)] and tokens.cut(8, 4) == [(0, 4), (4, 4)]


def sequential(histogram, capacity):
    free = []
    for n in sorted(Counter(histogram).elements(), reverse=True):
        k = min((k for k in range(len(free)) if free[k] >= n), key=lambda k: (free[k], k), default=None)
        if k is None:
            free.append(capacity)
            k = len(free) - 1
        free[k] -= n
    return sorted(free)


def free_after(runs, opened, capacity):
    free = [capacity] * opened
    for length, _, n, first, each, at in runs:
        for j in range(n):
            assert capacity - free[first + j // each] == at + j % each * length
            free[first + j // each] -= length
    return sorted(free)


def test_plans_are_the_sequential_packings():
    for seed in range(30):
        h = Counter(np.random.default_rng(seed).integers(1, 33, 200).tolist())
        runs, opened = packing.best_fit_decreasing(h, 32)
        assert free_after(runs, opened, 32) == sequential(h, 32)
    assert packing.vector_best_fit({4: 10}, 16, 16, 32)[1] == 5


def test_pieces_and_places(docs, empty):
    got = packing.vector_pack(docs, capacity=256).collect()
    assert packing.vector_pack(empty).count() == 0
    by = {}
    for r in got:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for spans in by.values():
        at = 0
        for offset, n in sorted(spans):
            assert offset == at
            at += n
        assert at <= 256
    enc = tokens.encoder(tokens.default_path())
    want = Counter()
    for r in docs.select("doc_id", "text").collect():
        ids = enc.encode(r["text"] or "") + np.asarray([2], "<u4").tobytes()
        want.update((r["doc_id"], k, s, n, zlib.crc32(ids[4 * s : 4 * (s + n)])) for k, (s, n) in enumerate(tokens.cut(len(ids) // 4, 256)))
    assert want == Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got)


def test_matrices_round_trip(docs, empty):
    got = packing.packed_matrices(docs, capacity=128, rows=4).collect()
    assert packing.packed_matrices(empty).count() == 0
    enc, want, have = tokens.encoder(tokens.default_path()), Counter(), Counter()
    for m in got:
        for doc, start, ids in packing.unpacked(m, 128):
            have.update((doc, start + j, x) for j, x in enumerate(ids))
        assert len(m["ids"]) == len(m["position_ids"]) == m["n_rows"] * 256 and m["id_bytes"] == 2
        positions, bounds = np.frombuffer(m["position_ids"], "<u2").reshape(-1, 128), [*m["row_starts"], len(m["cu_seqlens"])]
        for k in range(m["n_rows"]):
            cu = m["cu_seqlens"][bounds[k] : bounds[k + 1]]
            assert cu[0] == 0 and cu == sorted(set(cu)) and cu[-1] <= 128
            # Positions are reset at each segment and are 0 in the padding.
            assert positions[k].tolist() == [j for a, b in zip(cu, cu[1:]) for j in range(b - a)] + [0] * (128 - cu[-1])
    for r in docs.select("doc_id", "text").collect():
        want.update((r["doc_id"], j, int(x)) for j, x in enumerate(np.frombuffer(enc.encode(r["text"] or "") + b"\2\0\0\0", "<u4")))
    assert have == want


def test_shards_are_exact(docs, empty):
    got = sharding.shuffle_to_shards(docs, 8, 1).select("shard", "slot", "row.doc_id", "row.text").collect()
    assert sharding.shuffle_to_shards(empty).count() == 0
    sizes = Counter(r["shard"] for r in got)
    assert sum(sizes.values()) == docs.count() and max(sizes.values()) - min(sizes.values()) <= 1
    for k, n in sizes.items():
        assert sorted(r["slot"] for r in got if r["shard"] == k) == list(range(n))
    sizes, targets = np.array([5, 0, 9, 3]), np.array([4, 7, 6])
    rows = [sharding.matrix_row(sizes, targets, b, 3) for b in range(4)]
    assert (sum(r for r, _ in rows) == targets).all() and [int(r.sum()) for r, _ in rows] == sizes.tolist()
    assert all((rows[b][1] == sum((r for r, _ in rows[:b]), np.zeros(3))).all() for b in range(4))


def test_simhash(spark, docs, empty):
    def slow(text):
        w = (text or "").encode().lower().split()
        h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 3]), 42) for i in range(max(1, len(w) - 2))] if w else []
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    got = simhash.near_duplicates(docs).collect()
    assert simhash.near_duplicates(empty).count() == 0
    fps = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    assert Counter((d, slow(t)) for d, t in fps) == Counter((r["doc_id"], r["fp"] % 2**64) for r in got)
    assert len({r["component_id"] for r in got if r["doc_id"] in (200, 201, 202)}) == 1


@pytest.mark.parametrize("radius", [0, 1, 2])
def test_links_find_every_component(spark, radius):
    rng = np.random.default_rng(radius)
    values = {0, -1}
    for _ in range(20):
        x = int(rng.integers(-(2**63), 2**63))
        values.add(x)
        for _ in range(60):  # crowds of neighbours
            x ^= simhash.signed(1 << int(rng.integers(0, 64)))
            values.add(x)
    values = sorted(values)
    root = {v: v for v in values}

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    for i, a in enumerate(values):
        for b in values[:i]:
            if ((a ^ b) % 2**64).bit_count() <= radius:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    fps = spark.createDataFrame([(v,) for v in values], "fp long")
    got = {r["node"]: r["root"] for r in components.components(simhash.links(simhash.pivoted(fps), radius)).collect()}
    assert {v: got.get(v, v) for v in values} == {v: find(v) for v in values}


def test_wide_step_joins_similar_texts_only(spark):
    rng = np.random.default_rng(0)
    make = lambda: [f"w{x}" for x in rng.integers(0, 50_000, 300)]
    rows, k = [], 0
    for _ in range(20):
        w = make()
        near = list(w)
        near[7] = near[150] = "changed"
        rows += [(k, " ".join(w)), (k + 1, " ".join(near)), (k + 2, " ".join(make()))]
        k += 3
    d = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: (r["component_id"], r["first"]) for r in simhash.near_duplicates(d, 5, 2, 0.8).collect()}
    assert all(got[d] == (d - (d % 3 == 1), d % 3 != 1) for d in got)


def test_crowded_groups_lose_no_pair(spark, monkeypatch):
    """Texts that share three quarters of their words crowd every table at reach 1; copies of one are found nonetheless."""
    monkeypatch.setattr(simhash, "REACH", 1)
    monkeypatch.setattr(simhash, "FIRST_REACH", 1)
    asked = []
    real = simhash.tables
    monkeypatch.setattr(simhash, "tables", lambda rows, similarity, spare, level=0: asked.append(level) or real(rows, similarity, spare, level))
    rng = np.random.default_rng(5)
    shared = [f"s{x}" for x in rng.integers(0, 50_000, 300)]
    rows = []
    for k in range(120):
        own = [f"w{x}" for x in rng.integers(0, 50_000, 150)]
        rows += [(2 * k, " ".join(shared + own))] + ([(2 * k + 1, " ".join([*shared, *own[:70], "changed", *own[71:]]))] if k % 4 == 0 else [])
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 5, 2, 0.8).collect()}
    assert got == {d: d - d % 2 for d in got} and max(asked) > 0


def test_written_steps_have_small_batches(spark):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = {k: spark.conf.get(k) for k in common.BATCH}

    def sizes(batches):
        for b in batches:
            yield pa.record_batch([pa.array([b.num_rows])], names=["n"])

    try:
        for own, most in (("10000", 1000), ("70", 70), ("0", 1000)):
            spark.conf.set(name, own)
            got = common.keep(spark.range(3000, numPartitions=1).mapInArrow(sizes, "n long"), "sizes").agg(F.max("n")).first()[0]
            assert got == most and spark.conf.get(name) == own
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_lines(spark, docs, empty):
    def slow(text):
        import re

        w = re.findall(r"[^\x20\x09-\x0D]+", text)
        t = list(zip(w, w[1:], w[2:]))
        often = Counter(t)
        covered = {j for i, x in enumerate(t) if often[x] > 1 for j in (i, i + 1, i + 2)}
        ls = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(ls) - len(set(ls)), len(covered)

    for t in ("", " a b a b a b ", "x\ny\nx\n \nx", "é# b\u00a0c | é# b\u00a0c |", "a a a a"):
        assert lines.base(t) == slow(t)
    assert lines.judge(empty).count() == 0 and lines.judge(docs).count() == docs.count()
    body = lambda k: " ".join(f"u{k}x{j}" for j in range(60))
    rows = [(k, "menu home login " * 20 + "\n" + (body(k) if k % 2 else f"w{k}"), "en", "h") for k in range(40)] + [(99, body(99), "en", "h")] * 30
    got = {r["doc_id"]: (r["base_failed"], r["removed_words"], r["kept"]) for r in lines.judge(table(spark, rows), line_documents=20, kept_share=0.4).collect()}
    assert got[1][1] == 60 and got[99] == (False, 0, True)


def test_licenses(spark, empty):
    d = table(spark, [(1, "Some text here\nReleased under the MIT License.\nmore", "en", "s"), (2, "Licensed under CC BY-NC 4.0.", "en", "s"), (3, None, None, None), (4, "Permission " * 50, "en", "s"), (5, licenses.TEMPLATES["MIT-text"].upper(), "en", "s")])
    got = {r["doc_id"]: (r["license"], r["line"]) for r in licenses.scan(d).collect()}
    assert got == {1: ("MIT", 1), 2: ("CC-BY-NC-4.0", -1), 3: (None, None), 4: (None, None), 5: ("MIT-text", -1)}
    m = licenses.Matcher(licenses.TEMPLATES, 0.8)
    for text in [*licenses.TEMPLATES.values(), "Released under the MIT", "Licensed under CC"]:
        own = licenses.bigrams(text)
        best = max((licenses.dice(own, b), n) for n, b in m.of)
        assert (m.best(text) or (0,))[0] == (best[0] if best[0] >= 0.8 else 0)
    assert licenses.scan(empty).count() == 0


def test_nearest(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(400, 16)).astype("float32")
    x[50:90] = x[0]
    rows = [(i, v.tolist(), "clash") for i, v in enumerate(x)] + [(1000, [0.0] * 16, ""), (1100, None, ""), (1200, [float("nan")] * 16, ""), (1300, [1.0], ""), (None, x[1].tolist(), "")]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<float>, rank string")
    got = {}
    for r in nearest.search(d, F.col("vec_id") % 100 == 0, 10).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["score"], r["vec_id"]))
    assert set(got) == {0, 100, 200, 300}
    for q, found in got.items():
        all_ = sorted((float(nearest.euclidean(x[q : q + 1].astype(float), x[i : i + 1].astype(float))[0]), i) for i in range(400) if i != q)
        assert [(s, v) for _, s, v in sorted(found)] == all_[:10]
    assert nearest.search(d.where("false"), F.col("vec_id") % 100 == 0).count() == 0


def test_urls(spark):
    pages = [(k, f"http://{'bad' if k % 3 == 0 else 'fine'}.shop.com/{'win' if k % 3 == 0 else 'read'}/{k}") for k in range(120)]
    pages += [(200, None), (201, "no scheme"), (202, "HTTP://A.Example.NET/en/x?q#f"), (203, "x://net"), (204, "x://net/"), (205, "x://example.com/de/1"), (206, "x://badexample.com/de/1"), (207, "x://a.org/fr/")]
    p = spark.createDataFrame(pages, "page_id long, url string")
    marks = spark.createDataFrame([(k, 0 if k % 3 == 0 else 1, 0) for k in range(90)], "doc_id long, quality int, toxic int")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in urls.judge(p, marks).collect()}
    assert got[99] == ("bad.shop.com", "/win/99", None, "block") and got[100][3] == "allow"
    assert got[200] == ("", "", None, "allow") and got[201] == ("", "", None, "allow")
    assert got[202] == ("a.example.net", "/en/x", "example.net/en/", "allow") and got[203] == ("net", "", None, "allow")
    assert got[204][2:] == ("net/", "block") and got[205][2:] == ("example.com/de/", "block") and got[206][2] is None and got[207][2:] == ("org/fr/", "allow")
    assert urls.judge(p.where("false"), marks.where("false")).count() == 0
