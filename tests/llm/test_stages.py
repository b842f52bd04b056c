"""Each stage of the pipeline on a small table with nulls, empty texts, ties, repeats and clashing columns, by brute force."""

import os
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lattica.llm import lines, ngram, prefixed, tokens
from test_mixing import simulated

KINDS = "doc_id long, text string, lang string, source string, n_chars long, __item long, copies string, gone string"


def corpus():
    body = lambda k, n=70: " ".join(f"word{(k * 13 + j * j) % 389}" for j in range(n))
    rows = [(k, f"Menu home\n{body(k)}", "en", f"s{k % 2}") for k in range(30)]
    rows += [(40, body(1) + " end", "de", "s2"), (41, body(1) + " end", "de", "s2"), (41, body(1) + " end", "de", "s2"), (None, body(50), None, None), (42, None, "en", "s1"), (43, "", "en", "s1"), (44, "too short", "en", None)]
    rows += [(45, "Menu home\n" * 60 + body(60, 20), "en", "s1"), (46, "Menu home\n" * 20 + body(61, 45), "en", "s0"), (47, "a b c " * 100, "en", "s3"), (48, " ".join(f"long{j}" for j in range(3000)), "fr", "s3")]
    return [(*r, len(r[1] or ""), 5, "clash", None) for r in rows]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), KINDS).repartition(3)


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("labels"))
    spark.createDataFrame([(k, int(k % 5 > 0), 0) for k in range(30)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_empty(spark, docs, folder, name):
    stage = dict(corpus_pipeline.STAGES)[name]
    got = stage(spark, docs.where("false"), folder)
    assert got.count() == 0 and (name == "packing" or got.columns == docs.columns)


def test_quality_rules(spark, docs, folder):
    hosts, first = {}, set()
    for r in corpus():
        text = r[1] or ""
        if (r[3], r[1]) not in first:
            first.add((r[3], r[1]))
            for line in {" ".join(x.lower().split()) for x in text.split("\n")} - {""}:
                hosts[r[3], line] = hosts.get((r[3], line), 0) + 1
    want = []
    for r in corpus():
        text = r[1] or ""
        n, _, _, _, repeat = lines.base(text)
        kept = [x for x in text.split("\n") if hosts.get((r[3], " ".join(x.lower().split())), 0) <= lines.LINE_DOCUMENTS]
        left = sum(len(x.split()) for x in kept)
        if n >= 50 and 100 * repeat <= 50 * n and left >= max(50, lines.KEPT_SHARE * n):
            out = "\n".join(kept) if left < n else text
            want.append((r[0], out, r[2], r[3], len(out), *r[5:]))
    got = rows(corpus_pipeline.quality_rules(spark, docs, folder))
    assert got == sorted(want, key=repr)
    assert {d for d, *_ in got} >= {0, 29, 40, 41, None, 48} and not {d for d, *_ in got} & {42, 43, 44, 45, 46, 47}


def test_quality_classifier(spark, docs, folder):
    got = rows(corpus_pipeline.quality_classifier(spark, docs, folder))
    verdict = Counter((r["doc_id"], r["symbols"]) for r in ngram.classify(docs, spark.read.parquet(f"{folder}/labels.parquet")).collect() if r["kept"])
    assert Counter((d, len((t or "").encode())) for d, t, *_ in got) == verdict and got == [r for r in sorted(corpus(), key=repr) if r in got]
    assert not any(not t for _, t, *_ in got) and {0, 1, 2} <= {d for d, *_ in got}


def test_near_duplicates(spark, docs, folder):
    all_ = corpus()
    sets = [set(prefixed.distinct(r[1] or "", 5).tolist()) for r in all_]
    root = list(range(len(all_)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in range(len(all_)):
        for b in range(a):
            if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) - 1e-9:
                root[find(a)] = find(b)
    groups = {}
    for k, r in enumerate(all_):
        groups.setdefault(find(k), []).append(r[0])
    want = Counter(min(g, key=lambda d: (d is None, d or 0)) for g in groups.values())
    got = corpus_pipeline.near_duplicates(spark, docs, folder)
    assert Counter(r["doc_id"] for r in got.collect()) == want and want[41] == 0 and want[40] + want[1] == 1
    assert set(rows(got)) <= set(all_)


def test_mixing(spark, docs, folder):
    all_ = corpus()
    size, taken, _, _ = simulated([(r[0], r[1], r[3]) for r in all_])
    want = Counter()
    for r, n, t in zip(all_, size, taken):
        want[r] += int(t / n + 0.5) if n else 1
    got = corpus_pipeline.mix_sources(spark, docs, folder)
    # Equal rows have no order among them: their copies are compared together.
    assert got.columns == docs.columns and Counter(rows(got)).keys() <= set(all_)
    assert {k: v for k, v in Counter(rows(got)).items() if k[0] != 41} == {k: v for k, v in want.items() if v and k[0] != 41}


def test_packing(spark, docs, folder):
    got = corpus_pipeline.pack(spark, docs, folder).collect()
    enc, want = tokens.encoder(tokens.default_path()), Counter()
    for r in corpus():
        want.update((r[0], s, n) for s, n in tokens.cut(len(enc.encode(r[1] or "")) // 4 + 1, 1024))
    assert Counter((r["doc_id"], r["start"], r["length"]) for r in got) == want
    held = {}
    for r in got:
        held.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for spans in held.values():
        spans.sort()
        assert len(spans) <= 32 and all(a + n == b for (a, n), (b, _) in zip(spans, spans[1:])) and spans[0][0] == 0 and sum(spans[-1]) <= 1024


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test tables")
def test_all_stages_in_turn(spark):
    path = "/root/testdata/sf0.001"
    got = corpus_pipeline.run(spark, path)
    assert got.count() > 0 and got.where(F.col("doc_id").isNull()).count() == 0
    docs = spark.read.parquet(f"{path}/documents.parquet").select("doc_id")
    assert got.select("doc_id").distinct().join(docs, "doc_id", "left_anti").count() == 0
