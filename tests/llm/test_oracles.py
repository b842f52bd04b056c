"""Queries with SQL give DuckDB's rows: on the smallest tables and on a small one with nulls, ties and repeated rows."""

import os

import duckdb
import pytest

from lattica.llm import queries

DATA = "/root/testdata/sf0.001"


def rows(names, values):
    order = sorted(range(len(names)), key=lambda k: names[k])
    return sorted((tuple(v[k] for k in order) for v in values), key=repr)


def compare(spark, name, folder):
    c = duckdb.connect()
    for f in os.listdir(folder):
        c.sql(f"create view {f.split('.')[0]} as select * from read_parquet('{folder}/{f}{'/*.parquet' if os.path.isdir(f'{folder}/{f}') else ''}')")
    want, got = c.sql(queries.oracles()[name]), queries.QUERIES[name](spark, folder)
    assert sorted(want.columns) == sorted(got.columns)
    assert rows(got.columns, got.collect()) == rows(want.columns, want.fetchall())


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
@pytest.mark.parametrize("name", sorted(queries.oracles()))
def test_query(spark, name):
    compare(spark, name, DATA)


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    """Two small sources, whose targets are capped, one large one, a null one; lines that many documents of a host share."""
    folder = str(tmp_path_factory.mktemp("odd"))
    body = lambda k: " ".join(f"u{k}x{j}" for j in range(50 + k))
    docs = [(k, "Menu  home Login\n" * (k % 3) + body(k), "en", "c") for k in range(60)] + [(90, body(1), "en", "a")] * 3
    docs += [(91, " é# b c | é# b c |", "en", "b"), (92, None, "en", None), (None, "", None, None), (None, "a a a a", "en", "b"), (93, None, "en", "c"), (94, "x\ny\nx\n \nx " * 30, "en", None)]
    docs = [(*d, None if k % 9 == 0 else k) for k, d in enumerate(docs)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    vectors = [(k, [float(k % 7), 1.0, float(k % 3) / 7]) for k in range(120)] + [(200, None), (300, [0.0] * 3), (400, [float("nan"), 1.0, 1.0]), (500, [None, 1.0, 2.0]), (600, [float("inf"), 1.0, 1.0]), (700, [])]
    spark.createDataFrame(vectors, "vec_id long, embedding array<float>").write.parquet(f"{folder}/embeddings.parquet")
    items = [(1, "menu LOGIN home u3x1 a a"), (1, "É# c |"), (2, None), (3, ""), (None, "b-c x"), (4, "nowhere")] + [(k, body(k % 9) + " x y") for k in range(10, 40)]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder


@pytest.mark.parametrize("name", ["op5_fair_mix", "op8_line_frequency", "op9_tile_search", "op12_bucket_search", "op13_merkle_manifest"])
def test_odd_rows(spark, odd, name):
    compare(spark, name, odd)
