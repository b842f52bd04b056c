"""Chains, components, cycles and closures against definitions."""

import random

from lattica.operators import closure


def closed(edges):
    out = set(edges)
    while True:
        more = {(a, d) for a, b in out for c, d in out if b == c} - out
        if not more:
            return out
        out |= more


def graphs():
    rng = random.Random(8)
    yield "random", [(rng.randrange(25), rng.randrange(25)) for _ in range(32)]
    yield "rings, chains into cycles, a loop, repeated edges", [(1, 2), (2, 3), (3, 1), (10, 11), (11, 12), (12, 13), (13, 11), (13, 14), (14, 15), (20, 20), (21, 20), (20, 22), (22, 23), (23, 24), (30, 31), (31, 30), (31, 32), (32, 33), (33, 32), (1, 2), (40, 41)]
    yield "two cycles of one colour", [(1, 2), (2, 1), (2, 5), (5, 6), (6, 5), (6, 9), (9, 8), (8, 9), (9, 3), (3, 4), (4, 3)]
    yield "acyclic", [(a, b) for a in range(9) for b in range(a + 1, 9) if (a * b) % 3 == 0]
    yield "none", []


def test_components_and_closure(spark):
    """All graphs as one, their nodes apart; and no graph."""
    apart = [(a + 1000 * k, b + 1000 * k) for k, (_, some) in enumerate(graphs()) for a, b in some]
    for pairs in (apart, []):
        check(spark, pairs)


def test_chains_from_the_first_round(spark, monkeypatch):
    monkeypatch.setattr(closure, "SHORT", 0)
    pairs = [p for _, some in list(graphs())[:3] for p in some]
    starts = [0, 1, 13, 22, 30]
    got = closure.reachable(spark.createDataFrame(pairs, "s long, o long"), spark.createDataFrame([(n,) for n in starts], "s long"))
    assert sorted(tuple(r) for r in got.collect()) == sorted(p for p in closed(pairs) if p[0] in starts)


def check(spark, pairs):
    e = spark.createDataFrame([*pairs, (None, 1), (2, None)], "s long, o long")
    want = closed(pairs)
    nodes = {n for p in pairs for n in p}
    got = {r["node"]: (r["component"], r["cyclic"]) for r in closure.components(e).collect()}
    assert got == {n: (min([n, *(m for m in nodes if (n, m) in want and (m, n) in want)]), (n, n) in want) for n in nodes}
    assert sorted(tuple(r) for r in closure.closure(e).collect()) == sorted(want)
    assert {r["node"] for r in closure.cycles(e).collect()} == {n for n in nodes if (n, n) in want}
    starts = [n for n in sorted(nodes) if n % 3 == 1] + [999]
    got = closure.reachable(e, spark.createDataFrame([(n,) for n in starts], "s long"))
    assert sorted(tuple(r) for r in got.collect()) == sorted(p for p in want if p[0] in starts)


def test_a_long_path_takes_few_rounds(spark, monkeypatch):
    writes = []
    plain = closure.written
    monkeypatch.setattr(closure, "written", lambda df, name: writes.append(name) or plain(df, name))
    e = spark.createDataFrame([(f"n{k:04}", f"n{k + 1:04}") for k in range(1000)] + [("m", "n0500")], "s string, o string")
    got = {r["o"] for r in closure.reachable(e, spark.createDataFrame([("n0100",)], "s string")).collect()}
    assert got == {f"n{k:04}" for k in range(101, 1001)} and len(writes) < 32
