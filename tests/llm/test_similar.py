"""Near-duplicates by similarity: all pairs of shingle sets at the limit, and no others, against brute force."""

import numpy as np

from lattica.llm import prefixed, simhash


def components(rows, similarity):
    sets = {d: set(prefixed.distinct(t, 5).tolist()) for d, t in rows}
    root = {d: d for d in sets}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    for a in sets:
        for b in sets:
            if b < a and len(sets[a] & sets[b]) >= similarity * len(sets[a] | sets[b]) - 1e-9:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {d: find(d) for d in sets}


def got(spark, rows):
    d = spark.createDataFrame(rows, "doc_id long, text string")
    return {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(d, 5, 2, 0.8).collect()}


def test_pairs_at_the_limit_are_found_whatever_the_bits(spark, monkeypatch):
    """Tables of all 64 bits, as in the deepest groups, propose hardly any pair just above 0.8."""
    monkeypatch.setattr(simhash, "tables", lambda rows, similarity, spare, level=0: (64, 1))
    rng = np.random.default_rng(8)
    shared, rows = [f"s{x}" for x in rng.integers(0, 50_000, 300)], []
    for k in range(20):
        own = [f"w{x}" for x in rng.integers(0, 50_000, 150)]
        rows += [(2 * k, " ".join(shared + own)), (2 * k + 1, " ".join([*shared, *own[:106], *(f"v{x}" for x in rng.integers(0, 50_000, 44))]))]
    want = components(rows, 0.8)
    assert all(want[d] == d - d % 2 for d in want) and got(spark, rows) == want


def test_crowded_shingles_are_compared_in_blocks(spark, monkeypatch):
    """A family around one text, of all similarities: every shingle is crowded, blocks are of a few members."""
    monkeypatch.setattr(simhash, "tables", lambda rows, similarity, spare, level=0: (64, 1))
    monkeypatch.setattr(prefixed, "CROWD", 1)
    monkeypatch.setattr(prefixed, "BLOCK", 7)
    rng = np.random.default_rng(12)
    base, rows = [f"s{x}" for x in rng.integers(0, 50_000, 120)], []
    for k in range(90):
        own = base[: int(rng.integers(60, 121))]
        for j in rng.integers(0, len(own), int(rng.integers(0, 5))):
            own[j] = f"n{k}x{j}"
        rows.append((k, " ".join(own)))
    want = components(rows, 0.8)
    assert got(spark, rows) == want and 2 < len(set(want.values())) < 80


def members(spark, roots):
    """Crowded shingles whose members have these roots."""
    rows = [(shingle, len(own), 1000 * shingle + k, r, 100, 0) for shingle, own in enumerate(roots) for k, r in enumerate(own)]
    return spark.createDataFrame(rows, "shingle long, n long, node long, root long, size int, at int")


def test_only_different_roots_meet(spark, monkeypatch):
    """Every two members of different roots meet once; a large root's members do not meet each other."""
    monkeypatch.setattr(prefixed, "BLOCK", 5)
    rng = np.random.default_rng(3)
    roots = [[1] * 40 + [2], [1] * 12 + [2] * 12 + [3] * 3, list(range(30)), [int(x) for x in rng.integers(0, 4, 60)], [7] * 3 + [8] * 2]
    calls = {}
    for r in prefixed.dealt(members(spark, roots)).collect():
        calls.setdefault((r["shingle"], r["lo"], r["hi"]), []).append(r)
    met = {}
    for (shingle, lo, hi), rows in calls.items():
        for a in rows:
            for b in rows:
                if a["own"] == lo and b["own"] == hi and a["root"] != b["root"] and (lo != hi or a["node"] < b["node"]):
                    pair = (shingle, *sorted((a["node"], b["node"])))
                    met[pair] = met.get(pair, 0) + 1
    want = {(s, 1000 * s + j, 1000 * s + k) for s, own in enumerate(roots) for k in range(len(own)) for j in range(k) if own[j] != own[k]}
    assert set(met) == want and set(met.values()) == {1}


def test_a_family_and_one_more_make_few_rows(spark):
    """4000 joined members and a straggler in each of ten shingles: a row a member, where every two blocks made four."""
    rows = prefixed.dealt(members(spark, [[1] * 4000 + [2]] * 10)).count()
    assert rows == 10 * (4000 + 1 + 4)


def test_repeated_lines_do_not_decide(spark):
    rng = np.random.default_rng(9)
    words = lambda n: [f"w{x}" for x in rng.integers(0, 50_000, n)]
    line, rows = words(10), []
    for k in range(10):  # alike in nothing but one line, 19 times
        rows.append((k, " ".join(words(210) + line * 19)))
    body = words(300)
    rows += [(20, " ".join(body + line * 2)), (21, " ".join(body + line * 40))]  # of one set
    want = components(rows, 0.8)
    assert want == {**{k: k for k in range(10)}, 20: 20, 21: 20} and got(spark, rows) == want


def test_sketches_bound_what_sets_share():
    rng = np.random.default_rng(10)
    for n in (0, 1, 9, 70, 700, 9000):
        for part in (0.0, 0.4, 0.8, 1.0):
            pool = rng.integers(0, 2**63, 2 * n + 1, dtype=np.uint64)
            m = n * 9 // 10
            a, b = np.unique(pool[:n]), np.unique(np.concatenate([pool[: int(part * m)], pool[n : n + m - int(part * m)]]))
            both, bound = len(np.intersect1d(a, b)), prefixed.shared(prefixed.sketch(a), prefixed.sketch(b), min(len(a), len(b)))
            assert both <= bound <= min(len(a), len(b)) and (n < 70 or part > 0 or bound < 0.7 * m)
    # A bucket with more than a byte's count has no sketch, which rules nothing out.
    crowd = np.arange(0, 300 * 2**20, 2**20, dtype=np.uint64)
    assert prefixed.sketch(crowd) is None and prefixed.shared(None, prefixed.sketch(crowd[:9]), 9) == 9
