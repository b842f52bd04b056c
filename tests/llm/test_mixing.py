"""The mix against a plain simulation of the queue; the sort and the cut decide rows."""

import hashlib
import re

from lattica.llm import mixing


def simulated(rows, weights=(5, 2, 1), most=3, quantum=mixing.QUANTUM, cut=True):
    """Words taken of each row (doc_id, text, source), by place in rows, with each source's (size, target)."""
    size = [len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for _, t, _ in rows]
    key = [int(hashlib.md5("\0".join(("42", "" if d is None else str(d), t or "")).encode()).hexdigest()[:15], 16) for d, t, _ in rows]
    names = sorted({s for _, _, s in rows}, key=lambda s: (s is None, s or ""))
    total, own = sum(size), {s: sum(n for n, r in zip(size, rows) if r[2] == s) for s in names}
    weight = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    capped = set()
    while True:
        rest = total - sum(most * own[s] for s in capped)
        free = [s for s in names if s not in capped]
        target = {s: most * own[s] for s in capped} | {s: rest * weight[s] / sum(weight[x] for x in free) for s in free}
        more = {s for s in free if target[s] > most * own[s]}
        if not more:
            break
        capped |= more
    queue = []
    for place, s in enumerate(names):
        at = 0
        for _ in range(most):
            for k in sorted((k for k in range(len(rows)) if rows[k][2] == s and size[k]), key=lambda k: key[k]):
                n = size[k]
                pieces = [(0, n)] if at + n <= target[s] else [(f, min(quantum, n - f)) for f in range(0, n, quantum)]
                queue += [((at + f + w) / target[s], place, at + f, k, w) for f, w in pieces if at + f < target[s]]
                at += n
    taken, left = [0] * len(rows), total
    for _, _, _, k, w in sorted(queue):
        w = min(w, left) if cut else w
        taken[k] += w
        left -= w
    return size, taken, own, target


def corpus():
    words = lambda k, n: " ".join(f"w{k}x{j}" for j in range(n))
    rows = [(k, words(k, 20 + k * 37 % 200), f"s{k % 5}" if k % 3 else "s0") for k in range(150)]
    rows += [(k, words(k, 30), "tiny") for k in range(200, 203)] + [(300, words(9, 9000), "s3"), (301, words(8, 7000), None)]
    return rows + [(400, None, "s1"), (None, "", None), (None, None, None), (5, "a b c", "s2"), (6, " ", "s4")]


def test_mix_is_the_simulated_queue(spark):
    rows = corpus()
    size, taken, own, target = simulated(rows)
    want = sorted((r[0] if r[0] is not None else -1, n, own[r[2]], t) for r, n, t in zip(rows, size, taken))
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, source string, before string").repartition(7)
    got = mixing.mix(df).collect()
    assert sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["size"], r["source_size"], r["taken"]) for r in got) == want
    assert sum(taken) == sum(size) and all(t <= 3 * n for n, t in zip(size, taken))
    for s in own:
        assert abs(sum(t for r, t in zip(rows, taken) if r[2] == s) - target[s]) < mixing.QUANTUM
    # Without the cut other rows come out, and so they do if no schedule is kept but each source is cut at its target.
    assert simulated(rows, cut=False)[1] != taken
    clipped = {s: sum(t for r, t in zip(rows, taken) if r[2] == s) != round(target[s]) for s in own}
    assert any(clipped.values())


def test_equal_rows_are_spread(spark, monkeypatch):
    """A thousand equal rows, null ids and texts among them: ranges part them, each is a row of its own."""
    monkeypatch.setattr(mixing, "RANGE_ROWS", 50)
    rows = [(1, "a b c d", "s")] * 1000 + [(None, None, "s")] * 300 + [(2, "x y", "t")] * 100
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    assert len(got) == 1400 and all(r["taken"] <= 3 * r["size"] for r in got)
    s, t = (sum(r["taken"] for r in got if r["source_size"] == n) for n in (4000, 200))
    assert s + t == 4200 and t == 600  # the small source is capped at three times its size


def test_targets():
    shares = {s: (n, t) for s, n, t in mixing.targets([("b", 10), ("a", 100), (None, 1000)], (5, 2, 1), 3)}
    assert shares["a"][1] == 300 and shares["b"][1] == 30 and abs(sum(t for _, t in shares.values()) - 1110) < 1e-9
