"""The manifest against a tree made by hand; proofs by hand."""

import hashlib
import random
import zlib

from lattica.llm import common, manifest, queries

H = lambda *parts: hashlib.sha256("".join(parts).encode()).hexdigest()


def encoded(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def raised(nodes):
    """Levels of a tree, from the leaves to the root."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([H(*levels[-1][k : k + 16]) for k in range(0, len(levels[-1]), 16)])
    return levels


def way(levels, at):
    for level in levels[:-1]:
        first = at - at % 16
        yield level[first:at], level[at + 1 : first + 16]
        at //= 16


def by_hand(rows):
    """Sorted (doc_id, leaf, subroot, root, proof, folded, verified) of rows (doc_id, source, lang, n_chars, text)."""
    groups = {}
    for r in rows:
        groups.setdefault(r[1], []).append((r[0] is not None, r[0] or 0, H(*map(encoded, r)), r))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: raised([x[2] for x in sorted(groups[s], key=lambda x: x[:3])]) for s in names}
    over = raised([trees[s][-1][0] for s in names])
    out = []
    for k, s in enumerate(names):
        for at, (_, _, leaf, r) in enumerate(sorted(groups[s], key=lambda x: x[:3])):
            path = [*way(trees[s], at), *way(over, k)]
            text = r[4]
            if text is not None and r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0:
                text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
            folded = H(*map(encoded, (*r[:4], text)))
            for left, right in path:
                folded = H(*left, folded, *right)
            out.append((r[0], leaf, trees[s][-1][0], over[-1][0], H(*(x for left, right in path for x in left + right)), folded, folded == over[-1][0]))
    return sorted(out, key=repr)


def table(spark, rows):
    df = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], "doc_id long, source string, lang string, n_chars int, text string, group string, place long, node int")
    return df


def judged(spark, rows):
    got = manifest.manifest(table(spark, rows), manifest.lowered_fifth())
    return sorted(((r["doc_id"], r["leaf"], r["subroot"], r["root"], r["proof_sha256"], r["folded_root"], r["verified"]) for r in got.collect()), key=repr)


def odd_rows(n=700, seed=3):
    """A source with most rows, one with one, a null and an empty one, repeated and null ids, nulls in all columns."""
    rng = random.Random(seed)
    rows = [(k, rng.choice(["hot"] * 8 + ["b", "é", "Z", None, ""]), "en", k, f"Text É {k} ABC") for k in range(n)]
    rows += [(5, "hot", "en", 5, "Text É 5 ABC")] * 40 + [(5, "hot", "en", 5, f"other {k}") for k in range(3)]
    rows += [(None, "hot", None, None, None), (None, None, None, None, ""), (-7, "only", "de", 0, "A" * 300_000), (0, "c", "", 0, None), (0, "c", "", 0, None)]
    return rows


def test_tree_of_odd_rows(spark):
    rows = odd_rows()
    got = judged(spark, rows)
    assert got == by_hand(rows) and {v for *_, v in got} == {True, False}


def test_sizes_at_the_borders(spark):
    """Sources of one, two, a run's, an array's and a few more rows; a table of one row; an empty one."""
    rows = [(k, f"s{n}", "en", k, f"T{k}") for n in (1, 2, 16, 17, 256, 257, 273) for k in range(n)]
    for some in (rows, rows[:1], []):
        assert judged(spark, some) == by_hand(some)


def test_many_sources_and_a_third_round(spark, monkeypatch):
    """Arrays of 16: 5000 rows of a source take four rounds; 300 sources two; sides too large to broadcast."""
    for name, value in (("LEVELS", 1), ("BLOCK", 16)):
        monkeypatch.setattr(manifest, name, value)
    monkeypatch.setattr(common, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(common, "fits", lambda *a, **k: False)
    rows = [(k, "hot", "en", k, f"T{k}") for k in range(5000)] + [(k, f"s{k:03}", "en", k, "T") for k in range(300)]
    assert judged(spark, rows) == by_hand(rows)


def test_paths_prove_rows(spark):
    rows = odd_rows(300)
    for r in manifest.manifest(table(spark, rows), paths=True).collect():
        node = r["leaf"]
        for step in r["path"]:
            node = H(step["left"], node, step["right"])
        assert node == r["root"] == r["folded_root"] and r["verified"]


def test_a_changed_row_changes_its_roots_only(spark):
    rows = [(k, f"s{k % 3}", "en", k, f"T{k}") for k in range(90)]
    changed = [(*r[:4], "other") if r[0] == 4 else r for r in rows]
    roots = lambda x: {(r["source"], r["subroot"]) for r in manifest.manifest(table(spark, x)).collect()}
    assert {s for s, _ in roots(rows) ^ roots(changed)} == {"s1"}


def test_query_has_the_digest_columns(spark):
    got = queries.QUERIES["op13_merkle_manifest"](spark, "/root/testdata/sf0.001")
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
