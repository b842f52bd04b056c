"""Association rules of URLs that share many tokens: the same verdicts as all rules by brute force, and no explosion."""

import time
from itertools import combinations

import numpy as np

from lattica.llm import urls


def all_rules(baskets, needed, confidence):
    """Every token set that is a rule, by counting subsets."""
    tokens = sorted({t for b, _ in baskets for t in b})
    found = []
    for n in range(1, len(tokens) + 1):
        for c in combinations(tokens, n):
            hits = [bad for b, bad in baskets if set(c) <= set(b)]
            if sum(hits) >= needed and sum(hits) / len(hits) >= confidence:
                found.append(set(c))
    return found


def test_classes_give_the_verdicts_of_all_rules(spark):
    """Tokens that always stand together, in bad, good and mixed sites; every combination of tokens is then judged."""
    rng = np.random.default_rng(2)
    baskets = []
    for _ in range(240):
        site = int(rng.integers(0, 3))
        tokens = [f"{site}{x}" for x in "ab"] + (["e"] if rng.random() < 0.4 else []) + (["f", "g"] if rng.random() < 0.3 else [])
        bad = rng.random() < {0: 0.97, 1: 0.03, 2: 0.95 if "e" in tokens and "f" in tokens else 0.3}[site]
        baskets.append((tokens, bool(bad)))
    rules = all_rules(baskets, 10, 0.85)
    index = {}
    for r in urls.mined(spark.createDataFrame(baskets, "tokens array<string>, bad boolean"), 0.01, 0.85, 10).collect():
        index.setdefault((r["rule_id"], r["n"]), {}).setdefault(r["class"], set()).add(r["token"])
    assert all(len(c) == n for (_, n), c in index.items()) and any(len(t) > 1 for c in index.values() for t in c.values())
    names = sorted({t for b, _ in baskets for t in b})
    verdicts = set()
    for n in range(len(names) + 1):
        for own in combinations(names, n):
            by_all = any(r <= set(own) for r in rules)
            assert by_all == any(all(t & set(own) for t in c.values()) for c in index.values()), own
            verdicts.add(by_all)
    assert verdicts == {True, False}


def test_sites_of_many_shared_tokens(spark):
    """60 URLs of one site share 40 tokens, some bad, some not; another bad site's URLs differ by one of 30 each."""
    shared = "/".join(f"p{chr(97 + k // 10)}{chr(97 + k % 10)}" for k in range(38))
    pages = [(k, f"https://mixed.test/{shared}/{'evil' if k % 2 else 'fine'}") for k in range(60)]
    pages += [(100 + k, "https://bad.test/" + "/".join(f"q{chr(97 + j)}" for j in range(26) if j != k % 26)) for k in range(60)]
    pages += [(200 + k, f"https://good.test/{k}") for k in range(60)]
    pages += [(1000, f"https://mixed.test/{shared}/evil"), (1001, f"https://mixed.test/{shared}/fine"), (1002, "https://other.test/qc"), (1003, "https://other.test/paa/evil"), (1004, "https://other.test/1")]
    marks = [(k, 0 if k < 100 and k % 2 or 100 <= k < 200 else 1, 0) for k, _ in pages if k < 1000]
    began = time.time()
    got = urls.judge(spark.createDataFrame(pages, "page_id long, url string"), spark.createDataFrame(marks, "doc_id long, quality int, toxic int"))
    verdicts = {r["page_id"]: r["verdict"] for r in got.collect()}
    assert time.time() - began < 120
    assert [verdicts[1000 + k] for k in range(5)] == ["block", "allow", "block", "block", "allow"]
    assert all((verdicts[k] == "block") == (k < 100 and k % 2 == 1 or 100 <= k < 200) for k in range(260) if k in verdicts)
