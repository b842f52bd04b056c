"""The hypergeometric matrix: its law, its margins at any population, uniform order and equal reruns."""

from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from lattica.llm import sharding


def test_draws_follow_the_law():
    n = 100_000
    for good, bad, wanted in ((30, 70, 40), (5, 200, 100), (400, 300, 699), (50, 50, 7)):
        got = sharding.hypergeometric(np.random.default_rng(1), np.full(n, good), np.full(n, bad), np.full(n, wanted))
        want = np.random.default_rng(2).hypergeometric(good, bad, wanted, n)
        a, b = np.bincount(got, minlength=good + 1), np.bincount(want, minlength=good + 1)
        some = a + b > 20
        chi = ((a - b)[some] ** 2 / (a + b)[some]).sum()
        assert chi < some.sum() + 5 * (2 * some.sum()) ** 0.5


def test_large_populations():
    rng, n = np.random.default_rng(3), 10**12
    x = sharding.hypergeometric(rng, np.full(4000, n // 4), np.full(4000, n - n // 4), np.full(4000, n // 2))
    sd = (n / 2 * 0.25 * 0.75 * 0.5) ** 0.5
    # Of so many draws about ten pairs are equal.
    assert abs(x.mean() - n / 8) < 5 * sd / 4000**0.5 and 0.95 < x.std() / sd < 1.05 and len(set(x.tolist())) > 3950
    sizes, targets = np.array([3 * 10**9, 0, 7 * 10**9 + 5, 11]), np.full(6, (10**10 + 16) // 6 + 1)
    targets[-1] -= targets.sum() - sizes.sum()
    rows = [sharding.matrix_row(sizes, targets, b, 3) for b in range(4)]
    assert (sum(r for r, _ in rows) == targets).all() and [int(r.sum()) for r, _ in rows] == sizes.tolist()
    assert all((r >= 0).all() and (before == sum((r for r, _ in rows[:b]), np.zeros(6))).all() for b, (r, before) in enumerate(rows))


def test_targets_are_bounded():
    assert len(sharding.target_sizes(10**11, 8)[0]) == sharding.TARGETS and sharding.target_sizes(10, 8)[0].tolist() == [2, 2, 1, 1, 1, 1, 1, 1]


def test_every_place_is_equally_likely(spark):
    """Over many seeds each row comes to each of the places of 2 shards about as often; reruns agree."""
    docs = spark.range(0, 6, 1, 3).select(F.col("id").alias("doc_id"))
    seen, seeds = Counter(), 90
    for seed in range(seeds):
        got = sorted((r["shard"], r["slot"], r["doc_id"]) for r in sharding.shuffle_to_shards(docs, 2, seed).select("shard", "slot", "row.doc_id").collect())
        assert [(s, t) for s, t, _ in got] == [(s, t) for s in range(2) for t in range(3)] and {d for _, _, d in got} == set(range(6))
        seen.update(got)
        if seed < 2:
            assert got == sorted((r["shard"], r["slot"], r["doc_id"]) for r in sharding.shuffle_to_shards(docs, 2, seed).select("shard", "slot", "row.doc_id").collect())
    chi = sum((seen[s, t, d] - seeds / 6) ** 2 / (seeds / 6) for s in range(2) for t in range(3) for d in range(6))
    assert chi < 25 + 5 * 50**0.5  # 25 degrees of freedom
