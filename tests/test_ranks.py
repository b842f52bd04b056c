"""Ranks by ranges against ranks by counting."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lattica.operators import reports


@pytest.mark.parametrize("by", [[], ["g"]])
def test_average_ranks(spark, by):
    """A value that half of the rows have, ties over ranges, nulls, a null group, signed zeros."""
    rng = random.Random(5)
    rows = [(rng.choice(["a", "b", None]), rng.choice([0.5] * 6 + [-0.0, 0.0, 3.25, None, -7.0, *(float(k) for k in range(6))])) for _ in range(400)]
    got = reports.average_ranks(spark.createDataFrame(rows, "g string, v double"), "v", by, "rank").collect()
    assert len(got) == sum(v is not None for _, v in rows)
    for r in got:
        own = [v for g, v in rows if v is not None and (not by or g == r["g"])]
        assert r["rank"] == sum(v < r["v"] for v in own) + (sum(v == r["v"] for v in own) + 1) / 2


def test_rows_that_differ_when_made_again(spark):
    """Values whose last digits are others each time that they are made, as those of sums in another order: no row is lost."""

    def noise(batches):
        for b in batches:
            yield b.assign(v=(b["id"] // 2) + np.random.default_rng().random(len(b)) * 1e-9)

    rows = spark.range(200).mapInPandas(noise, "id long, v double")
    got = reports.average_ranks(rows, "v", [], "rank").collect()
    assert sorted(r["id"] for r in got) == list(range(200)) and all(abs(r["rank"] - (r["id"] // 2 * 2 + 1.5)) <= 0.5 for r in got)
    rho = reports.spearman(rows.withColumn("w", F.col("v") * 2), "v", "w").first()
    assert rho["n"] == 200 and rho["rho"] > 0.999


def test_matrix_is_that_of_pairs(spark):
    rng = random.Random(6)
    rows = [tuple(rng.choice([None, 1.0, 2.0, rng.random()]) for _ in range(3)) + (4.0,) for _ in range(60)]
    m = spark.createDataFrame(rows, "x double, y double, z double, same double")
    got = {(r["a"], r["b"]): (r["n"], r["rho"]) for r in reports.spearman_matrix(m, ["x", "y", "z", "same"]).collect()}
    assert len(got) == 6 and got[("x", "same")][1] is None
    for (a, b), (n, rho) in got.items():
        one = reports.spearman(m, a, b).first()
        assert one["n"] == n and (one["rho"] is None) == (rho is None) and (rho is None or abs(one["rho"] - rho) < 1e-12)
    both = m.withColumn("k", F.lit("p")).union(m.withColumn("k", F.lit("q")))
    assert {r["k"]: round(r["rho"], 9) for r in reports.spearman(both, "x", "y", ["k"]).collect()} == dict.fromkeys("pq", round(got[("x", "y")][1], 9))
