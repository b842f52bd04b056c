"""Uniform shuffle into shards of exact sizes by a hypergeometric communication matrix.

Blocks are the partitions of a written copy, so a retried task sees the same rows in the same order. Entry (i, t) of the
matrix says how many rows of block i go to target t; it follows the multivariate hypergeometric law given the block
sizes and the target sizes. It is drawn by halving the blocks, and within each half by halving the targets, entering only
targets that still get rows; every node has a seed of its own, so each task draws the one row it needs and any retry
draws the same one; the matrix is never held anywhere. A block is permuted, dealt by its row of the matrix, exchanged, and
every target is permuted again.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Rows of a target, at least: a target is permuted by one vector.
TARGET_ROWS = 4_000
#: Targets at most: drawing a row of the matrix takes time in proportion to them, whatever the number of blocks. At 10^10
#: rows a target then has 1.2 million rows, a vector of 10 MB.
TARGETS = 8_192
#: Wanted rows up to which they are drawn one by one.
FEW = 16


def hypergeometric(rng: np.random.Generator, good: np.ndarray, bad: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """How many of `wanted` rows, drawn without replacement from good + bad ones, are good: exact at any population.

    A binomial number of the good and of the bad ones, each row with chance wanted / (good + bad), is a uniform choice of
    as many rows as that gives. If it is too many, those to take back are again such a draw, from the chosen rows; if too
    few, those to add are one from the others. What is missing shrinks to its square root each time; the last few rows
    are drawn one by one.
    """
    good, bad, wanted = (np.array(x, dtype=np.int64) for x in np.broadcast_arrays(good, bad, wanted))
    out, sign = np.zeros(len(good), dtype=np.int64), np.ones(len(good), dtype=np.int64)
    many = np.flatnonzero(wanted > FEW)
    while len(many):
        g, b, w = good[many], bad[many], wanted[many]
        p = w / (g + b)
        x, y = rng.binomial(g, p), rng.binomial(b, p)
        over = x + y > w
        out[many] += sign[many] * x
        good[many], bad[many], wanted[many] = np.where(over, x, g - x), np.where(over, y, b - y), np.abs(x + y - w)
        sign[many] = np.where(over, -sign[many], sign[many])
        many = many[wanted[many] > FEW]
    left = np.flatnonzero(wanted > 0)
    while len(left):
        hit = (rng.integers(0, good[left] + bad[left]) < good[left]).astype(np.int64)
        out[left] += sign[left] * hit
        good[left] -= hit
        bad[left] -= 1 - hit
        wanted[left] -= 1
        left = left[wanted[left] > 0]
    return out


def draw(rng: np.random.Generator, colors: np.ndarray, wanted: int) -> np.ndarray:
    """How many of `wanted` rows fall on each target of `colors`, drawn without replacement: halved level by level, all
    nodes of a level at once, without those that get none."""
    width = 1 << max(len(colors) - 1, 0).bit_length()
    sums = [np.concatenate([colors, np.zeros(width - len(colors), dtype=np.int64)]).astype(np.int64)]
    while len(sums[-1]) > 1:
        sums.append(sums[-1][0::2] + sums[-1][1::2])
    nodes, counts = np.zeros(1, dtype=np.int64), np.array([wanted], dtype=np.int64)
    for level in reversed(sums[:-1]):
        some = counts > 0
        nodes, counts = nodes[some], counts[some]
        lo = hypergeometric(rng, level[2 * nodes], level[2 * nodes + 1], counts)
        nodes, counts = np.stack([2 * nodes, 2 * nodes + 1], axis=1).ravel(), np.stack([lo, counts - lo], axis=1).ravel()
    out = np.zeros(width, dtype=np.int64)
    out[nodes] = counts
    return out[: len(colors)]


def matrix_row(sizes: np.ndarray, targets: np.ndarray, block: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Row `block` of the matrix, and for each target the rows that earlier blocks send there."""
    below = np.concatenate([[0], np.cumsum(sizes)])
    lo, hi, open_, before = 0, len(sizes), targets.astype(np.int64), np.zeros(len(targets), dtype=np.int64)
    while hi - lo > 1:
        mid = (lo + hi) // 2
        left = draw(np.random.default_rng([seed, lo, hi]), open_, int(below[mid] - below[lo]))
        if block < mid:
            hi, open_ = mid, left
        else:
            lo, open_, before = mid, open_ - left, before + left
    return open_, before


def target_sizes(rows: int, shards: int) -> tuple[np.ndarray, int]:
    """Sizes of all targets, shard by shard, and the targets of a shard; shard sizes differ by one at most."""
    each = max(1, min(-(-rows // (shards * TARGET_ROWS)), TARGETS // shards))
    whole = [rows // shards + (k < rows % shards) for k in range(shards)]
    return np.array([n // each + (j < n % each) for n in whole for j in range(each)], dtype=np.int64), each


def shuffle_to_shards(docs: DataFrame, shards: int = 8, seed: int = 42) -> DataFrame:
    """Shuffle docs uniformly into `shards` shards of exact sizes; returns shard, slot (from 0) and the row as a struct.

    Every column travels, whatever its name (`row` is a struct, so none clashes); nulls, ties and repeated rows are
    rows like any other; an empty table gives an empty result. Law: `rows`. The same seed and the same written blocks
    give the same order. One number a block and at most TARGETS or `shards` numbers are held on the driver.
    """
    index = F.monotonically_increasing_id()
    copy = common.keep(docs.select(common.whole(docs), F.shiftright(index, 33).alias("block"), index.bitwiseAND(F.lit((1 << 33) - 1)).alias("at")), "shuffle")
    # One number a block: as many as the input has partitions.
    found = {r["block"]: r["n"] for r in copy.groupBy("block").agg(F.count("*").alias("n")).collect()}
    sizes = np.zeros(max(found, default=0) + 1, dtype=np.int64)
    for block, n in found.items():
        sizes[block] = n
    targets, each = target_sizes(int(sizes.sum()), shards)
    first = np.concatenate([[0], np.cumsum(targets)])
    known: dict[int, tuple] = {}
    orders: dict[int, np.ndarray] = {}

    @F.pandas_udf("target long, at long")
    def place(block: pd.Series, at: pd.Series) -> pd.DataFrame:
        b, i = block.to_numpy(), at.to_numpy()
        target, there = np.zeros(len(b), dtype=np.int64), np.zeros(len(b), dtype=np.int64)
        for k in np.unique(b):
            if k not in known:
                known.clear()
                counts, before = matrix_row(sizes, targets, int(k), seed)
                known[k] = np.random.default_rng([seed, 1, k]).permutation(int(sizes[k])), np.cumsum(counts), counts, before
            order, ends, counts, before = known[k]
            mine = np.flatnonzero(b == k)
            p = order[i[mine]]
            t = np.searchsorted(ends, p, side="right")
            target[mine] = t
            there[mine] = before[t] + p - (ends[t] - counts[t])
        return pd.DataFrame({"target": target, "at": there})

    @F.pandas_udf("shard int, slot long")
    def settle(target: pd.Series, at: pd.Series) -> pd.DataFrame:
        t, slot = target.to_numpy(), at.to_numpy().copy()
        for k in np.unique(t):
            if k not in orders:
                # Rows come target by target: one vector is in use at a time, and each is made once a partition.
                orders.clear()
                orders[k] = np.random.default_rng([seed, 2, k]).permutation(int(targets[k]))
            mine = np.flatnonzero(t == k)
            slot[mine] = orders[k][slot[mine]] + first[k] - first[k // each * each]
        return pd.DataFrame({"shard": (t // each).astype(np.int32), "slot": slot})

    sent = copy.withColumn("place", place("block", "at")).select("row", "place.target", "place.at")
    there = sent.repartition("target").sortWithinPartitions("target", "at")
    return there.withColumn("place", settle("target", "at")).select("place.shard", "place.slot", "row")
