"""Packing pieces into sequences.

Pieces of one length are interchangeable, so a packing is decided on the histogram of lengths alone: at most as many
entries as a sequence has tokens, whatever the corpus size. The plan says which ranks of each length go where, as runs;
the pieces are ranked within their length in parallel and look their place up. The plan is exactly what the sequential
algorithm makes of the whole corpus, and its size depends on the capacity only.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, tokens

#: (length, first rank, pieces, first sequence, pieces a sequence, offset of the first piece)
Run = tuple[int, int, int, int, int, int]


class CapacityTree:
    """Segment tree over residual capacities: how many groups have each; finds the least capacity >= a wanted one."""

    def __init__(self, most: int):
        self.leaves = 1 << most.bit_length()
        self.held = [0] * (2 * self.leaves)

    def add(self, capacity: int, by: int) -> None:
        node = capacity + self.leaves
        while node:
            self.held[node] += by
            node //= 2

    def least(self, wanted: int) -> int | None:
        node = wanted + self.leaves
        if self.held[node]:
            return wanted
        while node > 1:
            if node % 2 == 0 and self.held[node + 1]:
                node += 1
                while node < self.leaves:
                    node = 2 * node if self.held[2 * node] else 2 * node + 1
                return node - self.leaves
            node //= 2
        return None


def best_fit_decreasing(histogram: dict[int, int], capacity: int) -> tuple[list[Run], int]:
    """Best-fit-decreasing on a histogram of lengths; returns the runs and the number of sequences."""
    groups: dict[int, list[tuple[int, int]]] = defaultdict(list)
    tree, runs, opened = CapacityTree(capacity), [], 0

    def put(residual: int, first: int, n: int) -> None:
        if n:
            groups[residual].append((first, n))
            tree.add(residual, 1)

    for length in sorted(histogram, reverse=True):
        rank, left = 0, histogram[length]
        while left:
            residual = tree.least(length)
            if residual is None:
                each = capacity // length
                residual, first, n = capacity, opened, -(-left // each)
                opened += n
            else:
                first, n = groups[residual].pop()
                tree.add(residual, -1)
                each = residual // length
            full = min(n, left // each)
            if full:
                runs.append((length, rank, full * each, first, each, capacity - residual))
                put(residual - each * length, first, full)
                rank, left, first, n = rank + full * each, left - full * each, first + full, n - full
            if 0 < left < each and n:
                runs.append((length, rank, left, first, each, capacity - residual))
                put(residual - left * length, first, 1)
                rank, left, first, n = rank + left, 0, first + 1, n - 1
            put(residual, first, n)
    return runs, opened


def scores(left: np.ndarray, demand: np.ndarray, full_of: np.ndarray, weights: np.ndarray, rule: str) -> np.ndarray:
    """The score of each sequence of residuals `left` for a piece of this demand; the smallest is chosen.

    norm: the weighted squared norm of the residuals that the piece would leave, as shares of the capacities. dot: minus
    the weighted dot product of the demand and the residuals, both as shares, by the residuals' length: the sequence whose
    room is of the piece's own kind. By length, since the plain product only says which sequence is emptiest.
    """
    if rule == "norm":
        return (weights * ((left - demand) / full_of) ** 2).sum(axis=1)
    share = left / full_of
    size = np.sqrt((weights * share**2).sum(axis=1))
    return -np.divide((weights * share * (demand / full_of)).sum(axis=1), size, out=np.zeros(len(left)), where=size > 0)


def vector_best_fit(histogram: dict[int, int], capacity: int, documents: int, attention: int, rule: str = "norm", weights: tuple[float, float, float] = (1.0, 0.01, 0.01)) -> tuple[list[Run], int]:
    """Vector best-fit by decreasing length under three capacities: tokens, pieces, and attention cost (length squared).

    Each piece goes to the sequence of the best of `scores` ("norm" or "dot") among those that can hold it under every
    constraint, the first of equals, or opens one. Sequences of equal residuals that follow each other are a group: what
    the rule says of its first one holds for all, so a group is filled at once, each sequence as long as it would be
    chosen again.
    """
    if rule not in ("norm", "dot"):
        raise ValueError("rule is norm or dot")
    full_of = np.array([capacity, documents, attention], dtype=np.int64)
    w = np.asarray(weights, dtype=float)
    left_of = np.zeros((0, 3), dtype=np.int64)
    first_of, count_of = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    runs: list[Run] = []
    opened = 0
    for length in sorted(histogram, reverse=True):
        demand = np.array([length, 1, length * length], dtype=np.int64)
        if (demand > full_of).any():
            raise ValueError(f"a piece of {length} tokens exceeds a capacity")
        alive = (count_of > 0) & (left_of[:, 0] >= max(1, min(histogram))) & (left_of[:, 1] > 0)
        left_of, first_of, count_of = left_of[alive], first_of[alive], count_of[alive]
        rank, left = 0, histogram[length]
        while left:
            fits = np.flatnonzero((left_of >= demand).all(axis=1) & (count_of > 0))
            if len(fits):
                score = scores(left_of[fits], demand, full_of, w, rule)
                order = np.lexsort((first_of[fits], score))
                g = fits[order[0]]
                residual, first, n = left_of[g].copy(), int(first_of[g]), int(count_of[g])
                count_of[g] = 0
                # The next best: the group's own rest, else the best of the other groups.
                rivals = [(score[order[0]], first + 1)] * (n > 1) + [(score[k], int(first_of[fits[k]])) for k in order[1:2]]
                each, most = 1, int((residual // demand).min())
                if rivals and most > 1:
                    after = residual - demand * np.arange(1, most)[:, None]
                    again = scores(after, demand, full_of, w, rule)
                    while each < most and (again[each - 1], first) < min(rivals):
                        each += 1
                elif not rivals:
                    each = most
            else:
                residual, first = full_of.copy(), opened
                each = int((residual // demand).min())
                n = -(-left // each)
                opened += n
            at = int(capacity - residual[0])
            new = []
            full = min(n, left // each)
            if full:
                runs.append((length, rank, full * each, first, each, at))
                new.append((residual - each * demand, first, full))
                rank, left, first, n = rank + full * each, left - full * each, first + full, n - full
            if 0 < left < each and n:
                runs.append((length, rank, left, first, each, at))
                new.append((residual - left * demand, first, 1))
                rank, left, first, n = rank + left, 0, first + 1, n - 1
            if n:
                new.append((residual, first, n))
            left_of = np.vstack([left_of, *(r[None] for r, _, _ in new)])
            first_of = np.append(first_of, [f for _, f, _ in new])
            count_of = np.append(count_of, [c for _, _, c in new])
    return runs, opened


def placed(pieces: DataFrame, plan, capacity: int) -> DataFrame:
    """Add sequence_id and offset to pieces(length, doc_id, row, piece, ...) by plan(histogram) -> (runs, sequences)."""
    histogram = {int(r["length"]): int(r["n"]) for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    runs, _ = plan(histogram)
    at = sorted(runs)
    of = {n: np.array([r for r in at if r[0] == n], dtype=np.int64) for n in histogram}

    @F.pandas_udf("sequence_id long, offset long")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        sequence, offset = np.zeros(len(rank), dtype=np.int64), np.zeros(len(rank), dtype=np.int64)
        lengths, ranks = length.to_numpy(), rank.to_numpy()
        for n in np.unique(lengths):
            mine = np.flatnonzero(lengths == n)
            run = of[int(n)]
            hit = run[np.searchsorted(run[:, 1], ranks[mine], side="right") - 1]
            j = ranks[mine] - hit[:, 1]
            sequence[mine] = hit[:, 3] + j // hit[:, 4]
            offset[mine] = hit[:, 5] + j % hit[:, 4] * n
        return pd.DataFrame({"sequence_id": sequence, "offset": offset})

    ranks = common.ranked(pieces, "length", ["doc_id", "piece", "row"], histogram)
    return ranks.withColumn("__at", place("length", "__rank")).select("*", "__at.sequence_id", "__at.offset").drop("__at", "__rank")


def vector_pack(docs: DataFrame, tokenizer: str | None = None, capacity: int = 1024, documents: int | None = None, attention: int | None = None, rule: str = "norm", weights: tuple[float, float, float] = (1.0, 0.01, 0.01)) -> DataFrame:
    """Pack docs(doc_id, text) into sequences under token, document-count and attention-cost capacities.

    Defaults for the last two, `capacity` and its square, let the token capacity alone decide how few sequences do.
    Returns a row per piece: doc_id, row, piece, start, length, ids_crc32, sequence_id, offset. Null and empty texts are
    one piece holding the end id; repeated rows are packed each; an empty table gives no rows; other columns are ignored.
    """
    pieces = common.keep(tokens.token_pieces(docs, tokenizer, capacity), "pieces")
    return placed(pieces, lambda h: vector_best_fit(h, capacity, documents or capacity, attention or capacity * capacity, rule, weights), capacity)


def packed_matrices(docs: DataFrame, tokenizer: str | None = None, capacity: int = 2048, rows: int = 64, pad: int = 0) -> DataFrame:
    """Best-fit-decreasing packing of docs(doc_id, text) into id matrices of `rows` sequences x `capacity` ids.

    Returns a row per matrix: block, first_sequence, n_rows, id_bytes (2, or 4 if the tokenizer's vocabulary asks for it),
    ids (binary, n_rows x capacity unsigned little-endian of id_bytes, row-major, padded), row_starts (place in cu_seqlens of each row's first entry), cu_seqlens (by row: 0, then the
    running end of each segment), position_ids (binary, unsigned little-endian 32-bit if capacity exceeds 65,536, else
    16-bit: each segment counts from 0), doc_ids and starts (of
    each segment, in order). Overlong documents are cut into pieces, nothing is lost: see `unpacked`. Null and empty
    texts hold the end id only; an empty table gives no rows; other columns are ignored.
    """
    width = tokens.id_bytes(tokenizer or tokens.default_path())
    kind, place = f"<u{width}", "<u2" if capacity <= 1 << 16 else "<u4"
    pieces = common.keep(tokens.token_pieces(docs, tokenizer, capacity, with_ids=True), "ids")
    where = placed(pieces.drop("ids"), lambda h: best_fit_decreasing(h, capacity), capacity).select("row", "piece", "sequence_id", "offset")
    joined = pieces.select("doc_id", "row", "piece", "start", "ids").join(where, ["row", "piece"])
    by_block = joined.withColumn("block", F.expr(f"sequence_id div {rows}"))
    ready = by_block.repartition("block").sortWithinPartitions("block", "sequence_id", "offset").select("block", "sequence_id", "doc_id", "start", "ids")

    def matrix(block: int, held: list[tuple]) -> dict:
        first = block * rows
        n = max(h[0] for h in held) - first + 1
        ids, positions = np.full((n, capacity), pad, dtype=kind), np.zeros((n, capacity), dtype=place)
        ends: list[int] = []
        starts: list[int] = []
        at, row = 0, -1
        for sequence, _, _, part in held:
            if sequence - first != row:
                row, at = sequence - first, 0
                starts.append(len(ends))
                ends.append(0)
            own = np.frombuffer(part, kind)
            ids[row, at : at + len(own)] = own
            positions[row, at : at + len(own)] = np.arange(len(own))
            at += len(own)
            ends.append(at)
        return {"block": block, "first_sequence": first, "n_rows": n, "id_bytes": width, "ids": ids.tobytes(), "row_starts": starts, "cu_seqlens": ends, "position_ids": positions.tobytes(), "doc_ids": [h[1] for h in held], "starts": [h[2] for h in held]}

    schema = pa.schema([("block", pa.int64()), ("first_sequence", pa.int64()), ("n_rows", pa.int32()), ("id_bytes", pa.int32()), ("ids", pa.binary()), ("row_starts", pa.list_(pa.int32())), ("cu_seqlens", pa.list_(pa.int32())), ("position_ids", pa.binary()), ("doc_ids", pa.list_(pa.int64())), ("starts", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held = None, []
        for batch in batches:
            for b, *values in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if b != block and held:
                    yield pa.RecordBatch.from_pylist([matrix(block, held)], schema=schema)
                    held = []
                block = b
                held.append(tuple(values))
        if held:
            yield pa.RecordBatch.from_pylist([matrix(block, held)], schema=schema)

    return ready.mapInArrow(lambda batches: common.released(run(batches)), "block long, first_sequence long, n_rows int, id_bytes int, ids binary, row_starts array<int>, cu_seqlens array<int>, position_ids binary, doc_ids array<long>, starts array<long>")


def unpacked(matrix, capacity: int) -> list[tuple[int, int, list[int]]]:
    """(doc_id, start, ids) of each segment of a matrix row of `packed_matrices`."""
    ids = np.frombuffer(matrix["ids"], f"<u{matrix['id_bytes']}").reshape(matrix["n_rows"], capacity)
    bounds = [*matrix["row_starts"], len(matrix["cu_seqlens"])]
    spans = [(r, a, b) for r in range(matrix["n_rows"]) for cu in [matrix["cu_seqlens"][bounds[r] : bounds[r + 1]]] for a, b in zip(cu, cu[1:])]
    return [(d, s, ids[r, a:b].tolist()) for (r, a, b), d, s in zip(spans, matrix["doc_ids"], matrix["starts"], strict=True)]
