"""Nearest neighbours by a block matrix join.

Queries and candidates are dealt to blocks; every pair of a query block and a candidate block is a tile. In a tile both
sides are int8 codes with a scale per vector; one integer matrix product gives all approximate distances, and the two
quantisation errors (norms of what the codes miss) bound how far each is off. What no bound excludes is recomputed in
double precision, and heaps keep the best k: first in a tile, then over a query's tiles. So a tile sends k rows a query
on, however many vectors are equal or nearly so. Blocks are large, as each vector travels once for every block of the
other side, in the table's own precision.
"""

from __future__ import annotations

import heapq

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

QUERY_BLOCK = 4_096
CANDIDATE_BLOCK = 16_384
#: Queries whose distances to a candidate block are held at once.
AT_ONCE = 128
_kinds = {"query": "int64", "query_id": "int64", "score": "float64", "vec_id": "int64", "item": "int64"}


def usable(e: Column) -> Column:
    """Not null, not empty, not zero, all components there and finite."""
    fine = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(e.isNotNull() & fine & F.exists(e, lambda x: x != 0), F.lit(False))


def codes(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """int8 codes, scale of each row, and the norm of the part that the codes miss."""
    scale = np.abs(x).max(axis=1) / 127
    scale[scale == 0] = 1
    q = np.rint(x / scale[:, None])
    return q.astype(np.int8), scale, np.sqrt(((x - q * scale[:, None]) ** 2).sum(axis=1))


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Integer product of int8 matrices; float32 holds every partial sum exactly up to 1040 columns."""
    kind = np.float32 if a.shape[1] <= 1040 else np.float64
    return (a.astype(kind) @ b.astype(kind).T).astype(np.float64)


def euclidean(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances of matching rows, components summed in order."""
    total = np.zeros(len(a))
    for k in range(a.shape[1]):
        d = a[:, k] - b[:, k]
        total += d * d
    return np.sqrt(total)


def tile(queries: pd.DataFrame, candidates: pd.DataFrame, k: int) -> pd.DataFrame:
    """query, query_id, score, vec_id, item of the k nearest candidates(item, vec_id, v) to each of queries(query,
    query_id, v); a candidate whose item is the query's is left out."""
    own, ids = queries["query"].to_numpy(), queries["query_id"].to_numpy()
    items, others = candidates["item"].to_numpy(), candidates["vec_id"].to_numpy()
    x, y = (np.stack(list(f["v"])).astype(np.float64) for f in (queries, candidates))
    (qx, sx, ex), (qy, sy, ey) = codes(x), codes(y)
    size_x, size_y = ((q.astype(np.float64) ** 2).sum(axis=1) * s * s for q, s in ((qx, sx), (qy, sy)))
    slack = 1e-6 * (np.sqrt(size_x).max() + np.sqrt(size_y).max())
    out: list[tuple[int, int, float, int, int]] = []
    for at in range(0, len(ids), AT_ONCE):
        rows = slice(at, at + AT_ONCE)
        near = size_x[rows, None] + size_y[None] - 2 * product(qx[rows], qy) * sx[rows, None] * sy[None]
        near = np.sqrt(np.maximum(near, 0))
        off = ex[rows, None] + ey[None] + slack
        near[own[rows, None] == items[None]] = np.inf
        high = near + off
        limit = np.partition(high, k - 1, axis=1)[:, k - 1] if high.shape[1] > k else np.full(len(high), np.finfo(float).max)
        q, c = np.nonzero(near - off <= limit[:, None])
        scores = np.concatenate([euclidean(x[at + q[i : i + 200_000]], y[c[i : i + 200_000]]) for i in range(0, max(len(q), 1), 200_000)])
        ends = np.searchsorted(q, np.arange(len(near) + 1))
        for i in range(len(near)):
            mine = c[ends[i] : ends[i + 1]]
            best = heapq.nsmallest(k, zip(scores[ends[i] : ends[i + 1]].tolist(), others[mine].tolist(), items[mine].tolist()))
            out += [(int(own[at + i]), int(ids[at + i]), *b) for b in best]
    return pd.DataFrame(out, columns=list(_kinds)).astype(_kinds)


def search(vectors: DataFrame, is_query: Column, k: int = 10) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest of vectors(vec_id, embedding) by Euclidean distance to each query row.

    is_query is a condition on vec_id. All rows but the query's own are candidates, others of its id included; repeated
    query rows have a list each. Vectors that are null, empty, zero, or hold a null or non-finite component take no part,
    nor do null ids; vectors of another length than the query's are not compared. Ties go to the smaller vec_id. Other
    columns are ignored, whatever their names; an empty table gives no rows.
    """
    floats = dict(vectors.dtypes)["embedding"] == "array<float>"
    v = F.col("row.embedding") if floats else F.col("row.embedding").cast("array<double>")
    given = common.rows(vectors).select("item", F.col("row.vec_id").cast("long").alias("vec_id"), v.alias("v"))
    given = common.keep(given.where(F.col("vec_id").isNotNull() & usable(F.col("v"))), "vectors").withColumn("dim", F.size("v"))
    queries = given.where(is_query).withColumnsRenamed({"item": "query", "vec_id": "query_id"})
    n, m = given.count(), queries.count()
    wide, tall = max(1, -(-m // QUERY_BLOCK)), max(1, -(-n // CANDIDATE_BLOCK))
    each = lambda count: F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
    # Dealt by row number: equal vectors and ids spread evenly.
    left = queries.withColumn("qb", F.pmod(F.xxhash64("query"), F.lit(wide))).withColumn("cb", each(tall))
    right = given.withColumn("cb", F.pmod(F.xxhash64("item"), F.lit(tall))).withColumn("qb", each(wide))
    keys = [F.col("dim"), F.col("qb").cast("long").alias("qb"), F.col("cb").cast("long").alias("cb")]
    left, right = left.select("query", "query_id", "v", *keys), right.select("item", "vec_id", "v", *keys)

    def work(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if a.empty or b.empty:
            return pd.DataFrame({c: pd.Series(dtype=t) for c, t in _kinds.items()})
        return tile(a, b, k)

    parts = left.groupBy("dim", "qb", "cb").cogroup(right.groupBy("dim", "qb", "cb")).applyInPandas(work, "query long, query_id long, score double, vec_id long, item long")
    schema = pa.schema([("query_id", pa.int64()), ("rank", pa.int32()), ("vec_id", pa.int64()), ("score", pa.float64())])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come query by query: one heap of k at a time, its greatest on top."""
        query, id_, heap = None, None, []

        def done() -> pa.RecordBatch:
            best = sorted((-s, -v, -i) for s, v, i in heap)
            return pa.record_batch([[id_] * len(best), range(1, len(best) + 1), [v for _, v, _ in best], [s for s, _, _ in best]], schema=schema)

        for batch in batches:
            for q, own, s, v, i in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if q != query:
                    if heap:
                        yield done()
                    query, id_, heap = q, own, []
                if len(heap) < k:
                    heapq.heappush(heap, (-s, -v, -i))
                elif (-s, -v, -i) > heap[0]:
                    heapq.heapreplace(heap, (-s, -v, -i))
        if heap:
            yield done()

    together = parts.repartition("query").sortWithinPartitions("query")
    return together.mapInArrow(merge, "query_id long, rank int, vec_id long, score double")
