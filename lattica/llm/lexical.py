"""Ranked lexical search of many items over all documents, by buckets of a window of documents.

The terms that the items ask for are the index's: one pass over the texts writes, for each document, its length, and the
numbers and counts of the asked terms in it. A second pass over that index counts how many documents hold a term. The third
scores: a task takes the documents as they stand, in windows of 32,768 (`WINDOW`), inverts a window to postings, and for each
item walks the postings of its terms, adding their parts of the score into an array of a window's documents, and marking them
in a bitset. What the bitset marks is harvested into the item's heap of k, which goes on to the task's next window.
No document leaves its task but as one of k for an item; the heaps of all tasks are merged in two steps.

Items are taken in blocks of at most about half a million distinct terms, whose number grows with the items, so what is
broadcast is bounded; all documents are read for each block. A window is a task's own, so nothing depends on how common a term
is or on how doc_ids are spread.
"""

from __future__ import annotations

import heapq
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, LongType, StructField, StructType

from . import common

#: Documents of a window: scores and bits of one take 260 KB. Must be a multiple of 64.
WINDOW = 1 << 15
#: Terms of a block of items, about: its dictionary is in every worker.
BLOCK_TERMS = 500_000
#: Bytes of a text that are cut into terms at once.
PIECE = 4 << 20
#: The score's constants: 1000 and 8 scale term counts and lengths, 75 of 100 parts of a length count.
LENGTH_PARTS, ALL_PARTS = 75, 100
#: ASCII but letters and digits ends a term; A-Z count as a-z.
_between = [b for b in range(128) if not chr(b).isalnum()]
_border = re.compile(b"[" + b"".join(b"\\x%02x" % b for b in _between) + b"]")
_as_terms = bytes(32 if b in _between else b + 32 if 65 <= b <= 90 else b for b in range(256))
NULL_ID = (1 << 63) - 1


def terms(text: str) -> Counter:
    """Occurrences of the terms of a whole text, as UTF-8."""
    data, found, at = text.encode(), Counter(), 0
    while at < len(data):
        border = _border.search(data, at + PIECE) if at + PIECE < len(data) else None
        end = border.start() if border else len(data)
        found.update(data[at:end].translate(_as_terms).split())
        at = end
    return found


@dataclass
class Asked:
    """A block of items: numbers of all terms, and the terms of each item with their counts, one item after the other."""

    number: dict[bytes, int]
    items: np.ndarray
    starts: np.ndarray
    own: np.ndarray
    counts: np.ndarray

    @staticmethod
    def of(rows: list) -> Asked:
        number: dict[bytes, int] = {}
        own = [number.setdefault(bytes(t), len(number)) for r in rows for t in r["terms"]]
        lengths = [len(r["terms"]) for r in rows]
        return Asked(number, np.array([r["item"] for r in rows], "int64"), np.concatenate([[0], np.cumsum(lengths)]).astype("int64"), np.array(own, "int64"), np.array([c for r in rows for c in r["counts"]], "int64"))


def read_items(items: DataFrame) -> DataFrame:
    """item, own (the item's id), terms, counts of items(item_id, text), written so that numbers stay."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [terms(t.as_py() or "") for t in batch.column(1)]
            yield pa.record_batch([batch.column(0), pa.array([list(c) for c in found], pa.list_(pa.binary())), pa.array([list(c.values()) for c in found], pa.list_(pa.int64()))], names=["own", "terms", "counts"])

    kind = items.schema["item_id"].dataType
    schema = StructType([StructField("own", kind), StructField("terms", ArrayType(BinaryType())), StructField("counts", ArrayType(LongType()))])
    out = items.select(F.col("item_id").alias("own"), F.col("text").cast("string").alias("text")).mapInArrow(run, schema)
    return common.keep(out.select(F.monotonically_increasing_id().alias("item"), "*"), "lexical-items")


def indexed(docs: DataFrame, number) -> DataFrame:
    """doc_id, n, terms, counts of each document with terms: n of all its terms, and the asked ones as packed integers."""
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("terms", pa.binary()), ("counts", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = number.value.number
        for batch in batches:
            out: list[list] = [[], [], [], []]
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                found = terms(text.as_py() or "")
                if found:
                    asked = sorted((known[t], c) for t, c in found.items() if t in known)
                    for column, v in zip(out, (doc, found.total(), np.array([t for t, _ in asked], "<i4").tobytes(), np.array([c for _, c in asked], "<i4").tobytes()), strict=True):
                        column.append(v)
            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(out, schema, strict=True)], schema=schema)

    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return common.keep(given.mapInArrow(lambda batches: common.released(run(batches)), "doc_id long, n long, terms binary, counts binary"), "lexical-index")


def document_counts(index: DataFrame, n_terms: int) -> tuple[int, int, np.ndarray]:
    """N, L and df: documents, their terms, and the documents of each asked term, summed a task first."""
    schema = pa.schema([("term", pa.int32()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(n_terms, "int64")
        for batch in batches:
            for packed in batch.column(0):
                held[np.frombuffer(packed.as_py(), "<i4")] += 1  # a document has a term once
        some = np.flatnonzero(held)
        yield pa.record_batch([pa.array(some, pa.int32()), pa.array(held[some], pa.int64())], schema=schema)

    df = np.zeros(n_terms, "int64")
    for r in index.select("terms").mapInArrow(run, "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).toLocalIterator():
        df[r["term"]] = r["n"]
    got = index.agg(F.count("*").alias("docs"), F.sum("n").alias("terms")).first()
    return got["docs"], got["terms"] or 0, df


class Search:
    """The heaps of a task's items, filled window by window."""

    def __init__(self, asked: Asked, weights: np.ndarray, docs: int, all_terms: int, k: int):
        self.asked, self.weights, self.docs, self.all_terms, self.k = asked, weights, docs, all_terms, k
        self.heaps: list[list] = [[] for _ in asked.items]
        self.score = np.zeros(WINDOW, "int64")
        self.occupied = np.zeros(WINDOW // 64, "<u8")

    def norms(self, n: np.ndarray) -> np.ndarray:
        """m of documents of n terms; in Python's integers where 64 bits might not do."""
        if LENGTH_PARTS * int(n.max()) * self.docs < 1 << 62:
            return ALL_PARTS - LENGTH_PARTS + LENGTH_PARTS * n * self.docs // self.all_terms
        return np.array([ALL_PARTS - LENGTH_PARTS + LENGTH_PARTS * int(x) * self.docs // self.all_terms for x in n], "int64")

    def window(self, ids: np.ndarray, n: np.ndarray, packed: list[bytes], counts: list[bytes]) -> None:
        """Score the documents of one window, and take the best of each item."""
        found, tf = np.frombuffer(b"".join(packed), "<i4"), np.frombuffer(b"".join(counts), "<i4").astype("int64")
        place = np.repeat(np.arange(len(ids)), [len(p) // 4 for p in packed])
        part = self.weights[found] * (1_000_000_000 * tf // (1000 * tf + 8 * self.norms(n)[place]))
        order = np.argsort(found, kind="stable")
        found, place, part = found[order], place[order], part[order]
        word, bit = place >> 6, np.uint64(1) << (place & 63).astype("<u8")
        a, b = np.searchsorted(found, self.asked.own, "left"), np.searchsorted(found, self.asked.own, "right")
        score, occupied = self.score, self.occupied
        for i, heap in enumerate(self.heaps):
            for k in range(self.asked.starts[i], self.asked.starts[i + 1]):
                if (run := slice(a[k], b[k])).start < run.stop:
                    score[place[run]] += self.asked.counts[k] * part[run]
                    np.bitwise_or.at(occupied, word[run], bit[run])
            marked = np.flatnonzero(np.unpackbits(occupied.view("u1"), bitorder="little"))
            if len(marked):
                self.harvest(heap, ids[marked], score[marked])
                score[marked] = 0
                occupied[:] = 0

    def harvest(self, heap: list, ids: np.ndarray, score: np.ndarray) -> None:
        """Take the k best (score, then smaller id) of a window into a heap whose first entry is the worst."""
        good = score >= max(1, heap[0][0] if len(heap) == self.k else 1)
        ids, score = ids[good], score[good]
        if len(score) > self.k:
            good = score >= np.partition(score, -self.k)[-self.k]
            ids, score = ids[good], score[good]
        for at in np.lexsort((ids, -score))[: self.k]:
            entry = (int(score[at]), -int(ids[at]))
            if len(heap) < self.k:
                heapq.heappush(heap, entry)
            elif entry > heap[0]:
                heapq.heapreplace(heap, entry)


def scored(index: DataFrame, asked, weights, docs: int, all_terms: int, k: int) -> DataFrame:
    """item, doc_id, score: the k best of each task for each item."""
    schema = pa.schema([("item", pa.int64()), ("doc_id", pa.int64()), ("score", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = Search(asked.value, weights.value, docs, all_terms, k)
        ids, n, packed, counts = [], [], [], []

        def flush() -> None:
            if ids:
                search.window(np.array([NULL_ID if d is None else d for d in ids], "int64"), np.array(n, "int64"), packed, counts)
                for held in (ids, n, packed, counts):
                    held.clear()

        for batch in batches:
            for doc, length, t, c in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                ids.append(doc)
                n.append(length)
                packed.append(t)
                counts.append(c)
                if len(ids) == WINDOW:
                    flush()
        flush()
        for item, heap in zip(asked.value.items.tolist(), search.heaps, strict=True):
            if heap:
                yield pa.record_batch([pa.array([item] * len(heap), pa.int64()), pa.array([None if -d == NULL_ID else -d for _, d in heap], pa.int64()), pa.array([s for s, _ in heap], pa.int64())], schema=schema)

    return index.mapInArrow(lambda batches: common.released(run(batches)), "item long, doc_id long, score long")


def best(rows: DataFrame, k: int) -> DataFrame:
    """The k best of each item: of 64 parts of the tasks first, then of what these leave."""
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    parts = rows.withColumn("part", F.pmod(F.spark_partition_id(), F.lit(64)))
    some = parts.withColumn("rank", F.row_number().over(Window.partitionBy("item", "part").orderBy(*order))).where(F.col("rank") <= k)
    return some.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))).where(F.col("rank") <= k).drop("part")


def search(docs: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """item_id, rank, doc_id, score: the k documents of docs(doc_id, text) of the highest score above 0 for each row of
    items(item_id, text), best first, ties by doc_id (null last).

    Terms are runs of ASCII letters and digits and of all other characters beyond ASCII; A-Z count as a-z. With N documents
    that have terms, L terms in all, df documents of a term, n terms of a document and tf occurrences in it, a term weighs
    floor(1000 ln((2 N + 2) / (2 df + 1))) and adds that times (10^9 tf) div (1000 tf + 8 m), m = 25 + (75 n N) div L, as
    often as the item has it. Null and empty texts have no terms: such documents are not found or counted, such items find
    nothing. Repeated rows count and rank each; repeated items have a list each. Empty tables give no rows. Texts are whole.
    """
    spark = docs.sparkSession
    given = read_items(items)
    total = given.agg(F.sum(F.size("terms"))).first()[0] or 0
    blocks = -(-total // BLOCK_TERMS)
    out = []
    for block in range(blocks):
        asked = Asked.of(given.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == block).collect())
        shared = spark.sparkContext.broadcast(asked)
        index = indexed(docs, shared)
        n_docs, n_terms, df = document_counts(index, len(asked.number))
        weights = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(d) + 1))) for d in df], "int64")
        out.append(common.keep(best(scored(index, shared, spark.sparkContext.broadcast(weights), n_docs, n_terms, k), k), "lexical-best"))
    if not out:
        return given.limit(0).select(F.col("own").alias("item_id"), F.lit(0).alias("rank"), F.lit(0).cast("long").alias("doc_id"), F.lit(0).cast("long").alias("score"))
    found = out[0]
    for more in out[1:]:
        found = found.union(more)
    return found.join(common.small(given.select("item", "own")), "item").select(F.col("own").alias("item_id"), "rank", "doc_id", "score")
