"""Exact set similarity join on distinct word shingles, by prefixes.

Two sets of Jaccard similarity t or more share at least t of each one's members. So in any one order of all shingles, the
first n - ceil(t n) + 1 of each set have one in common: an equi-join on these proposes every such pair. Shingles that a
sample of the documents repeats come last in the order. That keeps groups small and has no bearing on which pairs are found.

Pairs proposed are discarded by a bound before any set is fetched: members are counted in buckets by their hash, and two
sets share no more than the sum of the lesser counts. Survivors are compared on the sets.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, simhash

#: One in so many rows is sampled for frequent shingles; a shingle is frequent if so many rows of the sample have it.
SAMPLED = 16
OFTEN = 3
#: Frequent shingles that travel to the workers, the most frequent first.
HOT = 500_000
#: Nodes with a shingle in their prefixes, above which they are compared in blocks of so many, so that only pairs that their
#: sketches allow become rows.
CROWD = 64
BLOCK = 1_024


def distinct(text: str, shingle: int) -> np.ndarray:
    """Hashes of a text's distinct word shingles, sorted."""
    return np.unique(simhash.hashes(text, shingle))


def frequent(docs: common.Numbered, shingle: int) -> np.ndarray:
    """Sorted hashes of the shingles that many of the sampled rows have."""
    schema = pa.schema([("shingle", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text in batch.column(0):
                yield pa.record_batch([pa.array(distinct(text.as_py() or "", shingle).view("<i8"))], schema=schema)

    sample = docs.rows.where(F.pmod(F.xxhash64("item"), F.lit(SAMPLED)) == 0).select(F.col("row.text").cast("string").alias("text"))
    counted = sample.mapInArrow(lambda batches: common.released(run(batches)), "shingle long").groupBy("shingle").agg(F.count("*").alias("n")).where(F.col("n") >= OFTEN)
    counted = common.keep(counted, "frequent")
    got = counted.orderBy(F.desc("n"), "shingle").limit(HOT).select("shingle").toArrow()
    return np.sort(got.column("shingle").to_numpy().astype("<i8").view("<u8"))


def prefix(own: np.ndarray, similarity: float, hot: np.ndarray) -> np.ndarray:
    """The first members of a sorted set in the order of all shingles: frequent ones last, then by hash."""
    n = len(own)
    if not n:
        return own
    if len(hot):
        late = hot[np.minimum(np.searchsorted(hot, own), len(hot) - 1)] == own
        own = np.concatenate([own[~late], own[late]])
    return own[: n - math.ceil(similarity * n - 1e-9) + 1]


def sketch(own: np.ndarray) -> bytes | None:
    """Counts of a set's members by the low bits of their hash, a byte each, about two members a bucket; null if a count
    exceeds a byte. `shared` bounds what two sets share by them."""
    buckets = 1 << max(4, (max(len(own), 1) - 1).bit_length() - 1)
    counts = np.bincount((own & np.uint64(buckets - 1)).astype(np.int64), minlength=buckets)
    return counts.astype(np.uint8).tobytes() if counts.max(initial=0) < 256 else None


def shared(a: bytes | None, b: bytes | None, least: int) -> int:
    """At least as many members as two sets share, by their sketches; `least`, the smaller size, if one has none. The
    longer sketch is folded to the shorter: bucket counts add."""
    if a is None or b is None:
        return least
    x, y = (np.frombuffer(s, np.uint8).astype(np.int64) for s in sorted((a, b), key=len))
    return int(np.minimum(x, y.reshape(-1, len(x)).sum(axis=0)).sum())


def profiles(docs: common.Numbered, shingle: int, similarity: float, hot: np.ndarray, more: int) -> DataFrame:
    """item, doc_id, fp, more, node (a hash of the shingle set), size (of that set), prefix, sketch of docs(doc_id, text)."""
    spark = docs.rows.sparkSession
    schema = pa.schema([("item", pa.int64()), ("doc_id", pa.int64()), ("fp", pa.int64()), ("more", pa.list_(pa.int64())), ("node", pa.int64()), ("size", pa.int32()), ("prefix", pa.list_(pa.int64())), ("sketch", pa.binary())])
    known = spark.sparkContext.broadcast(hot)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps, rest, nodes, sizes, firsts, sketches = [], [], [], [], [], []
            for text in batch.column(2):
                h = simhash.hashes(text.as_py() or "", shingle)
                own = np.unique(h)
                fps.append(simhash.majority(h))
                rest.append([simhash.majority(simhash.remixed(h, k)) for k in range(1, more + 1)])
                nodes.append(simhash.signed(xxhash.xxh64_intdigest(own.tobytes(), 7)))
                sizes.append(len(own))
                firsts.append(prefix(own, similarity, known.value).view("<i8"))
                sketches.append(sketch(own))
            yield pa.record_batch([*batch.columns[:2], pa.array(fps, pa.int64()), pa.array(rest, pa.list_(pa.int64())), pa.array(nodes, pa.int64()), pa.array(sizes, pa.int32()), pa.array(firsts, pa.list_(pa.int64())), pa.array(sketches, pa.binary())], schema=schema)

    given = docs.rows.select("item", F.col("row.doc_id").cast("long").alias("doc_id"), F.col("row.text").cast("string").alias("text"))
    return given.mapInArrow(lambda batches: common.released(run(batches)), "item long, doc_id long, fp long, more array<long>, node long, size int, prefix array<long>, sketch binary")


def links(seen: DataFrame, joined: DataFrame, similarity: float) -> DataFrame:
    """All pairs (a, b), b < a, of nodes of different roots that share a shingle of their prefixes and whose sizes allow
    the similarity; seen is profiles' rows, joined has node, sample (the row that stands for the node) and root.

    Two sets share no more from a common shingle on than either has from there, so the first one that they have in common
    stands early enough in both: a pair is taken up where it does. Members that only meet late, as texts around one common
    line do, are not paired.
    """
    stands = seen.join(common.small(joined.select(F.col("sample").alias("item"), "root")), "item")
    stands = common.keep(stands.select("node", "root", "size", "prefix"), "prefixes")
    first = stands.select("node", "root", "size", F.posexplode("prefix").alias("at", "shingle"))
    # Most shingles are of one root, which has nothing left to compare: only the others' rows meet.
    mixed = stands.select("root", F.explode("prefix").alias("shingle")).groupBy("shingle").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count("*").alias("n")).where("lo < hi").select("shingle", "n")
    mixed = common.keep(mixed, "mixed")
    met = common.keep(first.join(common.small(mixed), "shingle"), "met")
    x, y = met.where(F.col("n") <= CROWD).alias("x"), met.where(F.col("n") <= CROWD).alias("y")
    fits = F.least("x.size", "y.size") >= F.lit(similarity) * F.greatest("x.size", "y.size") - 1e-9
    early = F.least(F.col("x.size") - F.col("x.at"), F.col("y.size") - F.col("y.at")) >= F.lit(similarity / (1 + similarity)) * (F.col("x.size") + F.col("y.size")) - 1e-6
    both = (F.col("x.shingle") == F.col("y.shingle")) & (F.col("x.node") > F.col("y.node")) & (F.col("x.root") != F.col("y.root")) & fits & early
    sparse = x.join(y, both).select(F.col("x.node").alias("a"), F.col("y.node").alias("b"))
    crowded = met.where(F.col("n") > CROWD)
    own = common.keep(seen.join(common.small(joined.select(F.col("sample").alias("item"))), "item").select("node", "sketch").join(common.small(crowded.select("node").distinct()), "node"), "crowded")
    return sparse.union(blocks(dealt(crowded).join(common.small(own), "node"), similarity)).distinct()


def dealt(members: DataFrame) -> DataFrame:
    """members(shingle, n, node, root, size, at) of crowded shingles with lo, hi, own: each as often as its block meets one.

    Only members of different roots are compared. The largest root of a shingle has blocks of its own, which meet those of
    the other roots and no others; these meet each other, too. So a family that is one root already, however large, is met
    by the members that are not in it: each of its rows is there once for each block of those. A shingle of at most one
    block's members is one block.
    """
    held = members.groupBy("shingle", "root").agg(F.count("*").alias("rows"))
    largest = common.keep(held.groupBy("shingle").agg(F.max_by("root", F.struct("rows", "root")).alias("main"), F.max("rows").alias("most")), "largest")
    rest, main = F.greatest(F.ceil((F.col("n") - F.col("most")) / BLOCK), F.lit(1)), F.ceil(F.col("most") / BLOCK)
    deal = F.xxhash64("node", "shingle")
    inside = F.col("root") == F.col("main")
    zero = F.lit(0).cast("long")
    one = F.col("n") <= BLOCK
    own = F.when(one, zero).when(inside, rest + F.pmod(deal, main)).otherwise(F.pmod(deal, rest))
    other = F.when(one, F.array(zero)).when(inside, F.sequence(F.lit(0).cast("long"), rest - 1)).otherwise(F.sequence(F.lit(0).cast("long"), rest + main - 1))
    each = common.salted(members, largest, "shingle", "node").withColumn("own", own).withColumn("other", F.explode(other))
    return each.select("shingle", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "own", "node", "root", "size", "at")


def blocks(members: DataFrame, similarity: float) -> DataFrame:
    """Pairs (a, b), b < a, as of `links`, of members(shingle, lo, hi, own, node, root, size, at, sketch) of crowded
    shingles: those that sketches allow. Two blocks of a shingle, or one alone, meet in one call."""

    def work(one: pd.DataFrame) -> pd.DataFrame:
        lo, hi, own = one["lo"].iloc[0], one["hi"].iloc[0], one["own"].to_numpy()
        left, right = np.flatnonzero(own == lo), np.flatnonzero(own == hi)
        node, root, size, at = (one[c].to_numpy() for c in ("node", "root", "size", "at"))
        counts = {n: [] for n in {0 if s is None else len(s) for s in one["sketch"]}}
        for k, s in enumerate(one["sketch"]):
            counts[0 if s is None else len(s)].append(k)
        of = np.zeros(len(one), dtype=np.int64)
        place = np.zeros(len(one), dtype=np.int64)
        tables = {}
        for n, rows in counts.items():
            of[rows], place[rows] = n, np.arange(len(rows))
            tables[n] = np.stack([np.frombuffer(one["sketch"].iloc[k], np.uint8) for k in rows]) if n else None
        found = []
        for k in left:
            need = similarity / (1 + similarity) * (size[k] + size[right]) - 1e-6
            may = (root[right] != root[k]) & (np.minimum(size[k] - at[k], size[right] - at[right]) >= need) & ((node[right] < node[k]) | (lo != hi))
            may &= np.minimum(size[k], size[right]) >= similarity * np.maximum(size[k], size[right]) - 1e-9
            rows, need = right[may], need[may]
            for n in np.unique(of[rows]):
                these, wanted = rows[of[rows] == n], need[of[rows] == n]
                if n and of[k]:
                    mine, theirs = tables[of[k]][place[k]], tables[n][place[these]]
                    width = min(n, of[k])
                    mine, theirs = mine.reshape(-1, width).sum(axis=0, dtype=np.uint16), theirs.reshape(len(these), -1, width).sum(axis=1, dtype=np.uint16)
                    these = these[np.minimum(theirs, mine).sum(axis=1, dtype=np.int64) >= wanted]
                found.append(np.stack([np.full(len(these), node[k]), node[these]]))
        pairs = np.concatenate(found, axis=1) if found else np.zeros((2, 0), dtype=np.int64)
        return pd.DataFrame({"a": pairs.max(axis=0), "b": pairs.min(axis=0)})

    return members.groupBy("shingle", "lo", "hi").applyInPandas(work, "a long, b long")


class Sets:
    """The shingle sets of nodes(node, sample), made again from the texts of only those nodes that are compared; seen is
    profiles' rows."""

    def __init__(self, docs: common.Numbered, nodes: DataFrame, seen: DataFrame, shingle: int, similarity: float):
        self.docs, self.nodes, self.seen, self.shingle, self.similarity = docs, nodes, seen, shingle, similarity

    def possible(self, pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) whose sketches do not rule the similarity out."""
        similarity = self.similarity

        @F.pandas_udf("boolean")
        def may(wa: pd.Series, wb: pd.Series, na: pd.Series, nb: pd.Series) -> pd.Series:
            return pd.Series([shared(x, y, min(n, m)) >= similarity / (1 + similarity) * (n + m) - 1e-6 for x, y, n, m in zip(wa, wb, na, nb)], dtype=bool)

        asked = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
        asked = self.nodes.join(common.small(asked), "node").select("node", F.col("sample").alias("item"))
        own = common.keep(self.seen.select("item", "size", "sketch").join(common.small(asked), "item").select("node", "size", "sketch"), "sketches")
        x, y = (own.select(F.col("node").alias(c), F.col("sketch").alias(f"w{c}"), F.col("size").alias(f"n{c}")) for c in "ab")
        return pairs.join(x, "a").join(y, "b").where(may("wa", "wb", "na", "nb")).select("a", "b")

    def of(self, pairs: DataFrame) -> DataFrame:
        shingle = self.shingle
        schema = pa.schema([("node", pa.int64()), ("own", pa.list_(pa.int64()))])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield pa.record_batch([batch.column(0), pa.array([distinct(t.as_py() or "", shingle).view("<i8") for t in batch.column(1)], pa.list_(pa.int64()))], schema=schema)

        asked = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
        asked = common.keep(self.nodes.join(common.small(asked), "node").select("node", F.col("sample").alias("item")), "asked")
        texts = self.docs.rows.select("item", F.col("row.text").cast("string").alias("text")).join(common.small(asked), "item").select("node", "text")
        return common.keep(texts.mapInArrow(lambda batches: common.released(run(batches)), "node long, own array<long>"), "sets")

    def checked(self, pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) whose sets have the similarity."""
        pairs = common.keep(self.possible(common.keep(pairs.select("a", "b"), "proposed")), "pairs")
        own = self.of(pairs)
        x, y = (own.select(F.col("node").alias(c), F.col("own").alias(w)) for c, w in (("a", "wa"), ("b", "wb")))
        both = F.size(F.array_intersect("wa", "wb"))
        alike = both >= F.lit(self.similarity) * (F.size("wa") + F.size("wb") - both) - 1e-9
        return common.keep(pairs.join(x, "a").join(y, "b").where(alike).select("a", "b"), "checked")
