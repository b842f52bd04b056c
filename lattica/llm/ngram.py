"""Quality classifier: perplexity under an interpolated modified Kneser-Ney n-gram model of trusted text.

Words are of open vocabulary and scripts have tens of thousands of characters, so the model's symbols are the bytes of
UTF-8: order 5, no symbol is unknown and none stands for two. A gram is one long of 9 bits a symbol. Log probabilities are
held as whole numbers of 2^-20, so a text's total is the same sum in any order and on either way of looking grams up.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

ORDER = 5
#: Bits of a symbol: 0 stands before a text's beginning, bytes are one more.
BITS = 9
#: A log probability of 1 is so many units.
UNITS = 1 << 20
#: Grams looked up in a broadcast table up to here (12 bytes each); beyond, documents' grams are joined to it by shuffle,
#: with the same totals.
TABLE_ROWS = 6_000_000
#: Bytes worked on at once.
CHUNK = 500_000
#: Distinct grams a task holds before it sends them on.
HELD = 1_500_000


def grams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All grams of the texts, each padded with ORDER - 1 starts, and the number of grams of each text."""
    sizes = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
    pad = ORDER - 1
    total = int(sizes.sum()) + pad * len(texts)
    out = np.zeros(total, dtype=np.int64)
    ends = np.cumsum(sizes + pad)
    own = np.ones(total, dtype=bool)
    begins = ends - sizes - pad
    for k in range(pad):
        own[begins + k] = False
    out[own] = np.frombuffer(b"".join(texts), dtype=np.uint8).astype(np.int64) + 1
    g = np.zeros(total, dtype=np.int64)
    for k in range(pad, -1, -1):
        g <<= BITS
        g[k:] |= out[: total - k]
    return g[own], sizes


def utf8(text: pa.StringScalar) -> bytes:
    return (text.as_py() or "").encode("utf-8", "surrogatepass")


def chunks(texts: list[bytes]) -> Iterator[list[bytes]]:
    """Texts in lists of about CHUNK bytes; a longer text stands alone."""
    held, n = [], 0
    for t in texts:
        if held and n + len(t) > CHUNK:
            yield held
            held, n = [], 0
        held.append(t)
        n += len(t)
    if held:
        yield held


def merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys = np.concatenate([k for k, _ in parts])
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], np.concatenate([c for _, c in parts])[order]
    at = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, dtype=np.int64)
    return keys[at], np.add.reduceat(counts, at) if len(at) else counts


def count_grams(docs: DataFrame) -> DataFrame:
    """gram, n of docs(trusted, text): every gram of every text, n its count in the trusted texts."""
    schema = pa.schema([("gram", pa.int64()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[tuple[np.ndarray, np.ndarray]] = []
        held = 0
        for batch in batches:
            flags = np.array([bool(x) for x in batch.column(0).to_pylist()], dtype=bool)
            for trusted in (False, True):
                for texts in chunks([utf8(t) for t in batch.column(1).filter(pa.array(flags == trusted))]):
                    keys, counts = np.unique(grams(texts)[0], return_counts=True)
                    parts.append((keys, counts * trusted))
                    held += len(keys)
                    if held > HELD:
                        parts = [merged(parts)]
                        held = len(parts[0][0])
                        if held > HELD // 2:
                            yield pa.record_batch([pa.array(x) for x in parts.pop()], schema=schema)
                            held = 0
        if parts:
            yield pa.record_batch([pa.array(x) for x in merged(parts)], schema=schema)

    return docs.select("trusted", "text").mapInArrow(lambda batches: common.released(run(batches)), "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))


def discounts(counts: list[int]) -> tuple[float, float, float]:
    """D1, D2, D3+ of modified Kneser-Ney from the numbers of grams seen once to four times."""
    n1, n2, n3, n4 = (max(c, 1) for c in counts)
    y = n1 / (n1 + 2 * n2)
    return tuple(min(max(k - (k + 1) * y * b / a, 0.05), k - 0.05) for k, a, b in ((1, n1, n2), (2, n2, n3), (3, n3, n4)))


def low(gram: Column, n: int) -> Column:
    return gram.bitwiseAND(F.lit((1 << (BITS * n)) - 1))


def log_table(counted: DataFrame) -> DataFrame:
    """gram, lp: the natural log probability of each counted gram's last symbol after the others, in UNITS.

    The counts of each order (at the lower ones: of distinct left neighbours), their contexts' totals and the corpus'
    grams meet in joins sharded by gram or context. p = max(c - D, 0) / total + gamma(context) * p of the next lower
    order, down to a uniform one.
    """
    level = counted.where("n > 0").select("gram", F.col("n").alias("c"))
    scored, below = counted.select("gram"), []
    for n in range(ORDER, 0, -1):
        level = common.keep(level, f"order{n}")
        of = level.agg(*(F.count_if(F.col("c") == k).alias(f"n{k}") for k in (1, 2, 3, 4)), F.count("*").alias("types")).first()
        below.append((n, level, discounts([of[f"n{k}"] for k in (1, 2, 3, 4)]), of["types"]))
        level = level.select(low(F.col("gram"), n - 1).alias("gram")).groupBy("gram").agg(F.count("*").alias("c"))
    p = F.lit(1.0 / (below[-1][3] + 1))
    scored = scored.withColumn("p", p)
    for n, counts, (d1, d2, d3), _ in reversed(below):
        c = F.col("c")
        cut = F.when(c == 1, d1).when(c == 2, d2).otherwise(d3)
        context = F.shiftright("gram", BITS)
        totals = counts.groupBy(context.alias("context")).agg(F.sum("c").alias("total"), (F.sum(F.least(c.cast("double"), cut))).alias("mass"))
        totals = totals.select("context", "total", (F.col("mass") / F.col("total")).alias("gamma"))
        seen = counts.select(F.col("gram").alias("__gram"), "c")
        scored = scored.join(common.small(seen), low(F.col("gram"), n) == F.col("__gram"), "left").drop("__gram")
        scored = scored.join(common.small(totals), F.shiftright(low(F.col("gram"), n), BITS) == F.col("context"), "left").drop("context")
        own = F.coalesce(F.greatest(c - cut, F.lit(0.0)) / F.col("total"), F.lit(0.0))
        # Written at each order: one plan of all ten joins is planned again on the driver after each of its many stages.
        scored = common.keep(scored.select("gram", (own + F.coalesce("gamma", F.lit(1.0)) * F.col("p")).alias("p")), f"upto{n}")
    return scored.select("gram", F.round(F.log("p") * UNITS).cast("int").alias("lp"))


class Lookup:
    """Open table of grams: a first probe by multiplication, the rest by binary search."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        bits = max(4, int(2 * len(keys)).bit_length())
        self.shift = np.uint64(64 - bits)
        self.keys, self.values = np.full(1 << bits, -1, dtype=np.int64), np.zeros(1 << bits, dtype=np.int32)
        slot = self.slots(keys)
        self.keys[slot], self.values[slot] = keys, values
        late = np.flatnonzero(self.keys[slot] != keys)
        order = late[np.argsort(keys[late])]
        self.rest, self.rest_values = keys[order], values[order]

    def slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        slot = self.slots(keys)
        out = self.values[slot]
        miss = np.flatnonzero(self.keys[slot] != keys)
        if len(miss):
            out[miss] = self.rest_values[np.searchsorted(self.rest, keys[miss])]
        return out


def scores(docs: DataFrame, table: DataFrame, table_rows: int = TABLE_ROWS) -> DataFrame:
    """item, doc_id, lang, total (log probability in UNITS), n (symbols) of docs(item, doc_id, lang, text), given log_table's rows for all their grams."""
    spark = docs.sparkSession
    if table.limit(table_rows + 1).count() <= table_rows:
        got = table.toArrow()
        shared = spark.sparkContext.broadcast((got.column("gram").to_numpy(), got.column("lp").to_numpy()))
        del got
        common.give_back()
        held: list[Lookup] = []
        schema = pa.schema([("item", pa.int64()), ("doc_id", pa.int64()), ("lang", pa.string()), ("total", pa.int64()), ("n", pa.int64())])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            if not held:
                held.append(Lookup(*shared.value))
            for batch in batches:
                totals, sizes = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
                for texts in chunks([utf8(t) for t in batch.column(3)]):
                    keys, n = grams(texts)
                    lp = np.concatenate([[0], np.cumsum(held[0](keys), dtype=np.int64)])
                    ends = np.cumsum(n)
                    totals.append(lp[ends] - lp[ends - n])
                    sizes.append(n)
                yield pa.record_batch([*batch.columns[:3], pa.array(np.concatenate(totals)), pa.array(np.concatenate(sizes))], schema=schema)

        return docs.select("item", "doc_id", "lang", "text").mapInArrow(lambda batches: common.released(run(batches)), "item long, doc_id long, lang string, total long, n long")

    schema = pa.schema([("item", pa.int64()), ("gram", pa.int64()), ("n", pa.int64())])

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                keys, n = np.unique(grams([utf8(text)])[0], return_counts=True)
                yield pa.record_batch([pa.array(np.full(len(keys), item)), pa.array(keys), pa.array(n)], schema=schema)

    own = docs.select("item", "text").mapInArrow(lambda batches: common.released(spread(batches)), "item long, gram long, n long")
    summed = own.join(table, "gram").groupBy("item").agg(F.sum(F.col("n") * F.col("lp")).alias("total"), F.sum("n").alias("n"))
    return docs.select("item", "doc_id", "lang").join(summed, "item", "left").select("item", "doc_id", "lang", common.whole_number(F.col("total")).alias("total"), common.whole_number(F.col("n")).alias("n"))


def classify(docs: DataFrame | common.Numbered, labels: DataFrame, quantile: float = 0.99, margin: float = 1.25, held_out: int = 10, least: int = 20, table_rows: int = TABLE_ROWS) -> DataFrame:
    """item, doc_id, lang, symbols, perplexity, threshold, kept of each row of docs(doc_id, text, lang).

    Trusted text is that of documents with quality 1 and toxic 0 in labels(doc_id, quality, toxic); one in `held_out` of
    them (by hash of the id) is kept out of training. A language's threshold is `margin` times the `quantile` of its
    held-out perplexities; a language with fewer than `least` of them, and null, take that of all languages. Without any
    trusted text nothing is rejected. Null and empty texts have no perplexity and are not kept; repeated rows and null
    ids stay rows; an empty table gives no rows; other columns are ignored.
    """
    trusted = labels.where("quality = 1 AND coalesce(toxic, 0) = 0").select(F.col("doc_id").cast("long").alias("doc_id")).where("doc_id IS NOT NULL").distinct().withColumn("trusted", F.lit(True))
    given = common.rows(docs).select("item", F.col("row.doc_id").cast("long").alias("doc_id"), F.col("row.lang").cast("string").alias("lang"), F.col("row.text").cast("string").alias("text"))
    marked = given.join(common.small(trusted), "doc_id", "left").withColumn("trusted", F.coalesce("trusted", F.lit(False)))
    out_of = F.pmod(F.xxhash64("doc_id"), F.lit(held_out)) == 0
    counted = common.keep(count_grams(marked.select((F.col("trusted") & ~out_of).alias("trusted"), "text")), "grams")
    table = common.keep(log_table(counted), "log")
    seen = common.keep(scores(given, table, table_rows), "scores")
    seen = seen.withColumn("perplexity", F.when(F.col("n") > 0, F.exp(-F.col("total") / F.col("n") / UNITS)))
    calibration = seen.join(common.small(trusted), "doc_id").where(out_of & F.col("perplexity").isNotNull())
    level = F.percentile_approx("perplexity", quantile, 10_000)
    per = calibration.groupBy("lang").agg(F.count("*").alias("__n"), level.alias("__q")).where((F.col("__n") >= least) & F.col("lang").isNotNull()).select("lang", (F.col("__q") * margin).alias("__own"))
    overall = calibration.agg(level.alias("q")).first()["q"]
    overall = F.lit(None).cast("double") if overall is None else F.lit(overall * margin)
    judged = seen.join(common.small(per), "lang", "left").withColumn("threshold", F.coalesce("__own", overall))
    kept = F.col("perplexity").isNotNull() & (F.col("threshold").isNull() | (F.col("perplexity") <= F.col("threshold")))
    return judged.select("item", "doc_id", "lang", F.col("n").alias("symbols"), "perplexity", "threshold", kept.alias("kept"))

