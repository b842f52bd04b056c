"""Mixing sources to target weights by weighted fair queueing.

Within a source, documents stand in a shuffled order, repeated whole up to `most` times. A document's virtual finish
time is the source's words up to and with it, divided by the source's target: all sources run at the speed of their
weight. The schedule of all sources is sorted by finish time, and the mix is what stands within the budget, the words of
all documents: the sort decides which documents get in, the budget where the last one is cut.

At time 1 each source has served its target and all together the budget, but for the document that each has in service
then. Documents that finish by then stand whole in the schedule; the one in service is served in quanta of QUANTUM words,
each with a finish time of its own, so that no long document takes the words of other sources, nor is left out whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from . import common

#: Rows of one range: what one task sorts.
RANGE_ROWS = 100_000
#: Words served at once of a document in service when its source's target is reached.
QUANTUM = 64
#: Seed of the shuffle within a source.
SEED = 42


def targets(sizes: list[tuple], weights: tuple[float, ...], most: float) -> list[tuple]:
    """(source, size, target): the total shared by weight, no target above `most` times its source's size."""
    order = sorted(sizes, key=lambda s: (s[0] is None, s[0] or ""))
    weight = {s: weights[k % len(weights)] for k, (s, _) in enumerate(order)}
    left, open_, target = float(sum(n for _, n in order)), dict(order), {}
    while open_:
        total = sum(weight[s] for s in open_)
        full = [s for s, n in open_.items() if left * weight[s] / total > most * n]
        if not full:
            target |= {s: left * weight[s] / total for s in open_}
            break
        for s in full:
            target[s] = most * float(open_.pop(s))
        left = float(sum(n for _, n in order)) - sum(target.values())
    return [(s, n, target[s]) for s, n in order]


def words(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(common.WORD)).cast("long")


def shuffle_key(seed: int) -> Column:
    """A uniform number below 2^60 from id and text: 15 digits of MD5, which SQL engines share."""
    name = F.concat_ws("\0", F.lit(str(seed)), F.coalesce(F.col("row.doc_id").cast("long").cast("string"), F.lit("")), F.coalesce(F.col("row.text"), F.lit("")))
    return F.conv(F.substring(F.md5(name), 1, 15), 16, 10).cast("long")


def ranged(df: DataFrame, rows: int, order: list[Column]) -> DataFrame:
    """df with `part`, the range of `order` a row is in: ranges stand in order, are about even, and are dealt by Spark's own
    sampling of all the order columns, so rows equal in the first ones are told apart by the rest. Written."""
    parts = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows // RANGE_ROWS))
    return common.keep(df.repartitionByRange(parts, *order).withColumn("part", F.spark_partition_id()), "ranged")


def running(df: DataFrame, of: str, order: list[Column], key: str | None = None) -> DataFrame:
    """ranged df with `before`: the sum of `of` over the rows before it in order (of the same `key`)."""
    keys = [key] if key else []
    sums = df.groupBy(*keys, "part").agg(F.sum(of).alias("words"))
    # One row a part (and key in it): at most RANGE_ROWS times fewer than there are rows, or the number of keys.
    earlier = Window.partitionBy(*keys).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(*(F.col(k).alias("__k") for k in keys), F.col("part").alias("__p"), F.coalesce(F.sum("words").over(earlier), F.lit(0)).alias("__start"))
    inner = Window.partitionBy("part", *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    met = F.col("part") == F.col("__p")
    met = met & F.col(key).eqNullSafe(F.col("__k")) if key else met
    summed = df.withColumn("__inner", F.coalesce(F.sum(of).over(inner), F.lit(0))).join(common.small(starts), met)
    return summed.withColumn("before", F.col("__inner") + F.col("__start")).drop("__inner", "__start", "__p", "__k")


def schedule(docs: DataFrame | common.Numbered, weights: tuple[float, ...] = (5, 2, 1), most: int = 3, seed: int = SEED, quantum: int = QUANTUM) -> tuple[DataFrame, DataFrame]:
    """(items, schedule) of docs(doc_id, text, source).

    items: item, doc_id, size, source_size, target of each row (item numbers the rows: repeated or null ids stay apart).
    schedule: item, epoch, begin, words, finish, offset, taken: what the sources serve until each reaches its target, in
    order of finish; offset is the words before an entry, taken those of its words that the budget holds. Ties of finish
    go by source, then place. A source leaves the queue with the entry that reaches its target. Null text has size 0; null source is a source, last in order; documents without words are not scheduled; an
    empty table gives empty frames. Sources are held on the driver, a few numbers each.
    """
    spark = docs.rows.sparkSession if isinstance(docs, common.Numbered) else docs.sparkSession
    sized = common.rows(docs).select("item", F.col("row.doc_id").cast("long").alias("doc_id"), F.col("row.source").cast("string").alias("source"), words(F.col("row.text")).alias("size"), shuffle_key(seed).alias("key"))
    base = common.keep(sized, "mix")
    per = base.groupBy("source").agg(F.sum("size").alias("size"), F.count_if(F.col("size") > 0).alias("n")).collect()
    shares = targets([(r["source"], r["size"]) for r in per], weights, most)
    sources = spark.createDataFrame([(k, *s) for k, s in enumerate(shares)], "place long, source string, source_size long, target double")
    met = base["source"].eqNullSafe(sources["source"])
    items = base.join(common.small(sources), met).drop("source")
    rows = sum(r["n"] for r in per)
    order = [F.col("place"), F.col("key"), F.xxhash64("item")]
    queued = ranged(items.where("size > 0").select("item", "place", "key", "size", "source_size", "target"), rows, order)
    queued = running(queued, "size", order, "place").drop("part")
    epochs = queued.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(most - 1)))).withColumn("begin", F.col("epoch") * F.col("source_size") + F.col("before")).where("begin < target")
    quanta = F.when(F.col("begin") + F.col("size") <= F.col("target"), F.array(F.lit(0).cast("long"))).otherwise(F.sequence(F.lit(0).cast("long"), F.col("size") - 1, F.lit(quantum).cast("long")))
    entries = epochs.withColumn("__from", F.explode(quanta))
    served = F.when(F.col("begin") + F.col("size") <= F.col("target"), F.col("size")).otherwise(F.least(F.lit(quantum), F.col("size") - F.col("__from")))
    entries = entries.withColumn("words", served).withColumn("begin", F.col("begin") + F.col("__from")).where("begin < target")
    entries = entries.select("item", "epoch", "begin", "words", ((F.col("begin") + F.col("words")) / F.col("target")).alias("finish"), "place")
    order = [F.col("finish"), F.col("place"), F.col("begin")]
    sorted_ = running(ranged(entries, rows * most, order), "words", order).withColumnRenamed("before", "offset")
    budget = sum(n for _, n, _ in shares)
    taken = F.least("words", F.greatest(F.lit(budget) - F.col("offset"), F.lit(0)))
    return items.select("item", "doc_id", "size", "source_size", "target"), sorted_.select("item", "epoch", "begin", "words", "finish", "offset", taken.alias("taken"))


def mix(docs: DataFrame | common.Numbered, weights: tuple[float, ...] = (5, 2, 1), most: int = 3, seed: int = SEED, quantum: int = QUANTUM) -> DataFrame:
    """A row per row of docs(doc_id, text, source): item, doc_id, size, source_size, target and the words taken, repeats
    counted, by the `schedule`.

    Each source's words differ from its target by less than `quantum` (and by what the budget cuts of the last entry), and
    no document is taken more than `most` times. Null text has size 0 and nothing is taken of it; null and repeated ids
    stay rows; an empty table gives no rows; other columns are ignored, whatever their names.
    """
    items, entries = schedule(docs, weights, most, seed, quantum)
    taken = entries.groupBy("item").agg(F.sum("taken").alias("taken"))
    return items.join(taken, "item", "left").withColumn("taken", common.whole_number(F.col("taken")))
