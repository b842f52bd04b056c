"""A Merkle manifest of a dataset: a tree of SHA-256 digests for each source, and one over the sources' roots.

A row is a leaf. The leaves of a source, by doc_id, stand in arrays of 256 (`BLOCK`), which higher-order functions collapse
by two levels of 16 (`FAN`) in place: `sequence` names the runs, `slice` cuts them, `transform` digests each. The roots of
the arrays are the leaves of the next, 256 times smaller, round. On the way down each array takes the path of its root from
the round above, so a leaf's path is its own two levels and what all of its array share; `aggregate` folds a path up to the
root. Texts are read once; afterwards only digests are shuffled and written. The rounds are few (log 256 of the rows), and no
array holds more than 256 rows, whatever share of them a source has.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import keep, salted, small

FAN = 16
#: Levels that one array collapses in place, and its leaves.
LEVELS = 2
BLOCK = FAN**LEVELS
#: What a leaf is made of, in this order.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
CAPITALS, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PATH = "array<struct<left: string, right: string>>"


def digest(*parts: Column) -> Column:
    """Lowercase hex SHA-256 of the UTF-8 bytes of the texts, one after the other."""
    return F.sha2(F.concat(*parts), 256)


def encoded(value: Column) -> Column:
    """`-` for null, else the number of UTF-8 bytes, a colon and the value, so that no two lists of values read alike."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(**other: Column) -> Column:
    """The digest of a row's FIELDS; `other` gives values in place of a column's."""
    return digest(*(encoded(other.get(c, F.col(c))) for c in FIELDS))


def lowered_fifth() -> Column:
    """A tampered text to try a manifest with: a fifth of the rows (by the CRC-32 of doc_id) have A-Z lower-cased."""
    chosen = F.coalesce(F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")) % 5 == 0, F.lit(False))
    return F.when(chosen, F.translate("text", CAPITALS, SMALL)).otherwise(F.col("text"))


def placed(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """rows(group, ...) with the place of each in its group, from 0, and n, the rows of the group.

    The rows are sorted by ranges and written; a row's place is its number in the file less that of the group's first row
    there, and the group's rows in earlier ranges. `order` should tell all rows apart, so that a range is never one key.
    """
    spark = rows.sparkSession
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    ranges = rows.repartitionByRange(parts, "group", *order).sortWithinPartitions("group", *order)
    written = keep(ranges.withColumns({"part": F.spark_partition_id(), "at": F.monotonically_increasing_id()}), name)
    held = written.groupBy("group", "part").agg(F.min("at").alias("first"), F.count("*").alias("rows"))
    own = Window.partitionBy("group")
    earlier = F.coalesce(F.sum("rows").over(own.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = held.select("group", "part", "first", earlier.alias("start"), F.sum("rows").over(own).alias("n"))
    return written.join(small(starts), ["group", "part"]).withColumn("place", F.col("at") - F.col("first") + F.col("start")).drop("part", "at", "first", "start")


def collapsed(nodes: Column) -> Column:
    """The digests of the runs of FAN nodes, the last one shorter."""
    runs = F.sequence(F.lit(0), F.floor((F.size(nodes) - 1) / FAN).cast("int"))
    return F.transform(runs, lambda r: F.sha2(F.array_join(F.slice(nodes, r * FAN + 1, FAN), ""), 256))


def blocks(nodes: DataFrame, carried: list[str], name: str) -> DataFrame:
    """group, block, n, rows, level0 to level2 of nodes(group, place, n, node, *carried): arrays of up to BLOCK nodes by place.

    A level is collapsed only while the whole group has more than one node there; so a small group stops early, and a last
    array with one node is collapsed like the others.
    """
    gathered = nodes.groupBy("group", F.floor(F.col("place") / BLOCK).alias("block")).agg(F.max("n").alias("n"), F.array_sort(F.collect_list(F.struct("place", "node", *carried))).alias("rows"))
    out = gathered.withColumn("level0", F.col("rows.node"))
    for k in range(LEVELS):
        below = F.col(f"level{k}")
        out = out.withColumn(f"level{k + 1}", F.when(F.col("n") > FAN**k, collapsed(below)).otherwise(below))
    return keep(out, name)


def siblings(nodes: Column, at: Column) -> Column:
    """The digests left and right of node `at` (from 0) in its run, joined."""
    before = at % FAN
    left, right = F.slice(nodes, at - before + 1, before), F.slice(nodes, at + 2, FAN - 1 - before)
    return F.struct(F.array_join(left, "").alias("left"), F.array_join(right, "").alias("right"))


def own_path(at: Column) -> Column:
    """The siblings of an array's node `at` on the levels that the array collapses."""
    steps = [siblings(F.col(f"level{k}"), F.floor(at / FAN**k).cast("int")) for k in range(LEVELS)]
    used = reduce(lambda a, k: F.when(F.col("n") <= FAN**k, k).otherwise(a), reversed(range(LEVELS)), F.lit(LEVELS))
    return F.slice(F.array(*steps), 1, used)


def rising(nodes: DataFrame, name: str) -> DataFrame:
    """group, place, root, path of nodes(group, place, n, node): one round of arrays, and the rounds above their roots."""
    most = nodes.agg(F.max("n")).first()[0] or 0
    if most <= 1:
        return nodes.select("group", "place", F.col("node").alias("root"), F.array().cast(PATH).alias("path"))
    held = blocks(nodes, [], f"{name}-nodes")
    joined = held.join(small(above(held, name)), ["group", "block"])
    each = F.transform(F.sequence(F.lit(0), F.size("level0") - 1), lambda p: F.struct((F.col("block") * BLOCK + p).alias("place"), F.concat(own_path(p), F.col("path")).alias("path")))
    return keep(joined.select("group", "root", F.inline(each)), f"{name}-paths")


def above(held: DataFrame, name: str) -> DataFrame:
    """group, block, root, path: what leads from the root of each array up to its group's root."""
    parents = held.select("group", F.col("block").alias("place"), F.ceil(F.col("n") / BLOCK).alias("n"), F.col(f"level{LEVELS}")[0].alias("node"))
    return rising(parents, name).withColumnRenamed("place", "block")


def manifest(docs: DataFrame, seen: Column | None = None, paths: bool = False) -> DataFrame:
    """doc_id, source, leaf, subroot, root, proof_sha256, folded_root, verified[, path] of each row of docs.

    leaf: the digest of the row's FIELDS. subroot: the root of its source's leaves, by doc_id (null first, ties by leaf);
    root: that of the subroots by source (null first, by bytes). path: the siblings left and right on each level, from the
    leaf to the root; proof_sha256: the digest of all of them. seen: the text as a reader has it (default: as it is);
    folded_root is what the reader's leaf and the siblings give, and verified whether that is the root.

    A null value is `-` and a leaf differs from that of an empty one; a null source is a source of its own; repeated rows
    are a leaf each; a table of one row has its leaf as root and no siblings; an empty table gives none; further columns
    are not part of a leaf. Texts of any length are digested as they stand.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *(F.col(c).cast("string").alias(c) for c in FIELDS[1:]))
    source = F.col("source")
    own = texts.select("doc_id", F.coalesce(F.concat(F.lit("="), source), F.lit("")).alias("group"), leaf().alias("node"), (leaf(text=seen) if seen is not None else leaf()).alias("read"), F.monotonically_increasing_id().alias("item"))
    ranked = placed(keep(own, "manifest-leaves"), ["doc_id", "node", "item"], "manifest-ranked")
    held = blocks(ranked, ["doc_id", "read"], "manifest-blocks")
    up = above(held, "manifest")

    subroots = up.where("block = 0").select(F.lit("").alias("group"), F.col("group").alias("own"), F.col("root").alias("node"))
    sources = keep(placed(subroots, ["own"], "manifest-sources"), "manifest-subroots")
    top = rising(sources, "manifest-top").join(small(sources.select("place", "own")), "place").select(F.col("own").alias("group"), F.col("root").alias("top"), F.col("path").alias("onward"))
    up = salted(up, top, "group", "block").select("group", "block", F.col("root").alias("subroot"), F.col("top").alias("root"), F.concat("path", "onward").alias("upper"))

    def judged(row: Column) -> Column:
        path = F.concat(own_path((row["place"] % BLOCK).cast("int")), F.col("upper"))
        folded = F.aggregate(path, row["read"], lambda h, s: digest(s["left"], h, s["right"]))
        proof = F.sha2(F.array_join(F.transform(path, lambda s: F.concat(s["left"], s["right"])), ""), 256)
        return F.struct(row["doc_id"].alias("doc_id"), row["node"].alias("leaf"), proof.alias("proof_sha256"), folded.alias("folded_root"), *([path.alias("path")] if paths else []))

    each = held.join(small(up), ["group", "block"]).select("group", "subroot", "root", F.inline(F.transform("rows", judged)))
    named = F.when(F.col("group") != "", F.col("group").substr(F.lit(2), F.length("group"))).alias("source")
    return each.select("doc_id", named, "leaf", "subroot", "root", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"), *(["path"] if paths else []))
