"""Shared pieces: the scratch folder, materialised tables, size-checked broadcasts and deterministic ranks."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window
from pyspark.sql.types import ArrayType, BinaryType, DataType, MapType, StringType, StructType

#: A word, by the contract of every operator here: a run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Rows of one rank bucket; a bucket is sorted by one task, so this bounds a task whatever the key's share is.
BUCKET_ROWS = 2_000
#: A side is broadcast only if it was counted and measured, and has at most so many rows and so many bytes of values.
BROADCAST_ROWS = 2_000_000
BROADCAST_BYTES = 64 << 20
#: Rows and bytes of an Arrow batch in written steps, at most: texts are long, and JVM and worker hold a batch several
#: times over.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": 1_000, "spark.sql.execution.arrow.maxBytesPerBatch": 8 << 20}

_own: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession) -> str:
    """The shared folder that the cluster names; a folder of our own only where none is named (tests, a laptop)."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named
    app = spark.sparkContext.applicationId
    if app not in _own:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        _own[app] = tempfile.mkdtemp(prefix="lattica-")
    return _own[app]


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Arrow batches of at most BATCH for what is run inside; the session's own settings are put back."""
    own = {k: spark.conf.get(k) for k in BATCH}
    try:
        for k, most in BATCH.items():
            if not 0 < int(own[k].rstrip("b")) <= most:
                spark.conf.set(k, str(most))
        yield
    finally:
        for k, v in own.items():
            spark.conf.set(k, v)


def keep(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: lineage is cut, and a lost executor costs a re-read only."""
    spark = df.sparkSession
    path = f"{scratch(spark)}/llm-{name}-{uuid.uuid4().hex}"
    with small_batches(spark):
        df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@dataclass(frozen=True)
class Numbered:
    """A table whose rows have numbers that stay the same when it is read again: item, and the row as a struct, so that no
    column of the table can be taken for the number."""

    rows: DataFrame


def whole(docs: DataFrame) -> Column:
    """All columns of a row as the struct `row`."""
    return F.struct(*(docs[f"`{c}`"] for c in docs.columns)).alias("row")


def numbered(docs: DataFrame) -> Numbered:
    """Rows of files are numbered by a 64-bit hash of the file and the place in it; other frames are written once, with
    running numbers, and the written rows are used."""
    if "_metadata" not in docs.columns:
        try:
            place = docs.select(F.xxhash64("_metadata.file_path", "_metadata.row_index").alias("item"), whole(docs))
            place.schema  # noqa: B018 - analysis fails here if the frame does not come from files
            return Numbered(place)
        except AnalysisException:
            pass
    return Numbered(keep(docs.select(F.monotonically_increasing_id().alias("item"), whole(docs)), "numbered"))


def rows(docs: DataFrame | Numbered) -> DataFrame:
    """item, row of docs: its own numbers if it has any, else running ones (good within one written step)."""
    return docs.rows if isinstance(docs, Numbered) else docs.select(F.monotonically_increasing_id().alias("item"), whole(docs))


def without(docs: Numbered, gone: DataFrame) -> DataFrame:
    """The rows of docs whose number is not in gone(item), with docs' own columns."""
    return docs.rows.join(small(gone.select("item")), "item", "left_anti").select("row.*")


def salted(big: DataFrame, other: DataFrame, key: str | list[str], by: str, salts: int = 16) -> DataFrame:
    """big joined to other on `key`, which is unique in other: broadcast if a count allows, else each row of other goes
    to `salts` places and big's rows of a key are dealt to these by their column `by`: no key is one task's."""
    if fits(other):
        return big.join(F.broadcast(other), key)
    dealt = big.withColumn("__salt", F.pmod(F.xxhash64(by), F.lit(salts)))
    spread = other.withColumn("__salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))
    return dealt.join(spread, [*([key] if isinstance(key, str) else key), "__salt"]).drop("__salt")


def width(value: Column, kind: DataType) -> Column:
    """Bytes of a value: 8 of numbers and the like, the own length of strings, bytes and arrays, and of all that they hold."""
    if isinstance(kind, (StringType, BinaryType)):
        return F.coalesce(F.octet_length(value), F.lit(0)) + 8
    if isinstance(kind, StructType):
        return sum((width(value[f.name], f.dataType) for f in kind), F.lit(0))
    if isinstance(kind, ArrayType):
        if isinstance(kind.elementType, (StringType, BinaryType, StructType, ArrayType, MapType)):
            held = F.aggregate(value, F.lit(0).cast("long"), lambda s, v: s + width(v, kind.elementType).cast("long"))
        else:
            held = 8 * F.size(value)
        return F.coalesce(F.greatest(held, F.lit(0)), F.lit(0)) + 8
    if isinstance(kind, MapType):
        return width(F.map_keys(value), ArrayType(kind.keyType)) + width(F.map_values(value), ArrayType(kind.valueType))
    return F.lit(8)


def fits(df: DataFrame, most: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> bool:
    """Whether df has at most `most` rows and `size` bytes of values, by one pass that stops at `most` rows."""
    held = sum((width(df[f"`{f.name}`"], f.dataType) for f in df.schema), F.lit(0)).cast("long").alias("held")
    got = df.select(held).limit(most + 1).agg(F.count("*").alias("n"), F.sum("held").alias("held")).first()
    return got["n"] <= most and (got["held"] or 0) <= size


def small(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if its rows and bytes are counted to fit, else df: the join then shuffles."""
    return F.broadcast(df) if fits(df, most) else df


def give_back() -> None:
    """Give freed memory of this process back to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # not glibc: nothing to give back by hand
        pass


def released(batches: Iterator) -> Iterator:
    """The batches, and then, at the end of a task, freed memory given back: workers are kept for later tasks."""
    yield from batches
    give_back()


def text_of(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def whole_number(n: Column) -> Column:
    return F.coalesce(n, F.lit(0)).cast("long")


def ranked(df: DataFrame, key: str, order: list[str], sizes: dict, out: str = "__rank") -> DataFrame:
    """Add the 0-based rank of each row within `key`, by a hash bucket of the order columns and then by these.

    A key's rows are dealt to ceil(rows / BUCKET_ROWS) buckets, each bucket is sorted alone and starts at the sum of
    the earlier ones, so no task sorts more than a few thousand rows of a key. sizes: rows by key (bounded keys only).
    Rows equal in all order columns get consecutive ranks in any order.
    """
    spark = df.sparkSession
    buckets = spark.createDataFrame([(k, -(-n // BUCKET_ROWS)) for k, n in sizes.items()] or [(0, 1)], f"`{key}` {dict(df.dtypes)[key]}, `__n` long")
    dealt = df.join(F.broadcast(buckets), key).withColumn("__bucket", F.pmod(F.xxhash64(*order), F.col("__n"))).drop("__n")
    counts = dealt.groupBy(key, "__bucket").agg(F.count("*").alias("__c"))
    before = Window.partitionBy(key).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.withColumn("__start", F.coalesce(F.sum("__c").over(before), F.lit(0))).drop("__c")
    local = dealt.withColumn(out, F.row_number().over(Window.partitionBy(key, "__bucket").orderBy(*order)) - 1)
    return local.join(small(starts), [key, "__bucket"]).withColumn(out, F.col(out) + F.col("__start")).drop("__bucket", "__start")
