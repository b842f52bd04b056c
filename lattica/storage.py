"""Tables written to the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager, nullcontext

from pyspark.sql import DataFrame, SparkSession

#: Rows and bytes of an Arrow batch, and rows of a batch that is read from Parquet, where rows may be long texts: JVM and worker
#: hold a batch several times over.
WIDE = {"spark.sql.execution.arrow.maxRecordsPerBatch": 1_000, "spark.sql.execution.arrow.maxBytesPerBatch": 8 << 20, "spark.sql.parquet.columnarReaderBatchSize": 64}
_own: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; in local mode without it, a temporary folder."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return _own.setdefault(spark.sparkContext.applicationId, tempfile.mkdtemp(prefix="lattica-"))


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Batches of at most WIDE for what is run inside; the session's own settings are put back."""
    own = {k: spark.conf.get(k) for k in WIDE}
    try:
        for k, most in WIDE.items():
            if not 0 < int(own[k].rstrip("b")) <= most:
                spark.conf.set(k, str(most))
        yield
    finally:
        for k, v in own.items():
            spark.conf.set(k, v)


def written(df: DataFrame, name: str, wide: bool = False) -> DataFrame:
    """df, written as Parquet and read back, so that a loop's lineage does not grow. wide: rows that are read or made for it
    may be long texts, and go through memory a few at a time."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    with small_batches(spark) if wide else nullcontext():
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
