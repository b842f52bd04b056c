"""Structured Streaming over a folder of question traces: an addition of this engine, for live runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.files import TRACE


def answer_stream(spark: SparkSession, path: str) -> DataFrame:
    """file, question_id, status, tokens, at (when the file was written) of traces as they arrive."""
    got = spark.readStream.schema(TRACE).option("multiLine", "true").json(path)
    return got.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_modification_time").alias("at"), F.col("meta.questionId").alias("question_id"), F.col("meta.status").alias("status"), F.coalesce("meta.tokenUsage.totalTokens", F.lit(0).cast("long")).alias("tokens"))


def windowed_counters(answers: DataFrame, width: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """ok, error, timeout and token sums by window; answers later than the watermark are dropped by Spark."""
    ok, slow = F.upper("status") == "OK", F.upper("status") == "TIMEOUT"
    held = answers.withWatermark("at", late).groupBy(F.window("at", width))
    return held.agg(F.count_if(ok).alias("ok"), F.count_if(~F.coalesce(ok | slow, F.lit(False))).alias("error"), F.count_if(slow).alias("timeout"), F.sum("tokens").alias("tokens")).select("window.start", "window.end", "ok", "error", "timeout", "tokens")


# --- reducers: state that grows by appending, and state of which the last value counts ------------------------------


def reduced(events: DataFrame, keys: list[str]) -> DataFrame:
    """keys, events, tokens, last_query, last_seq of events(seq, query, tokens), of a stream or a table: what was appended is
    counted and summed, of queries the one of the largest seq counts. Its state has a row a key, however many events come."""
    asked = F.col("query").isNotNull() & (F.col("seq") >= 0)
    return events.groupBy(*keys).agg(F.count("*").alias("events"), F.sum(F.coalesce("tokens", F.lit(0).cast("long"))).alias("tokens"), F.max_by(F.when(asked, F.col("query")), F.when(asked, F.col("seq"))).alias("last_query"), F.max(F.when(asked, F.col("seq"))).alias("last_seq"))


def reduce_stream(events: DataFrame, keys: list[str], path: str, **trigger) -> StreamingQuery:
    """Run `reduced` over a stream: each batch writes the keys that it changed to a folder of its own below path.

    A batch that runs again after a failure writes over its folder, so no change is counted twice. trigger: as of
    DataStreamWriter.trigger; by default what is there is read, and the query ends.
    """

    def write(changed: DataFrame, batch: int) -> None:
        changed.write.mode("overwrite").parquet(f"{path}/state/batch={batch}")

    stream = reduced(events, keys).writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", f"{path}/checkpoint")
    return stream.trigger(**(trigger or {"availableNow": True})).start()


def settled(spark: SparkSession, keys: list[str], path: str) -> DataFrame:
    """The state of each key after the batches so far: its row of the last batch that changed it."""
    rows = spark.read.parquet(f"{path}/state")
    held = F.struct(*(c for c in rows.columns if c not in (*keys, "batch")))
    return rows.groupBy(*keys).agg(F.max_by(held, "batch").alias("held")).select(*keys, "held.*")
