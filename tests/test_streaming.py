"""State of a stream after some batches, after more, and after a batch that ran twice, against the batch result."""

import shutil

from lattica.streaming import traces

EVENTS = "user string, seq long, query string, tokens long"


def test_state_follows_the_stream(spark, tmp_path):
    rows = [(u, k, f"q{k}" if k % 3 else None, k % 4 or None) for u in ("a", "b", None) for k in range(12)] + [("c", -1, "no", 1), ("d", 1, None, None)]
    first, second = rows[::2], rows[1::2]
    path, root = str(tmp_path / "in"), str(tmp_path / "out")
    for some, wanted in ((first, first), (second, rows)):
        spark.createDataFrame(some, EVENTS).repartition(3).write.mode("append").parquet(path)
        stream = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).parquet(path)
        traces.reduce_stream(stream, ["user"], root).awaitTermination()
        want = traces.reduced(spark.createDataFrame(wanted, EVENTS), ["user"])
        got = traces.settled(spark, ["user"], root)
        assert sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr)
    # The last batch is taken back as a failure would, and runs again.
    commits = sorted((p for p in (tmp_path / "out/checkpoint/commits").iterdir() if p.name.isdigit()), key=lambda p: int(p.name))
    commits[-1].unlink()
    (commits[-1].parent / f".{commits[-1].name}.crc").unlink(missing_ok=True)
    traces.reduce_stream(spark.readStream.schema(EVENTS).parquet(path), ["user"], root).awaitTermination()
    assert sorted(map(tuple, traces.settled(spark, ["user"], root).collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr)
    shutil.rmtree(root)
