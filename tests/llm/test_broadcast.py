"""A side is broadcast by rows and bytes counted, whatever its columns hold."""

from lattica.llm import common


def test_bytes_and_rows_decide(spark):
    rows = [(k, "x" * 100, bytearray(50), [1, 2, 3], ["ab", None], {"k": 1}, (None, "y")) for k in range(10)] + [(None,) * 7]
    df = spark.createDataFrame(rows, "a long, b string, `c.d` binary, e array<long>, f array<string>, g map<string, long>, h struct<i: long, j: string>")
    assert common.fits(df, 11) and not common.fits(df, 10)
    held = next(n for n in range(0, 10_000) if common.fits(df, 100, n * 10)) * 10
    # 8 + 108 + 58 + 32 + 26 + 33 + 17 a row, and what the empty row's columns take at least.
    assert 2820 <= held <= 2920
    assert common.fits(df.where("false"), 0, 0) and "broadcast" not in common.small(df, 1)._jdf.queryExecution().logical().toString().lower()


def test_the_same_rows_either_way(spark, monkeypatch):
    big = spark.range(200).selectExpr("id % 5 AS k", "id")
    other = spark.createDataFrame([(k, "t" * 40) for k in range(4)], "k long, t string")
    broadcast = sorted(common.salted(big, other, "k", "id").collect())
    monkeypatch.setattr(common, "BROADCAST_BYTES", 10)
    monkeypatch.setattr(common.fits, "__defaults__", (common.BROADCAST_ROWS, 10))
    assert not common.fits(other) and sorted(common.salted(big, other, "k", "id").collect()) == broadcast
