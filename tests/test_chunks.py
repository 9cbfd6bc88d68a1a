"""Chunks of a series by measured counts, where no interval is known."""

import pytest
from pyspark.sql import functions as F

from tickloom.operators import core
from tickloom.operators import series as S

N = 1_000_000


@pytest.fixture(scope="module")
def ticks(spark):
    """A million ticks of one ticker within a day, most of them in one hour, beside a small ticker."""
    at = F.when(F.col("id") % 10 == 0, F.col("id") * 86_000).otherwise(40_000_000_000 + F.col("id") * 3_000)
    hot = spark.range(N).select(F.lit("HOT").alias("ticker"), F.timestamp_micros(at + F.lit(10 ** 15)).alias("ts"), F.col("id").alias("v"))
    return hot.unionByName(spark.range(10).select(F.lit("LOW").alias("ticker"), F.timestamp_micros(F.col("id") * 10 ** 12).alias("ts"), "id"
                                                  ).withColumnRenamed("id", "v"))


def test_no_chunk_is_larger_than_the_bound(ticks):
    d = core.measured_chunks(ticks, ["ticker"], "ts")
    sizes = d.groupBy("ticker", "_c").agg(F.count(F.lit(1)).alias("k"), F.min("ts").alias("a"), F.max("ts").alias("z"))
    rows = sorted(sizes.where("ticker = 'HOT'").collect(), key=lambda r: r["_c"])
    assert sum(r.k for r in rows) == N and max(r.k for r in rows) <= core.CHUNK_BARS and len(rows) < N / 100
    assert all(x.z < y.a for x, y in zip(rows, rows[1:]))  # chunks follow each other in time
    assert d.columns == [*ticks.columns, "_c"]


def test_positions_of_ticks(ticks):
    got = core.number_rows(ticks, every=None).where("ticker = 'HOT'")
    ahead = got.select(F.col("_i") + 1, F.col("ts").alias("before")).toDF("_i", "before")
    r = got.agg(F.min("_i").alias("a"), F.max("_i").alias("z"), F.countDistinct("_i").alias("k"), F.max("_n").alias("n")).first()
    assert tuple(r) == (0, N - 1, N, N)
    assert got.join(ahead, "_i").where("before > ts").count() == 0


def test_one_moment_with_half_of_the_rows(spark):
    d = spark.range(20_000).select(F.lit("A").alias("ticker"), F.timestamp_seconds(F.greatest(F.col("id"), F.lit(10_000))).alias("ts"))
    sizes = [r["count"] for r in core.measured_chunks(d, ["ticker"], "ts", 500).groupBy("_c").count().collect()]
    assert sum(sizes) == 20_000 and sorted(sizes)[-1] == 10_001 and sorted(sizes)[-2] <= 500


def test_operators_agree_with_a_declared_interval(spark, monkeypatch):
    rows = [(t, i * 3600 * (1 + i % 3), None if i % 4 else float(i * i % 17)) for t in "AB" for i in range(300)]
    d = spark.createDataFrame([*rows, ("A", None, 1.0), (None, 5, 1.0)], "ticker string, s long, v double").select(
        "ticker", F.timestamp_seconds("s").alias("ts"), "v").dropDuplicates(["ticker", "ts"])
    full = core.measured_chunks
    monkeypatch.setattr(core, "measured_chunks", lambda df, keys, ts: full(df, keys, ts, 7))
    for every in ("1d", None):
        carried = core.carry_last(d, {"last": F.col("v")}, every=every)
        summed = core.running_sum(carried, {"total": F.coalesce("v", F.lit(0.0))}, every=every)
        out = core.run_steps(summed, [S.sma_step("last", 5)], every=every, positions=True)
        got = sorted(out.select(*sorted(out.columns)).collect(), key=lambda r: (r.ticker, r.ts))
        want = got if every else want
        assert [r.asDict() for r in got] == [r.asDict() for r in want] and len(got) > 300
    assert core.number_rows(d.limit(0), every=None).count() == 0
