"""Streams: state that ends, kept bars across a restart, candle messages, late ticks of a month."""

import datetime as dt
import json
import os
from pathlib import Path

import pytest

from tickloom.session import scratch_path
from tickloom.sources import store
from tickloom.streaming import ingest, live

T0 = dt.datetime(2024, 1, 1)


def feed(spark, rows, schema, folder, n):
    """One file that a stream reads after those with a lower number."""
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/{n}")
    for part in Path(f"{folder}/{n}").glob("*.parquet"):
        os.utime(part, (1_700_000_000 + n * 10,) * 2)


def test_runs_close_and_free_their_state(spark, tmp_path):
    schema = "trace_id bigint, ts timestamp, total_steps int"

    def at(minutes):
        return T0 + dt.timedelta(minutes=minutes)

    batches = [[(1, at(0), 2), (2, at(0), 5), (3, None, 5)], [(1, at(1), 2), (2, at(2), 5)], [(9, at(500), 1)], [(9, at(900), 1)], [(9, at(901), 1)]]
    for i, rows in enumerate(batches):
        feed(spark, rows, schema, tmp_path / "in", i)
    events = live.read_stream(spark, f"{tmp_path}/in/*", schema, files_per_batch=1)
    seen = []
    q = (ingest.run_progress(events, "1 hour").writeStream.outputMode("update")
         .foreachBatch(lambda b, i: seen.extend(tuple(r) for r in b.select("trace_id", "steps_done", "closed").collect()))
         .option("checkpointLocation", f"{tmp_path}/offsets").trigger(availableNow=True).start())
    q.awaitTermination()
    assert (1, 1, False) in seen and (1, 2, True) in seen  # all its steps
    assert (2, 2, False) in seen and (2, 2, True) in seen  # an hour without one
    assert [p for p in q.recentProgress if p["stateOperators"]][-1]["stateOperators"][0]["numRowsTotal"] == 1  # the run of the newest event


@pytest.mark.parametrize("buckets", [1, 64])
def test_runs_share_a_state_and_keep_their_own_ends(spark, tmp_path, monkeypatch, buckets):
    schema = "trace_id bigint, ts timestamp, total_steps int"

    def at(minutes):
        return T0 + dt.timedelta(minutes=minutes)

    big = 2 ** 60 + 1
    batches = [[(1, at(0), 2), (2, at(0), None), (None, at(0), 3), (big, at(5), 9), (0, at(400), 9)], [(1, at(430), 2), (2, at(430), None)],
               [(9, at(500), 1)], [(9, at(900), 1)], [(9, at(901), 1), (2, at(902), 4)]]
    for i, rows in enumerate(batches):
        feed(spark, rows, schema, tmp_path / "in", i)
    events = live.read_stream(spark, f"{tmp_path}/in/*", schema, files_per_batch=1)
    seen, calls = [], []
    q = (ingest.run_progress(events, "1 hour", late="400 minutes", buckets=buckets).writeStream.outputMode("update")
         .foreachBatch(lambda b, i: seen.extend((i, r.trace_id, r.steps_done, r.total_steps, r.closed) for r in b.collect()))
         .option("checkpointLocation", f"{tmp_path}/offsets").trigger(availableNow=True).start())
    q.awaitTermination()
    first = sorted(((r[1] if r[1] is not None else -1, *r[2:]) for r in seen if r[0] == 0))
    assert first == [(-1, 1, 3, False), (0, 1, 9, False), (1, 1, 2, False), (2, 1, None, False), (big, 1, 9, False)]
    runs = {k: [r[2:] for r in seen if r[1] == k] for k in (1, 2, None, big, 0, 9)}
    assert runs[1] == [(1, 2, False), (2, 2, True), (2, 2, True)]  # its last step, then its time
    assert runs[2] == [(1, None, False), (2, None, False), (2, None, True), (1, 4, False)] or runs[2] == [
        (1, None, False), (2, None, False), (3, 4, False)]
    assert runs[None] == [(1, 3, False), (1, 3, True)] and runs[big] == [(1, 9, False), (1, 9, True)]
    assert runs[0] == [(1, 9, False), (1, 9, True)] and runs[9][:2] == [(1, 1, True), (2, 1, True)]


def test_kept_bars_go_on_after_a_restart(spark, tmp_path):
    schema, path, offsets = "ticker string, ts timestamp, close double", scratch_path(spark, "kept"), str(tmp_path / "offsets")
    for n, hours in enumerate([range(0, 4), range(3, 6)]):  # the hour 3 comes again with another close
        feed(spark, [(t, T0 + dt.timedelta(hours=h), float(10 * n + h)) for h in hours for t in "AB"], schema, tmp_path / "in", n)
        stream = live.read_stream(spark, f"{tmp_path}/in/*", schema)
        live.run_batches(stream, live.keep_last(path, 3), offsets=offsets)
    got = sorted((r.ticker, r.ts.hour, r.close) for r in spark.read.parquet(path).collect())
    assert got == [(t, h, 10.0 + h) for t in "AB" for h in (3, 4, 5)]


def test_an_interrupted_upsert_is_completed(spark, tmp_path):
    path = f"{tmp_path}/t"
    store.write_upsert(spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string"), path, "k")
    spark.createDataFrame([(1, "a"), (2, "c")], "k int, v string").write.parquet(f"{path}.staged")  # its writer died after this
    store.write_upsert(spark.createDataFrame([(3, "d")], "k int, v string"), path, "k")
    assert sorted(map(tuple, spark.read.parquet(path).collect())) == [(1, "a"), (2, "c"), (3, "d")]
    assert not os.path.exists(f"{path}.staged")


def test_candles(spark):
    def message(**k):
        return json.dumps({"e": "kline", "k": {"t": 1704067200000, "s": "BTCUSDT", "o": "1.5", "h": "2", "l": "1", "c": "1.75", "v": "10", "x": True} | k})

    rows = [message(), message(x=False), message(c="bad"), "{", None, message(s=None)]
    got = [tuple(r) for r in live.candles(spark.createDataFrame([(m,) for m in rows], "value string")).collect()]
    assert got == [("BTCUSDT", T0, 1.5, 2.0, 1.0, 1.75, 10.0), ("BTCUSDT", T0, 1.5, 2.0, 1.0, None, 10.0)]


def test_late_ticks_of_a_month_of_31_days_count(spark, tmp_path):
    schema = "ticker string, ts timestamp, price double, event_id long"
    days = [(1, 15), (2, 1), (2, 2), (2, 3), (1, 31), (3, 2), (5, 1), (7, 1), (9, 1)]
    for i, (month, day) in enumerate(days):  # one batch each, in this order
        feed(spark, [("A", dt.datetime(2024, month, day, 12), float(i), i)], schema, tmp_path / "in", i)
    ticks = live.read_stream(spark, f"{tmp_path}/in/*", schema, files_per_batch=1)
    live.run_to_end(live.live_bars(ticks, "1mo"), f"{tmp_path}/out")
    got = {(r.ts.month, r.trades, r.open, r.close) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert {(1, 2, 0.0, 4.0), (2, 3, 1.0, 3.0), (3, 1, 5.0, 5.0)} <= got
