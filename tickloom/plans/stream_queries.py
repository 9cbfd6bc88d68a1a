"""Streams run to the end of the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickloom.plans.function_queries import _SCORED, _TAGGED, _TXT, BAD, GOOD
from tickloom.plans.quality_queries import r_all, rounded
from tickloom.plans.registry import query, r, rnd
from tickloom.plans.views import news, steps, ticks, using
from tickloom.session import scratch_path
from tickloom.streaming import ingest, live

TICKS = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"
KEPT = "ticker string, ts timestamp, close double"


def hour():
    return F.date_format("ts", "yyyy-MM-dd HH").alias("h")


OHLC = ["open", "high", "low", "close"]


def tick_stream(spark, sf):
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    raw = live.read_stream(spark, sf, TICKS, glob="events.parquet")
    return raw.select(F.col("event_type").alias("ticker"), F.col("ts").cast("timestamp").alias("ts"),
                      F.col("value").alias("price"), "event_id")


def tick_batches(spark, sf, of_stream, each, copies=1):
    """Feeds the ticks of a month in quarters: each one is written by all tasks and read as one micro-batch.

    The query goes on from its offsets, as after a restart. The ticks are split by quarter in one pass.
    """
    staged, path, offsets = (scratch_path(spark, n) for n in ("quarters", "ticks", "offsets"))
    ticks(spark, sf).select("ticker", "ts", "price", "event_id").withColumn(
        "q", F.least(F.floor((F.dayofmonth("ts") - 1) / 8), F.lit(3))).write.partitionBy("q").parquet(staged)
    for _ in range(copies):
        for q in range(4):
            spark.read.parquet(staged).where(F.col("q") == q).drop("q").write.mode("append").parquet(path)
            stream = live.read_stream(spark, path, "ticker string, ts timestamp, price double, event_id bigint")
            live.run_batches(of_stream(stream), each, offsets=offsets)


CLOSED = "closed AS (SELECT * FROM bars_hour WHERE ts + INTERVAL 1 HOUR <= (SELECT max(ts) FROM ticks) - INTERVAL 10 MINUTE)"


@query("z1_live_bars", using("bars_hour", f"SELECT ticker, strftime(ts, '%Y-%m-%d %H') AS h, {r_all(OHLC)}, trades FROM closed", CLOSED))
def z1(spark, sf):
    path = scratch_path(spark, "live")
    live.run_to_end(live.live_bars(tick_stream(spark, sf)), path)
    return spark.read.parquet(path).select("ticker", hour(), *rounded(OHLC), "trades")


@query("z1_live_bars_week", using("ticks", f"""SELECT ticker, strftime(w, '%Y-%m-%d') AS week, {r('arg_min(price, row(ts, event_id))')} AS open, {r('max(price)')} AS high,
  {r('min(price)')} AS low, {r('arg_max(price, row(ts, event_id))')} AS close, count(*) AS trades FROM (SELECT *, date_trunc('week', ts) AS w FROM ticks)
  WHERE w + INTERVAL 7 DAY <= (SELECT max(ts) FROM ticks) - INTERVAL 10 MINUTE GROUP BY ticker, w"""))
def z1_week(spark, sf):
    path = scratch_path(spark, "weeks")
    live.run_to_end(live.live_bars(tick_stream(spark, sf), "1wk"), path)
    return spark.read.parquet(path).select("ticker", F.date_format("ts", "yyyy-MM-dd").alias("week"), *rounded(OHLC), "trades")


_KEPT = "kept AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY ts DESC) AS age FROM closed) WHERE age <= 200)"


@query("z2_keep_last", using("bars_hour", f"SELECT ticker, strftime(ts, '%Y-%m-%d %H') AS h, {r('close')} AS close FROM kept", CLOSED, _KEPT))
def z2(spark, sf):
    path = scratch_path(spark, "kept")
    tick_batches(spark, sf, live.live_bars, live.keep_last(path))
    return spark.read.schema(KEPT).parquet(path).select("ticker", hour(), rnd("close").alias("close"))


W = "OVER (PARTITION BY ticker ORDER BY ts)"


def _over(n):
    return f"OVER (PARTITION BY ticker ORDER BY ts ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


_LIVE = [CLOSED, _KEPT, f"dx AS (SELECT *, close - lag(close) {W} AS dx FROM kept)",
         f"""ind AS (SELECT ticker, ts, CASE WHEN count(dx) {_over(14)} = 14 THEN avg(greatest(dx, 0)) {_over(14)} END AS g, avg(-least(dx, 0)) {_over(14)} AS l,
         CASE WHEN count(*) {_over(50)} = 50 THEN avg(close) {_over(50)} END AS ma_50, CASE WHEN count(*) {_over(200)} = 200 THEN avg(close) {_over(200)} END AS ma_200 FROM dx)"""]


@query("z3_live_indicators", using("bars_hour", f"""SELECT ticker, strftime(ts, '%Y-%m-%d %H') AS h, {r('CASE WHEN g IS NULL THEN NULL WHEN l = 0 THEN 100 - 100 / 101.0 ELSE 100 - 100 / (1 + g / l) END')} AS rsi,
  {r('ma_50')} AS ma_50, {r('ma_200')} AS ma_200 FROM ind""", *_LIVE))
def z3(spark, sf):
    kept, out = scratch_path(spark, "kept"), scratch_path(spark, "indicators")
    tick_batches(spark, sf, live.live_bars, live.live_indicators(kept, out))
    return spark.read.schema(f"{KEPT}, rsi double, ma_50 double, ma_200 double").parquet(out).select("ticker", hour(), *rounded(["rsi", "ma_50", "ma_200"]))


@query("z4_incremental_load", using("ticks", f"SELECT ticker, strftime(ts, '%Y-%m-%d') AS day, count(*) AS n, {r('sum(price)', 2)} AS total FROM ticks GROUP BY ALL"))
def z4(spark, sf):
    path = scratch_path(spark, "loaded")
    tick_batches(spark, sf, lambda t: ingest.first_seen(t, ["event_id"], "ts", "60 days").withColumn(
        "day", F.date_format("ts", "yyyy-MM-dd")), ingest.upsert_into(path, ["event_id"], partitions=["day"]), copies=2)
    return spark.read.schema("ticker string, price double, event_id bigint, day string").parquet(path).groupBy("ticker", "day").agg(
        F.count(F.lit(1)).alias("n"), rnd(F.sum("price"), 2).alias("total"))


@query("z5_news_stream", using("news", f"SELECT link, array_to_string(tags, ',') AS tags, {r('score')} AS score FROM scored", _TXT, _TAGGED, _SCORED))
def z5(spark, sf):
    source, path = scratch_path(spark, "feed"), scratch_path(spark, "news")
    n = news(spark, sf).select("link", "title", "description", "published")
    for _ in range(2):
        n.write.mode("append").parquet(source)
    items = live.read_stream(spark, source, "link bigint, title string, description string, published timestamp")
    live.run_to_end(ingest.news_stream(items, "7 days", positive=GOOD, negative=BAD), path)
    return spark.read.parquet(path).select("link", F.array_join("tags", ",").alias("tags"), rnd("score").alias("score"))


@query("z6_run_progress", using("steps", f"""SELECT trace_id, done AS steps_done, {r('done * 100.0 / 10')} AS progress, {r('CASE WHEN secs > 0 THEN done / secs ELSE 0 END', 8)} AS rate,
  {r('CASE WHEN secs > 0 THEN (10 - done) / (done / secs) ELSE 0 END', 2)} AS seconds_left FROM
  (SELECT trace_id, count(*) AS done, epoch(max(start_time)) - epoch(min(start_time)) AS secs FROM steps GROUP BY trace_id)"""))
def z6(spark, sf):
    source, path = scratch_path(spark, "steps"), scratch_path(spark, "progress")
    e = steps(spark, sf).select("trace_id", F.col("start_time").alias("ts"), F.lit(10).alias("total_steps"))
    e.repartitionByRange(3, "ts").write.parquet(source)
    events = live.read_stream(spark, source, "trace_id bigint, ts timestamp, total_steps int", files_per_batch=1)
    live.run_batches(ingest.run_progress(events, "1 hour", late="4000 days"), ingest.keep_progress(path), mode="update")
    d = ingest.progress_numbers(spark.read.parquet(path))
    return d.select("trace_id", "steps_done", rnd("progress").alias("progress"), rnd("rate", 8).alias("rate"),
                    rnd("seconds_left", 2).alias("seconds_left"))


@query("z1_candles", using("bars_hour", f"SELECT ticker, strftime(ts, '%Y-%m-%d %H') AS h, {r_all(OHLC)} FROM bars_hour"))
def z1_candles(spark, sf):
    """The hourly bars as candle messages, each first open with another close and then closed, kept by start."""
    from tickloom.plans.views import bars_hour
    source, path = scratch_path(spark, "candles"), scratch_path(spark, "bars")
    closed = F.explode(F.array(F.lit(False), F.lit(True))).alias("x")
    text = [F.col(c).cast("string").alias(c[0]) for c in OHLC]
    bars = bars_hour(spark, sf).select("ticker", "ts", *OHLC, closed)
    bars.select(F.to_json(F.struct(F.struct(F.unix_millis("ts").alias("t"), *text, F.col("x"), F.col("ticker").alias("s")).alias("k"))).alias(
        "value")).write.parquet(source)
    live.run_batches(live.candles(live.read_stream(spark, source, "value string")), live.keep_last(path, 1_000_000))
    return spark.read.schema("ticker string, ts timestamp, open double, high double, low double, close double").parquet(path).select(
        "ticker", hour(), *rounded(OHLC))
