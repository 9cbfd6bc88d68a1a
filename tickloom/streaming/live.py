"""Live bars and indicators from a tick stream."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.functions.dates import bar_start, interval_seconds
from tickloom.operators.core import latest_n, run_steps
from tickloom.operators.series import macd_step, rsi_step, sma_step
from tickloom.session import scratch_path
from tickloom.sources.store import write_upsert

KEPT_BARS = 200  # fixed value: bars kept per ticker
CALENDAR_BARS = {"1mo": "31 days"}  # units without a fixed length, and how long they stay open


def read_stream(spark: SparkSession, path: str, schema: str, glob: str | None = None, files_per_batch: int | None = None) -> DataFrame:
    """A Parquet folder as a stream with a fixed schema."""
    r = spark.readStream.schema(schema)
    if glob:
        r = r.option("pathGlobFilter", glob)
    if files_per_batch:
        r = r.option("maxFilesPerTrigger", files_per_batch)
    return r.parquet(path)


def live_bars(ticks: DataFrame, every: str = "1h", delay: str = "10 minutes", price: str = "price",
              tiebreak: Sequence[str] = ("event_id",), by: Sequence[str] = ("ticker",), ts: str = "ts") -> DataFrame:
    """Bars of a tick stream. In append mode a bar appears once, when the watermark has closed it.

    Weeks start on Monday, as in ``bar_start``. Months have no fixed length, so their bars are grouped by the start of
    the month itself, which then carries the watermark: a month is closed once a later month began 31 days and the delay
    after its own start, so it takes late ticks all through the next month.
    """
    moment = F.struct(F.col(ts), *[F.col(c) for c in tiebreak])
    values = [F.min_by(price, moment).alias("open"), F.max(price).alias("high"), F.min(price).alias("low"),
              F.max_by(price, moment).alias("close"), F.count(F.lit(1)).alias("trades")]
    if every in CALENDAR_BARS:
        d = ticks.withColumn("_bar", bar_start(F.col(ts), every)).withWatermark("_bar", f"{CALENDAR_BARS[every]} {delay}")
        return d.groupBy(*by, "_bar").agg(*values).withColumnRenamed("_bar", ts).select(
            *by, ts, "open", "high", "low", "close", "trades")
    monday = "4 days" if every == "1wk" else None  # the epoch is a Thursday
    window = F.window(ts, f"{interval_seconds(every)} seconds", startTime=monday)
    bars = ticks.withWatermark(ts, delay).groupBy(*by, window.alias("_w")).agg(*values)
    return bars.select(*by, F.col("_w.start").alias(ts), "open", "high", "low", "close", "trades")


def run_to_end(df: DataFrame, path: str, mode: str = "append") -> None:
    """Processes all there is and writes it as Parquet."""
    q = (df.writeStream.format("parquet").outputMode(mode).option("path", path)
         .option("checkpointLocation", scratch_path(df.sparkSession, "offsets")).trigger(availableNow=True).start())
    q.awaitTermination()


def run_batches(df: DataFrame, each: Callable[[DataFrame, int], None], mode: str = "append", offsets: str | None = None) -> None:
    """Processes all there is, handing every micro-batch to ``each``; with ``offsets`` it goes on where the run before ended."""
    q = (df.writeStream.outputMode(mode).foreachBatch(each)
         .option("checkpointLocation", offsets or scratch_path(df.sparkSession, "offsets")).trigger(availableNow=True).start())
    q.awaitTermination()


def keep_last(path: str, n: int = KEPT_BARS, by: Sequence[str] = ("ticker",), ts: str = "ts") -> Callable:
    """A batch handler that keeps the newest ``n`` bars per key in a table partitioned by the key; a newer bar replaces an
    equal start. Only keys of the batch are rewritten, and a batch that comes twice changes nothing."""
    def handle(batch: DataFrame, _: int) -> None:
        write_upsert(batch, path, [*by, ts], partitions=by, files=1, keep=lambda d: latest_n(d, n, by, ts).drop("age"))
    return handle


def indicators(bars: DataFrame, every: str = "1h") -> DataFrame:
    """What the live chart shows next to the bars; the averages start at the oldest kept bar."""
    return run_steps(bars, [rsi_step("close", zero_loss="cap"), macd_step("close"),
                            sma_step("close", 50, "ma_50"), sma_step("close", 200, "ma_200")], every=every)


def live_indicators(kept_path: str, path: str, every: str = "1h", n: int = KEPT_BARS) -> Callable:
    """A batch handler that updates the kept bars, then the indicators of the kept bars of the batch's tickers."""
    keep = keep_last(kept_path, n)

    def handle(batch: DataFrame, batch_id: int) -> None:
        keep(batch, batch_id)
        if not batch.isEmpty():
            kept = batch.sparkSession.read.schema(batch.schema).parquet(kept_path)
            touched = kept.join(batch.select("ticker").distinct(), "ticker", "left_semi")
            keep_indicators(indicators(touched, every), batch_id)
    keep_indicators = keep_last(path, n)
    return handle


CANDLE = "struct<k:struct<t:bigint,o:string,h:string,l:string,c:string,v:string,x:boolean,s:string>>"


def candles(messages: DataFrame, column: str = "value") -> DataFrame:
    """Closed bars from candle messages as the exchange sends them; open candles and broken messages are left out."""
    k = F.from_json(F.col(column), CANDLE)["k"]
    number = {n: F.col(f"_k.{c}").try_cast("double").alias(n) for n, c in
              (("open", "o"), ("high", "h"), ("low", "l"), ("close", "c"), ("volume", "v"))}
    return messages.select(k.alias("_k")).where("_k.x and _k.t is not null and _k.s is not null").select(
        F.col("_k.s").alias("ticker"), F.timestamp_millis("_k.t").alias("ts"), *number.values())
