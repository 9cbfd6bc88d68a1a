"""Reading and writing files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickloom import schemas
from tickloom.functions.dates import from_epoch_millis
from tickloom.functions.numeric import to_number
from tickloom.operators.quality import unflatten


def read_wide_csv(spark: SparkSession, path: str, by: str = "ticker") -> DataFrame:
    """A flattened CSV (key column, then ``YYYY-MM-DD_feature`` columns) as cells.

    Only the header is looked at to name the columns; values are cast on read. A file without data
    rows gives an empty frame.
    """
    text = spark.read.option("header", True).csv(path)
    schema = T.StructType([T.StructField(c, T.StringType()) for c in text.columns])
    wide = spark.read.option("header", True).schema(schema).csv(path)
    wide = wide.withColumnRenamed(wide.columns[0], by)
    return unflatten(wide, by).withColumn("value", to_number(F.col("value")))


def read_klines(spark: SparkSession, path: str, ticker_from_folder: str = "ticker") -> DataFrame:
    """Twelve-column kline rows as typed bars; the ticker comes from the partition folder."""
    raw = spark.read.schema(f"{schemas.KLINES}, {ticker_from_folder} string").option("header", False).csv(path)
    return raw.select(
        F.col(ticker_from_folder).alias("ticker"),
        from_epoch_millis(F.col("Open Time")).alias("ts"),
        *[to_number(F.col(c)).alias(c.lower()) for c in ["Open", "High", "Low", "Close", "Volume"]],
        from_epoch_millis(F.col("Close Time")).alias("close_ts"),
        F.col("Number of Trades").alias("trades"),
    )


def tradable_symbols(spark: SparkSession, path: str) -> DataFrame:
    """Symbols with status TRADING from exchange JSON files."""
    listing = spark.read.schema(schemas.EXCHANGE).json(path)
    return (listing.select(F.explode("symbols").alias("s")).where(F.col("s.status") == "TRADING")
            .select("s.symbol").distinct())


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def rank_universe(market: DataFrame, top_n: int, symbol: str = "symbol", cap: str = "market_cap") -> DataFrame:
    """The ``top_n`` exchange symbols by market value: upper case with USDT appended."""
    best = market.groupBy(F.upper(symbol).alias("_s")).agg(F.max(cap).alias(cap))
    return best.orderBy(F.col(cap).desc(), "_s").limit(top_n).select(
        F.concat("_s", F.lit("USDT")).alias("symbol"), cap)


def usd_universe(listed: DataFrame, top_n: int, ticker: str = "ticker", rank: str = "rank") -> DataFrame:
    """The first ``top_n`` well-formed ``XXX-USD`` tickers: trimmed, each one once."""
    trimmed = listed.select(F.trim(ticker).alias(ticker), rank).where(F.col(ticker).rlike(r"^[A-Z0-9]{2,10}-USD$"))
    return (trimmed.groupBy(ticker).agg(F.min(rank).alias(rank)).orderBy(rank, ticker).limit(top_n))


def write_bars(df: DataFrame, path: str, partitions: Sequence[str] = ("source", "interval")) -> None:
    """Bars as Parquet, partitioned for pruning and sorted by ticker and time for row-group skipping.

    A ticker is split by quarters, so a hot one is written by many tasks.
    """
    (df.repartition(*partitions, "ticker", F.date_trunc("quarter", "ts")).sortWithinPartitions(*partitions, "ticker", "ts")
     .write.mode("overwrite").partitionBy(*partitions).parquet(path))
