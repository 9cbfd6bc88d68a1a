"""Sources, sinks and keyed tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickloom.operators.core import latest_n
from tickloom.plans.registry import DAY, day, query, r, rnd
from tickloom.plans.quality_queries import r_all, rounded
from tickloom.plans.views import (
    bars_day, bars_hour, bars_month, bars_source, news, table, ticks, trades, using,
)
from tickloom.operators import quality as Q
from tickloom.session import scratch_path
from tickloom.sources import files, store
from tickloom.sources.bars import bars_from_trades

OHLCV = ["open", "high", "low", "close", "volume"]


@query("s1_read_wide_csv", using("bars_month", f"""SELECT ticker, {DAY}, 'close' AS feature, {r('close')} AS value FROM bars_month"""))
def s1(spark, sf):
    path = scratch_path(spark, "wide")
    files.write_csv(Q.flatten(bars_month(spark, sf), ["close"]), path)
    cells = files.read_wide_csv(spark, path).where(F.col("value").isNotNull())
    return cells.select("ticker", F.date_format("d", "yyyy-MM-dd").alias("d"), "feature", rnd("value").alias("value"))


@query("s2_read_klines", using("bars_day", f"""SELECT ticker, {DAY}, {r_all(OHLCV)}, trades FROM bars_day"""))
def s2(spark, sf):
    path = scratch_path(spark, "klines")
    ms = F.unix_millis("ts")
    text = [F.col(c).cast("string").alias(c) for c in OHLCV]
    (bars_day(spark, sf).select(
        "ticker", ms.alias("t"), *text, (ms + 86_399_999).alias("te"), F.lit("0").alias("q"), "trades",
        F.lit("0").alias("b"), F.lit("0").alias("bq"), F.lit("0").alias("ignore"))
     .write.partitionBy("ticker").csv(path))
    return files.read_klines(spark, path).select("ticker", day(), *rounded(OHLCV), F.col("trades"))


@query("s3_scan_bars", using("bars_source", f"""SELECT ticker, source, {DAY}, {r_all(OHLCV)} FROM bars_source
  WHERE ticker IN ('Brand#1', 'Brand#7') AND source = 'binance' AND ts >= TIMESTAMP '1996-03-01' AND ts < TIMESTAMP '1998-07-01'"""))
def s3(spark, sf):
    path = scratch_path(spark, "bars")
    files.write_bars(bars_source(spark, sf).withColumn("interval", F.lit("1d")), path)
    stored = spark.read.parquet(path)
    got = store.scan_bars(stored, ["Brand#1", "Brand#7"], "binance", "1996-03-01", "1998-06-30", "1d")
    return got.select("ticker", "source", day(), *rounded(OHLCV))


@query("s4_latest_n", using("bars_day", f"""SELECT ticker, {DAY}, age, {r('close')} AS close FROM (SELECT *, CAST(row_number() OVER
  (PARTITION BY ticker ORDER BY ts DESC) AS INTEGER) AS age FROM bars_day) WHERE age <= 50"""))
def s4(spark, sf):
    return latest_n(bars_day(spark, sf), 50).select("ticker", day(), "age", rnd("close").alias("close"))


@query("s5_list_tickers", using("bars_source", "SELECT DISTINCT ticker FROM bars_source WHERE source = 'binance' ORDER BY ticker"))
def s5(spark, sf):
    return store.list_tickers(bars_source(spark, sf), "binance")


@query("s6_tradable_symbols", "SELECT DISTINCT p_type || p_brand AS symbol FROM part WHERE p_size % 3 <> 0")
def s6(spark, sf):
    path = scratch_path(spark, "exchange")
    status = F.when(F.col("p_size") % 3 == 0, "BREAK").otherwise("TRADING")
    listing = table(spark, sf, "part").groupBy(
        F.concat(F.col("p_brand"), F.lit(":"), F.floor(F.col("p_partkey") / 500).cast("string")).alias("exchange")
    ).agg(F.collect_list(F.struct(F.concat("p_type", "p_brand").alias("symbol"), status.alias("status"))).alias("symbols"))
    files.write_json(listing, path)
    return files.tradable_symbols(spark, path)


_MARKET = "market AS (SELECT replace(lower(ticker), '#', '') AS symbol, round(sum(price * size), 0) AS market_cap FROM trades GROUP BY ALL)"


def market(spark, sf):
    return trades(spark, sf).groupBy(F.regexp_replace(F.lower("ticker"), "#", "").alias("symbol")).agg(
        F.round(F.sum(F.col("price") * F.col("size")), 0).alias("market_cap"))


@query("s7_rank_universe", using("trades", f"SELECT upper(symbol) || 'USDT' AS symbol, market_cap FROM market ORDER BY market_cap DESC, 1 LIMIT 10", _MARKET))
def s7(spark, sf):
    return files.rank_universe(market(spark, sf), 10)


@query("s7_usd_universe", """SELECT ticker, min(p_partkey) AS rank FROM (SELECT upper(replace(p_brand, '#', '')) || '-USD' AS ticker, p_partkey FROM part
  WHERE p_partkey % 5 <> 0) WHERE regexp_full_match(ticker, '[A-Z0-9]{2,10}-USD') GROUP BY ticker ORDER BY rank LIMIT 12""")
def s7_usd(spark, sf):
    name = F.regexp_replace(F.upper("p_brand"), "#", "")
    messy = F.when(F.col("p_partkey") % 5 == 0, F.concat(name, F.lit("/EUR"))).otherwise(F.concat(F.lit("  "), name, F.lit("-USD ")))
    listed = table(spark, sf, "part").select(messy.alias("ticker"), F.col("p_partkey").alias("rank"))
    return files.usd_universe(listed, 12)


_OLD = "old AS (SELECT * FROM bars_day WHERE date_part('day', ts) < 20)"
_NEW = "new AS (SELECT ticker, ts, open, high, low, close * 2 AS close, volume, trades FROM bars_day WHERE date_part('day', ts) >= 10)"
_UPSERT = [_OLD, _NEW, "merged AS (SELECT * FROM new UNION ALL SELECT * FROM old WHERE (ticker, ts) NOT IN (SELECT (ticker, ts) FROM new))"]


def _old_new(spark, sf):
    b = bars_day(spark, sf)
    return b.where(F.dayofmonth("ts") < 20), b.where(F.dayofmonth("ts") >= 10).withColumn("close", F.col("close") * 2)


@query("s8_upsert_bars", using("bars_day", f"SELECT ticker, {DAY}, {r('close')} AS close, trades FROM merged", *_UPSERT))
def s8(spark, sf):
    old, new = _old_new(spark, sf)
    path = scratch_path(spark, "upserted")
    for batch in (old, new, new):  # the repeated batch changes nothing
        store.write_upsert(batch.withColumn("year", F.year("ts")), path, ["ticker", "ts"], partitions=["year"])
    return spark.read.parquet(path).select("ticker", day(), rnd("close").alias("close"), "trades")


@query("s9_append_result", using("bars_month", f"SELECT ticker, count(*) * 2 AS n, {r('sum(volume) * 2', 2)} AS volume FROM bars_month GROUP BY ticker"))
def s9(spark, sf):
    path = scratch_path(spark, "appended")
    b = bars_month(spark, sf)
    store.append_result(b, path)
    store.append_result(b, path)
    return spark.read.parquet(path).groupBy("ticker").agg(F.count(F.lit(1)).alias("n"), rnd(F.sum("volume"), 2).alias("volume"))


@query("s10_insert_ignore", using("news", """SELECT link, size, digest FROM (
  SELECT link, length(description) AS size, md5(description) AS digest FROM news WHERE link % 3 = 0 UNION ALL
  SELECT link, length(description) + 1000, md5(description) FROM news WHERE link % 3 <> 0)"""))
def s10(spark, sf):
    n = news(spark, sf).select("link", F.length("description").cast("long").alias("size"), F.md5("description").alias("digest"), "published")
    arrivals = n.withColumn("size", F.col("size") + 1000)
    later = n.withColumns({"size": F.col("size") + 5000, "published": F.col("published") + F.expr("INTERVAL 1 DAY")})
    return store.insert_ignore(n.where("link % 3 = 0"), arrivals.unionByName(later), "link", ["published"]).drop("published")


@query("s11_upsert_result", using("bars_day", f"""SELECT ticker, CAST(year(ts) AS INTEGER) AS year, arg_max(strftime(ts, '%Y-%m-%d'), ts) AS updated,
  {r('arg_max(close, ts)')} AS close FROM bars_day GROUP BY ALL"""))
def s11(spark, sf):
    b = bars_day(spark, sf).select("ticker", F.year("ts").alias("year"), "ts", "close")
    h1, h2 = b.where(F.month("ts") <= 6), b.where(F.month("ts") > 6)
    both = store.upsert(h1, h2, ["ticker", "year"], ["ts"])
    return both.select("ticker", "year", F.date_format("ts", "yyyy-MM-dd").alias("updated"), rnd("close").alias("close"))


@query("s12_write_csv", using("bars_month", f"SELECT ticker, {DAY}, {r_all(OHLCV)} FROM bars_month"))
def s12(spark, sf):
    path = scratch_path(spark, "csv")
    b = bars_month(spark, sf).select("ticker", day(), *rounded(OHLCV))
    files.write_csv(b, path)
    return spark.read.schema(b.schema).option("header", True).csv(path)


@query("s12_write_json", using("bars_month", f"SELECT ticker, {DAY}, {r_all(OHLCV)} FROM bars_month"))
def s12_json(spark, sf):
    path = scratch_path(spark, "json")
    b = bars_month(spark, sf).select("ticker", day(), *rounded(OHLCV))
    files.write_json(b, path)
    return spark.read.schema(b.schema).json(path)


@query("s13_read_result", using("bars_source", f"""SELECT ticker, source, {DAY}, {r('close')} AS close FROM bars_source
  WHERE source = 'yfinance' AND ticker = 'Brand#3' AND ts >= TIMESTAMP '1997-01-01' ORDER BY ts DESC"""))
def s13(spark, sf):
    got = store.read_result(bars_source(spark, sf), {"source": "yfinance", "ticker": "Brand#3", "interval": None},
                            newest="ts", since=("ts", "1997-01-01"))
    return got.select("ticker", "source", day(), rnd("close").alias("close"))


@query("s15_bars_day", using("bars_day", f"SELECT ticker, {DAY}, {r_all(OHLCV)}, trades FROM bars_day"))
def s15_day(spark, sf):
    return bars_day(spark, sf).select("ticker", day(), *rounded(OHLCV), "trades")


@query("s15_bars_month", using("bars_month", f"SELECT ticker, {DAY}, {r_all(OHLCV)}, trades FROM bars_month"))
def s15_month(spark, sf):
    return bars_month(spark, sf).select("ticker", day(), *rounded(OHLCV), "trades")


@query("s15_bars_hour", using("bars_hour", f"SELECT ticker, strftime(ts, '%Y-%m-%d %H') AS h, {r_all(OHLCV)}, trades FROM bars_hour"))
def s15_hour(spark, sf):
    return bars_hour(spark, sf).select("ticker", F.date_format("ts", "yyyy-MM-dd HH").alias("h"), *rounded(OHLCV), "trades")


@query("s15_bars_15m", using("ticks", f"""SELECT ticker, strftime(bar, '%Y-%m-%d %H:%M') AS t, {r('arg_min(price, row(ts, event_id))')} AS open,
  {r('arg_max(price, row(ts, event_id))')} AS close, count(*) AS trades FROM (SELECT *, time_bucket(INTERVAL 15 MINUTE, ts) AS bar FROM ticks) GROUP BY ticker, bar"""))
def s15_15m(spark, sf):
    b = bars_from_trades(ticks(spark, sf).withColumn("size", F.lit(1.0)), "15m", tiebreak=["event_id"])
    return b.select("ticker", F.date_format("ts", "yyyy-MM-dd HH:mm").alias("t"), *rounded(["open", "close"]), "trades")


@query("s14_migrate_add_column", """SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN 'SET' ELSE replace(p_brand, 'Brand#', 'X') END AS base_symbol FROM part""")
def s14(spark, sf):
    t = table(spark, sf, "part").select("p_partkey", F.regexp_replace("p_brand", "Brand#", "x").alias("ticker"),
                                        F.when(F.col("p_size") % 2 == 0, "SET").alias("base_symbol"))
    return store.migrate_add_base_symbol(t).select("p_partkey", "base_symbol")


@query("u1_union_sources", using("bars_source", """SELECT upper(ticker) || CASE source WHEN 'yfinance' THEN '_yf' ELSE '_bn' END AS entity,
  count(*) AS bars FROM bars_source GROUP BY ticker, source"""))
def u1(spark, sf):
    b = bars_source(spark, sf)
    both = store.union_sources({"yf": b.where("source = 'yfinance'"), "bn": b.where("source = 'binance'")})
    return both.groupBy("entity").agg(F.count(F.lit(1)).alias("bars"))


@query("u2_concat_keep_last", using("bars_day", f"SELECT ticker, {DAY}, {r('close')} AS close FROM merged", *_UPSERT))
def u2(spark, sf):
    old, new = _old_new(spark, sf)
    return store.keep_last(old, new, keys=["ticker", "ts"]).select("ticker", day(), rnd("close").alias("close"))


