"""Statistics and cross-section queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickloom.functions import labels
from tickloom.operators import cross as X
from tickloom.operators import series as S
from tickloom.operators import stats as A
from tickloom.operators.runs import recent_activity
from tickloom.plans.quality_queries import rounded
from tickloom.plans.registry import DAY, day, query, r, rnd
from tickloom.plans.series_queries import RETURNS, SIGNALS
from tickloom.plans.views import (
    bars_day, bars_month, bars_source, news, table, ticks, using,
)

FE = ["open", "high", "low", "close", "volume"]
CELLS = "cells AS (" + " UNION ALL ".join(f"SELECT ticker, ts, '{c}' AS feature, {c} AS value FROM bars_day" for c in FE) + ")"


@query("a1_describe_series", using("bars_day", f"""SELECT ticker, feature, count(*) AS n, strftime(min(ts), '%Y-%m-%d') AS first_day,
  strftime(max(ts), '%Y-%m-%d') AS last_day, """ + ", ".join(
    f"CASE WHEN feature = 'volume' THEN {r(e, 2)} ELSE {r(e, 4)} END AS {n}" for n, e in (
        ("mean", "avg(value)"), ("median", "quantile_cont(value, 0.5)"), ("std", "stddev_samp(value)"),
        ("min", "min(value)"), ("max", "max(value)"))) + " FROM cells GROUP BY ticker, feature", CELLS))
def a1(spark, sf):
    d = A.describe_series(bars_day(spark, sf), rounded=False)
    return d.select("ticker", "feature", "n", F.date_format("first_ts", "yyyy-MM-dd").alias("first_day"),
                    F.date_format("last_ts", "yyyy-MM-dd").alias("last_day"),
                    *[F.when(F.col("feature") == "volume", rnd(c, 2)).otherwise(rnd(c, 4)).alias(c)
                      for c in ["mean", "median", "std", "min", "max"]])


@query("a2_return_stats", using("bars_day", f"""SELECT ticker, count(ret) AS returns, {r('avg(ret) * 100')} AS daily_return_mean,
  {r('stddev_samp(ret) * 100')} AS daily_return_std, {r('stddev_samp(ret) * sqrt(252) * 100', 2)} AS volatility_annualized FROM ret GROUP BY ticker""", RETURNS))
def a2(spark, sf):
    return A.return_stats(bars_day(spark, sf)).select(
        "ticker", "returns", *rounded(["daily_return_mean", "daily_return_std"]), *rounded(["volatility_annualized"], 2))


@query("a3_price_change", using("bars_day", f"""SELECT ticker, {r('arg_max(close, ts) - arg_min(close, ts)')} AS price_change,
  {r('(arg_max(close, ts) - arg_min(close, ts)) / arg_min(close, ts) * 100', 2)} AS price_change_pct FROM bars_day GROUP BY ticker"""))
def a3(spark, sf):
    return A.price_change(bars_day(spark, sf)).select("ticker", *rounded(["price_change"]), *rounded(["price_change_pct"], 2))


@query("a4_volume_stats", using("bars_day", f"SELECT ticker, {r('avg(volume)', 2)} AS avg_daily_volume, {r('sum(volume)', 2)} AS total_volume FROM bars_day GROUP BY ticker"))
def a4(spark, sf):
    return A.volume_stats(bars_day(spark, sf)).select("ticker", *rounded(["avg_daily_volume", "total_volume"], 2))


def stored_bars(spark, sf):
    return bars_source(spark, sf).withColumn("interval", F.lit("1d"))


@query("a5_data_summary", using("bars_source", """SELECT ticker, source, '1d' AS interval, strftime(min(ts), '%Y-%m-%d') AS first_date,
  strftime(max(ts), '%Y-%m-%d') AS last_date, count(*) AS record_count, strftime(max(ts), '%Y-%m-%d') AS last_update FROM bars_source GROUP BY ticker, source"""))
def a5(spark, sf):
    d = A.data_summary(stored_bars(spark, sf))
    return d.withColumns({c: F.date_format(c, "yyyy-MM-dd") for c in ("first_date", "last_date", "last_update")})


@query("a6_db_rollup", using("bars_source", """SELECT count(DISTINCT ticker) AS unique_tickers, string_agg(DISTINCT source, ',' ORDER BY source) AS sources,
  count(*) AS total_records, strftime(min(ts), '%Y-%m-%d') AS start, strftime(max(ts), '%Y-%m-%d') AS "end" FROM bars_source"""))
def a6(spark, sf):
    d = A.db_rollup(A.data_summary(stored_bars(spark, sf)))
    return d.withColumns({c: F.date_format(c, "yyyy-MM-dd") for c in ("start", "end")})


FOUR = ["Brand#1", "Brand#2", "Brand#3", "Brand#4"]
ALL = [f"Brand#{i}" for i in range(1, 26)]


def _corr_ctes(tickers, source) -> list[str]:
    names = ", ".join(f"'{t}'" for t in tickers)
    return [
        f"chosen AS (SELECT * FROM {source} WHERE ticker IN ({names}))",
        f"full_ts AS (SELECT ts FROM chosen GROUP BY ts HAVING count(*) = {len(tickers)})",
        "aligned AS (SELECT * FROM chosen WHERE ts IN (SELECT ts FROM full_ts))",
        f"matrix AS (SELECT a.ticker AS t1, b.ticker AS t2, {r('corr(a.close, b.close)')} AS corr FROM aligned a JOIN aligned b ON a.ts = b.ts GROUP BY ALL)",
        "pairs AS (SELECT * FROM matrix WHERE t1 < t2)",
    ]


@query("j1_align", using("bars_day", f"SELECT {DAY}, " + ", ".join(
    f"{r(f'''max(close) FILTER (ticker = '{t}')''')} AS c{i}" for i, t in enumerate(FOUR)) + " FROM aligned GROUP BY ts", *_corr_ctes(FOUR, "bars_day")))
def j1(spark, sf):
    return X.align(bars_day(spark, sf), FOUR).select(day(), *[rnd(F.col(f"`{t}`")).alias(f"c{i}") for i, t in enumerate(FOUR)])


@query("j1_common_range", using("bars_day", """SELECT strftime(max(a), '%Y-%m-%d') AS start, strftime(min(z), '%Y-%m-%d') AS "end", count(*) AS tickers
  FROM (SELECT min(ts) AS a, max(ts) AS z FROM chosen GROUP BY ticker)""", *_corr_ctes(FOUR, "bars_day")))
def j1_range(spark, sf):
    d = X.common_range(bars_day(spark, sf), FOUR)
    return d.withColumns({c: F.date_format(c, "yyyy-MM-dd") for c in ("start", "end")})


@query("a7_corr_matrix", using("bars_day", "SELECT * FROM matrix", *_corr_ctes(FOUR, "bars_day")))
def a7(spark, sf):
    return X.corr_matrix(bars_day(spark, sf), FOUR).select("t1", "t2", rnd("corr").alias("corr"))


@query("a7_corr_matrix_all", using("bars_month", "SELECT * FROM matrix", *_corr_ctes(ALL, "bars_month")))
def a7_all(spark, sf):
    return X.corr_matrix(bars_month(spark, sf), ALL).select("t1", "t2", rnd("corr").alias("corr"))


@query("j6_pairs", using("bars_month", "SELECT *, CASE WHEN abs(corr) >= 0.7 THEN 'Strong' WHEN abs(corr) >= 0.4 THEN 'Moderate' ELSE 'Weak' END AS strength FROM pairs", *_corr_ctes(ALL, "bars_month")))
def j6(spark, sf):
    p = X.pairs(X.correlations(bars_month(spark, sf), ALL))
    return p.select("t1", "t2", rnd("corr").alias("corr"), labels.correlation_strength(F.col("corr")).alias("strength"))


@query("a8_corr_stats", using("bars_month", f"""SELECT {r('avg(corr)')} AS avg_corr, {r('max(corr)')} AS max_corr, {r('min(corr)')} AS min_corr,
  {r('stddev_pop(corr)')} AS std_corr FROM pairs""", *_corr_ctes(ALL, "bars_month")))
def a8(spark, sf):
    return X.corr_stats(X.correlations(bars_month(spark, sf), ALL)).select(*rounded(["avg_corr", "max_corr", "min_corr", "std_corr"]))


@query("t1_top_pairs", using("bars_month", """SELECT 'positive' AS side, * FROM (SELECT * FROM pairs ORDER BY corr DESC, t1, t2 LIMIT 4)
  UNION ALL SELECT 'negative', * FROM (SELECT * FROM pairs ORDER BY corr, t1, t2 LIMIT 4)""", *_corr_ctes(ALL, "bars_month")))
def t1(spark, sf):
    m = X.correlations(bars_month(spark, sf), ALL)
    return X.top_pairs(m, 4).withColumn("side", F.lit("positive")).unionByName(
        X.top_pairs(m, 4, positive=False).withColumn("side", F.lit("negative"))
    ).select("side", "t1", "t2", rnd("corr").alias("corr"))


@query("a22_corr_heatmap", using("bars_month", "SELECT t1, " + ", ".join(
    f"""CASE WHEN t1 = '{t}' THEN 1.0 ELSE coalesce(max(corr) FILTER (t2 = '{t}' AND abs(corr) >= 0.1), 0.0) END AS c{i}""" for i, t in enumerate(ALL))
    + " FROM matrix GROUP BY t1", *_corr_ctes(ALL, "bars_month")))
def a22(spark, sf):
    known = X.pairs(X.correlations(bars_month(spark, sf), ALL)).where(F.abs("corr") >= 0.1)
    return X.corr_heatmap(known, ALL).select("t1", *[rnd(F.col(f"`{t}`")).alias(f"c{i}") for i, t in enumerate(ALL)])


@query("a19_histogram", using("bars_day", f"""SELECT ticker, feature, bin, count(*) AS n, {r('any_value(lo) + any_value(w) * bin')} AS lower, {r('any_value(lo) + any_value(w) * (bin + 1)')} AS upper FROM (
  SELECT ticker, feature, lo, (hi - lo) / 20 AS w, CAST(least(floor(coalesce((value - lo) / nullif((hi - lo) / 20, 0), 0)), 19) AS INTEGER) AS bin FROM (
  SELECT *, min(value) OVER p AS lo, max(value) OVER p AS hi FROM cells WINDOW p AS (PARTITION BY ticker, feature))) GROUP BY ticker, feature, bin""", CELLS))
def a19(spark, sf):
    return A.histogram(bars_day(spark, sf), 20).select("ticker", "feature", "bin", "n", *rounded(["lower", "upper"]))


@query("a20_box_stats", using("bars_day", f"""SELECT ticker, feature, {r('q1')} AS q1, {r('median')} AS median, {r('q3')} AS q3,
  {r('min(value) FILTER (ok)')} AS whisker_low, {r('max(value) FILTER (ok)')} AS whisker_high, count(*) FILTER (NOT ok) AS outliers FROM (
  SELECT *, value BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) AS ok FROM cells JOIN (
  SELECT ticker, feature, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.5) AS median, quantile_cont(value, 0.75) AS q3 FROM cells GROUP BY ALL)
  USING (ticker, feature)) GROUP BY ticker, feature, q1, median, q3""", CELLS))
def a20(spark, sf):
    return A.box_stats(bars_day(spark, sf)).select(
        "ticker", "feature", *rounded(["q1", "median", "q3", "whisker_low", "whisker_high"]), "outliers")


def assigned(spark, sf):
    """Tickers in clusters by their brand number."""
    t = table(spark, sf, "part").select(F.col("p_brand").alias("ticker")).distinct()
    return t.withColumn("cluster", (F.regexp_extract("ticker", r"(\d+)$", 1).cast("int") % 4))


_ASSIGNED = "assigned AS (SELECT DISTINCT p_brand AS ticker, CAST(regexp_extract(p_brand, '(\\d+)$', 1) AS INTEGER) % 4 AS cluster FROM part)"


@query("a9_cluster_groups", f"WITH {_ASSIGNED} SELECT cluster, string_agg(ticker, ',' ORDER BY ticker) AS members FROM assigned GROUP BY cluster")
def a9(spark, sf):
    return X.cluster_groups(assigned(spark, sf)).select("cluster", F.array_join("members", ",").alias("members"))


@query("a10_cluster_profile", using("bars_day", f"""SELECT cluster, count(*) AS size, count(vol) AS tickers_with_data, {r('avg(ret)')} AS avg_return,
  {r('avg(vol)')} AS avg_volatility, CASE WHEN avg(vol) > 0.5 THEN 'High' WHEN avg(vol) > 0.3 THEN 'Medium' ELSE 'Low' END AS risk_level
  FROM assigned LEFT JOIN per USING (ticker) GROUP BY cluster""", RETURNS, _ASSIGNED,
  "per AS (SELECT ticker, avg(ret) * 252 AS ret, stddev_samp(ret) * sqrt(252) AS vol FROM ret GROUP BY ticker HAVING count(ret) > 1)"))
def a10(spark, sf):
    d = X.cluster_profile(assigned(spark, sf), bars_day(spark, sf))
    return d.select("cluster", "size", "tickers_with_data", *rounded(["avg_return", "avg_volatility"]), "risk_level")


@query("a17_table_counts", "SELECT 'orders' AS table_name, count(*) AS rows FROM orders UNION ALL SELECT 'lineitem', count(*) FROM lineitem UNION ALL SELECT 'events', count(*) FROM events UNION ALL SELECT 'documents', count(*) FROM documents")
def a17(spark, sf):
    return X.table_counts({t: table(spark, sf, t) for t in ("orders", "lineitem", "events", "documents")})


@query("a17_recent_activity", using("ticks", """SELECT ticker, count(*) AS recent FROM ticks
  WHERE ts > (SELECT max(ts) FROM ticks) - INTERVAL 24 HOUR GROUP BY ticker"""))
def a17_recent(spark, sf):
    t = ticks(spark, sf)
    return recent_activity(t, "ts", t.agg(F.max("ts")).scalar(), hours=24, by="ticker")


_REQ = "requests AS (SELECT DISTINCT 'X' || p_size || CASE p_partkey % 4 WHEN 0 THEN '_yf' WHEN 1 THEN '_bn' WHEN 2 THEN '' ELSE '-USD' END AS entity FROM part)"
_KNOWN = "known AS (SELECT DISTINCT 'X' || p_size || CASE p_partkey % 3 WHEN 0 THEN '-USD' WHEN 1 THEN 'USDT' ELSE '' END AS ticker FROM part WHERE p_size % 5 <> 0)"


@query("j2_resolve_tickers", f"""WITH {_REQ}, {_KNOWN},
  tries AS (SELECT entity, regexp_replace(entity, '_yf|_bn', '') AS clean FROM requests),
  spelled AS (SELECT entity, unnest([0, 1, 2, 3, 4, 5]) AS prio, unnest([entity, clean, clean || '-USD', clean || 'USD', clean || 'USDT', clean]) AS ticker FROM tries)
  SELECT entity, arg_min(k.ticker, prio) AS ticker FROM spelled LEFT JOIN known k USING (ticker) GROUP BY entity""")
def j2(spark, sf):
    part = table(spark, sf, "part")
    k4, k3 = F.col("p_partkey") % 4, F.col("p_partkey") % 3
    x = F.concat(F.lit("X"), F.col("p_size").cast("string"))
    requests = part.select(F.concat(x, F.when(k4 == 0, "_yf").when(k4 == 1, "_bn").when(k4 == 2, "").otherwise("-USD")).alias("entity"))
    known = part.where("p_size % 5 <> 0").select(F.concat(x, F.when(k3 == 0, "-USD").when(k3 == 1, "USDT").otherwise("")).alias("ticker"))
    return X.resolve_tickers(requests, known)


@query("j3_price_at", using("bars_day", f"""SELECT s.ticker, strftime(s.ts, '%Y-%m-%d') AS d, s.signal, {r('b.close')} AS actual_price
  FROM signals s LEFT JOIN (SELECT * FROM bars_day WHERE volume > 20) b ON b.ticker = s.ticker AND b.ts = s.ts""", RETURNS, SIGNALS))
def j3(spark, sf):
    b = bars_day(spark, sf)
    s = S.threshold_signal(b).select("ticker", "ts", "signal")
    return X.price_at(s, b.where("volume > 20")).select("ticker", day(), "signal", rnd("actual_price").alias("actual_price"))


@query("j8_keep_universe", using("bars_day", "SELECT ticker, count(*) AS bars FROM bars_day WHERE ticker IN (SELECT p_brand FROM part WHERE p_size = 1) GROUP BY ticker"))
def j8(spark, sf):
    u = table(spark, sf, "part").where("p_size = 1").select(F.col("p_brand").alias("ticker"))
    return X.keep_universe(bars_day(spark, sf), u).groupBy("ticker").agg(F.count(F.lit(1)).alias("bars"))


@query("j8_unknown_tickers", """SELECT DISTINCT p_brand || '/' || p_size AS ticker FROM part
  WHERE p_brand || '/' || p_size NOT IN (SELECT p_brand || '/' || p_size FROM part WHERE p_retailprice > 1000)""")
def j8_unknown(spark, sf):
    p = table(spark, sf, "part").withColumn("ticker", F.concat_ws("/", "p_brand", F.col("p_size").cast("string")))
    return X.unknown_tickers(p, p.where("p_retailprice > 1000"))


_MAPPING = "mapping AS (SELECT 'B' || p_partkey AS base_symbol, 'B' || p_partkey || '-USD' AS yfinance_ticker, 'B' || p_partkey || 'USDT' AS binance_ticker, p_name AS common_name FROM part)"


@query("j9_find_mapping", f"""WITH {_MAPPING}, asked AS (SELECT l_orderkey, 'B' || l_partkey || CASE l_linenumber % 4 WHEN 0 THEN '' WHEN 1 THEN '-USD' WHEN 2 THEN 'USDT' ELSE '/EUR' END AS spelled FROM lineitem)
  SELECT base_symbol, count(*) AS n, min(common_name) AS common_name FROM asked JOIN mapping ON spelled IN (base_symbol, yfinance_ticker, binance_ticker) GROUP BY base_symbol""")
def j9(spark, sf):
    b = F.concat(F.lit("B"), F.col("p_partkey").cast("string"))
    mapping = table(spark, sf, "part").select(
        b.alias("base_symbol"), F.concat(b, F.lit("-USD")).alias("yfinance_ticker"),
        F.concat(b, F.lit("USDT")).alias("binance_ticker"), F.col("p_name").alias("common_name"))
    k = F.col("l_linenumber") % 4
    asked = table(spark, sf, "lineitem").select(F.concat(
        F.lit("B"), F.col("l_partkey").cast("string"),
        F.when(k == 0, "").when(k == 1, "-USD").when(k == 2, "USDT").otherwise("/EUR")).alias("spelled"))
    return X.find_mapping(asked, mapping).groupBy("base_symbol").agg(
        F.count(F.lit(1)).alias("n"), F.min("common_name").alias("common_name"))


@query("t2_newest", using("news", "SELECT link, description FROM news ORDER BY published DESC LIMIT 20"))
def t2(spark, sf):
    return X.newest(news(spark, sf), 20, "published").select("link", "description")


@query("t3_best_of", """SELECT trace_id, best, best_score FROM (SELECT l_orderkey AS trace_id, 's' || l_linenumber AS best, l_extendedprice AS best_score,
  row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice, 's' || l_linenumber) AS k FROM lineitem) WHERE k = 1""")
def t3(spark, sf):
    t = table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("trace_id"), F.concat(F.lit("s"), F.col("l_linenumber").cast("string")).alias("model"),
        F.col("l_extendedprice").alias("rmse"))
    return X.best_of(t, "trace_id", "model", "rmse")


@query("t4_latest_per", using("bars_source", f"""SELECT ticker, source, strftime(max(ts), '%Y-%m-%d') AS updated, {r('arg_max(close, ts)')} AS close
  FROM bars_source GROUP BY ticker, source"""))
def t4(spark, sf):
    d = X.latest_per(bars_source(spark, sf), ["ticker", "source"], "ts")
    return d.select("ticker", "source", F.date_format("ts", "yyyy-MM-dd").alias("updated"), rnd("close").alias("close"))


@query("t5_target_date", using("bars_day", "SELECT ticker, strftime(min(ts) FILTER (close >= 30000), '%Y-%m-%d') AS target_day FROM bars_day GROUP BY ticker"))
def t5(spark, sf):
    f = bars_day(spark, sf).withColumnRenamed("close", "forecast")
    return X.target_date(f, F.lit(30000.0)).select("ticker", F.date_format("target_ts", "yyyy-MM-dd").alias("target_day"))


@query("f12_labels", using("ticks", """SELECT event_id, CASE WHEN x > 0.3 THEN 'Positive' WHEN x < -0.3 THEN 'Negative' ELSE 'Neutral' END AS sentiment,
  CASE WHEN abs(x) >= 0.7 THEN 'Strong' WHEN abs(x) >= 0.4 THEN 'Moderate' ELSE 'Weak' END AS strength,
  CASE WHEN least(abs(x), 1) > 0.7 THEN 'High' WHEN least(abs(x), 1) > 0.4 THEN 'Medium' ELSE 'Low' END AS risk
  FROM (SELECT event_id, price / 100 - 1 AS x FROM ticks)"""))
def f12(spark, sf):
    x = F.col("price") / 100 - 1
    return ticks(spark, sf).select(
        "event_id", labels.sentiment_label(x).alias("sentiment"), labels.correlation_strength(x).alias("strength"),
        labels.risk_level(labels.risk_score(F.abs(x) / 10)).alias("risk"))
