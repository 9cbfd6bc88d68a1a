"""Hand-made tables with results worked out by hand."""

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from tickloom.functions import dates, docs, labels, text, tickers
from tickloom.functions.numeric import sanitize, to_number
from tickloom.operators import cross as X
from tickloom.operators import metrics as E
from tickloom.operators import quality as Q
from tickloom.operators import scenarios as P
from tickloom.operators import series as S
from tickloom.operators import signals as G
from tickloom.session import scratch_path
from tickloom.sources import files, store
from tickloom.sources.bars import bars_from_trades


def closes(spark, values, ticker="T", start="2024-01-01"):
    rows = [(ticker, i, None if v is None else float(v)) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "ticker string, i int, close double").select(
        "ticker", F.date_add(F.lit(start).cast("date"), F.col("i")).cast("timestamp").alias("ts"), "close")


def column(d, name):
    return [r[0] for r in d.orderBy("ts").select(name).collect()]


def value(spark, expr):
    return spark.range(1).select(expr.alias("v")).head()[0]


def test_flat_series(spark):
    d = closes(spark, [5.0] * 20)
    assert set(column(S.rsi(d), "rsi")) == {None}
    assert column(S.rsi(d, zero_loss="cap"), "rsi")[14] == pytest.approx(100 - 100 / 101)
    assert set(column(S.rolling_vol(d, n=14), "vol")[14:]) == {0.0}
    assert max(abs(x) for x in column(S.macd(d), "hist")) < 1e-12


def test_rising_series(spark):
    d = closes(spark, range(1, 21))
    r = column(S.rsi(d), "rsi")
    assert r[:14] == [None] * 14 and set(r[14:]) == {100.0}


def test_short_series_stays_null(spark):
    d = closes(spark, range(1, 14))
    assert set(column(S.rsi(d), "rsi")) == {None}
    assert set(column(S.sma(d, {"close": [20]}), "close_sma_20")) == {None}
    assert S.ma_trend(d).head()["ma"] == 13.0  # too few values: the last one itself


def test_ma_warm_up(spark):
    d = column(S.macd(closes(spark, range(1, 41)), warm_up=True), "signal_line")
    assert d[:33] == [None] * 33 and d[33] is not None


def test_one_trade(spark):
    rows = [(i, s, float(10 + i)) for i, s in enumerate("SELL BUY BUY HOLD SELL SELL BUY".split())]
    d = spark.createDataFrame(rows, "i int, signal string, close double").select(
        F.lit("T").alias("ticker"), F.date_add(F.lit("2024-01-01").cast("date"), F.col("i")).cast("timestamp").alias("ts"), "signal", "close")
    t = S.trade_pairs(d).collect()
    assert [(r.entry_price, r.exit_price, r.pnl) for r in t] == [(11.0, 14.0, 3.0)]
    s = S.backtest_summary(S.trade_pairs(d)).head()
    assert s.trades == 1 and s.sharpe is None and s.total_return == pytest.approx(3 / 11)


def test_gaps(spark):
    days = [1, 4, 5, 9, 18, 19, 20]
    d = spark.createDataFrame([("T", f"2024-01-{k:02d} 00:00:00") for k in days], "ticker string, ts string").withColumn(
        "ts", F.col("ts").cast("timestamp"))
    got = Q.missing_ranges(d, "2024-01-01", "2024-01-20").orderBy("first_day").collect()
    assert [(r.first_day.day, r.last_day.day) for r in got] == [(2, 3), (6, 8), (10, 17)]
    got = Q.missing_ranges(d, "2024-01-01", "2024-01-22").orderBy("first_day").collect()
    assert (got[-1].first_day.day, got[-1].last_day.day) == (21, 22)
    none = Q.missing_ranges(d, "2024-02-01", "2024-02-03").collect()
    assert [(r.first_day.day, r.last_day.day) for r in none] == [(1, 3)]


def test_holes(spark):
    d = closes(spark, [None, 2.0, None, None, 5.0, None])
    assert column(Q.interpolate(d, ["close"]), "close") == [2.0, 2.0, 3.0, 4.0, 5.0, 5.0]
    assert column(Q.ffill(d, ["close"]), "close") == [None, 2.0, 2.0, 2.0, 5.0, 5.0]
    assert column(Q.bfill(d, ["close"]), "close") == [2.0, 2.0, 5.0, 5.0, 5.0, None]


def test_flattened_neighbours(spark):
    d = spark.createDataFrame([("T", "2024-01-01", 1.0, None), ("T", "2024-01-02", 4.0, 10.0)],
                              "ticker string, ts string, open double, close double").withColumn("ts", F.col("ts").cast("timestamp"))
    got = {(r.ts.day, r.feature): r.value for r in Q.interpolate_flattened(d, ["open", "close"]).collect()}
    assert got[(1, "close")] == 2.5  # between this day's open and the next day's open


def test_upsert_and_insert_ignore(spark):
    old = spark.createDataFrame([Row(k=1, v="a", t=1), Row(k=2, v="b", t=1)])
    new = spark.createDataFrame([Row(k=2, v="c", t=2), Row(k=2, v="d", t=3), Row(k=3, v="e", t=2)])
    assert sorted((r.k, r.v) for r in store.upsert(old, new, "k", ["t"]).collect()) == [(1, "a"), (2, "d"), (3, "e")]
    assert sorted((r.k, r.v) for r in store.insert_ignore(old, new, "k", ["t"]).collect()) == [(1, "a"), (2, "b"), (3, "e")]


def test_write_upsert_twice_is_once(spark):
    path = scratch_path(spark, "test-upsert")
    new = spark.createDataFrame([Row(k=1, p="x", v=1.0), Row(k=2, p="y", v=2.0)])
    more = spark.createDataFrame([Row(k=2, p="y", v=9.0)])
    for batch in (new, more, more):
        store.write_upsert(batch, path, ["k"], partitions=["p"])
    assert sorted((r.k, r.v) for r in spark.read.parquet(path).collect()) == [(1, 1.0), (2, 9.0)]


@pytest.mark.parametrize("spelled,base,yf,bn", [
    ("BTC", "BTC", "BTC-USD", "BTCUSDT"),
    ("btc-usd", "BTC", "BTC-USD", "BTCUSDT"),
    (" BTCUSDT ", "BTC", "BTC-USD", "BTCUSDT"),
    ("WBTC", "BTC", "BTC-USD", "BTCUSDT"),
    ("STETH", "ETH", "ETH-USD", "ETHUSDT"),
    ("USDT", "USDT", "USDT-USD", "USDT"),
    ("TETHER", "TETHER", "TETHER-USD", "TETHERUSDT"),
    ("BTC-USDT", "BTC", "BTC-USD", "BTC-USDT"),
])
def test_ticker_names(spark, spelled, base, yf, bn):
    t = F.lit(spelled)
    assert value(spark, tickers.base_symbol(t)) == base
    assert value(spark, tickers.format_ticker(t, F.lit("yfinance"))) == yf
    assert value(spark, tickers.format_ticker(t, F.lit("Binance"))) == bn


def test_ticker_validity(spark):
    assert value(spark, tickers.is_valid_ticker(F.lit("btc-usd"), F.lit("yfinance"))) is True
    assert value(spark, tickers.is_valid_ticker(F.lit("BTC"), F.lit("yfinance"))) is False
    assert value(spark, tickers.is_valid_ticker(F.lit("ethusdt"), F.lit("binance"))) is True
    assert value(spark, tickers.format_ticker(F.lit("USDT-USD"), F.lit("binance"))) == "USDTBUSD"
    assert value(spark, tickers.common_name(F.lit("WBTC"))) == "Bitcoin"


def test_bad_numbers(spark):
    d = spark.createDataFrame([("x",), ("",), ("NaN",), ("Infinity",), ("1.5",)], "s string").withColumn("n", to_number(F.col("s")))
    assert [r.n for r in sanitize(d).collect()] == [None, None, None, None, 1.5]


def test_open_and_close_by_tiebreak(spark):
    d = spark.createDataFrame([("T", "2024-01-01 10:00:00", 2, 7.0, 1.0), ("T", "2024-01-01 10:00:00", 1, 5.0, 2.0),
                               ("T", "2024-01-01 11:00:00", 3, 6.0, 3.0)], "ticker string, ts string, id int, price double, size double")
    r = bars_from_trades(d.withColumn("ts", F.col("ts").cast("timestamp")), "1d", tiebreak=["id"]).head()
    assert (r.open, r.high, r.low, r.close, r.volume, r.trades) == (5.0, 7.0, 5.0, 6.0, 6.0, 3)


def test_sentiment_and_tags(spark):
    t = F.lit("Bitcoin RALLY: big gain, but a crash is a risk. Resolution of ether.")
    assert value(spark, text.tag_entities(t)) == ["BTC", "ETH", "SOL"]
    assert value(spark, text.tag_entities(t, mode="word")) == ["BTC", "ETH"]
    assert value(spark, text.sentiment(t)) == 0.0
    assert value(spark, text.sentiment(F.lit("moon and pump, no fear"))) == pytest.approx(1 / 3)
    assert value(spark, text.sentiment(F.lit("nothing"))) == 0.0


def test_labels(spark):
    assert value(spark, labels.market_mood(F.lit(0.1))) == "Neutral"
    assert value(spark, labels.market_mood(F.lit(-0.1))) == "Bearish"
    assert value(spark, labels.confidence(F.lit("BUY"), F.lit(20.0))) == pytest.approx(0.9)
    assert value(spark, labels.stop_loss(F.lit("SELL"), F.lit(100.0))) == pytest.approx(105.0)
    assert value(spark, dates.period_days(F.lit("5y"))) == 1825


def test_documents_filter_before_limit(spark):
    d = spark.createDataFrame([Row(collection="c", document_id=str(i), data='{"a": %d}' % (i % 2) if i else "{}", created_at=i) for i in range(6)])
    got = docs.find_documents(d, "c", {"a": 0}, 2).collect()
    assert [r.document_id for r in got] == ["4", "2"]


def test_corr_of_flat_series_is_null(spark):
    a, b = closes(spark, [1, 2, 3, 4]), closes(spark, [7, 7, 7, 7], "F")
    m = X.corr_matrix(a.unionByName(b), ["T", "F"])
    assert {(r.t1, r.t2): r["corr"] for r in m.collect()}[("T", "F")] is None
    assert X.pairs(m).count() == 0


@pytest.mark.parametrize("k", [4, 25])
def test_corr_of_any_number(spark, k):
    rng = np.random.default_rng(3)
    names = [f"T.{i}" for i in range(k)]  # a dot in the name
    x = rng.normal(size=(12, k)) + 10_000
    x[:, 1] = 7
    rows = [(n, dt.datetime(2024, 1, 1) + dt.timedelta(d), float(x[d, i])) for i, n in enumerate(names) for d in range(12)]
    d = spark.createDataFrame(rows, "ticker string, ts timestamp, close double")
    got = {(r.t1, r.t2): r["corr"] for r in X.corr_matrix(d, names).collect()}
    want = np.corrcoef(np.delete(x, 1, axis=1).T)
    rest = [n for n in names if n != "T.1"]
    assert len(got) == k * k and all(got[a, "T.1"] is None for a in names)
    assert all(got[a, b] == pytest.approx(want[i, j], abs=6e-5) for i, a in enumerate(rest) for j, b in enumerate(rest))
    one = X.corr_matrix(d.where("ts < '2024-01-02'"), names).collect()
    assert len(one) == k * k and all(r["corr"] is None for r in one)
    assert X.corr_matrix(d.limit(0), names).collect() == [] and X.align(d, names).columns == ["ts", *names]


def test_metrics_undefined_is_zero_or_null(spark):
    d = closes(spark, [0.0, 0.0]).select("ticker", "ts", F.lit("m").alias("model"), F.col("close").alias("actual"), F.lit(1.0).alias("predicted"))
    r = E.forecast_metrics(d).head()
    assert (r.rmse, r.mae, r.mape, r.r2) == (1.0, 1.0, 0.0, 0.0)
    assert E.forecast_error(d).head().mape is None


def test_strategy_outcomes(spark):
    d = closes(spark, [100.0, 100.0])
    for sell, outcome, final in ((80.0, "Stop Loss Hit", 90.0), (130.0, "Take Profit Hit", 120.0), (105.0, "Normal Exit", 105.0)):
        r = P.strategy_outcome(d, 1000, sell_price=sell).head()
        assert (r.outcome, round(r.final_price, 6)) == (outcome, final)
    assert P.strategy_outcome(d, 1000, sell_price=1.0, stop_loss_pct=0).head().risk_reward_ratio == math.inf


def test_portfolio_needs_full_weights(spark):
    with pytest.raises(ValueError):
        P.portfolio(closes(spark, [1.0, 2.0]), {"T": 90.0}, 100)


def test_dca_against_a_loop(spark):
    prices = [10, 20, 40, 50, 25, 20, 10, 8]
    r = P.dca(closes(spark, prices), 100, every_n=2, periods=3).head()
    bought = sum(100 / p for p in (prices[2], prices[4], prices[6]))
    assert r.total_quantity == pytest.approx(bought) and r.lump_sum_price == 40
    assert P.dca(closes(spark, prices), 100, every_n=5, periods=3).count() == 0  # too few bars


def test_backtest_of_many_trades_stays_in_range(spark):
    d = spark.createDataFrame([("up", 9.0)] * 500 + [("down", -0.9)] * 500 + [("flip", -3.0)] * 3 + [("lost", -1.0), ("lost", 4.0)] + [("both", 9.0), ("both", -0.9)] * 400,
                              "ticker string, trade_return double")
    got = {r.ticker: r for r in S.backtest_summary(d).collect()}
    assert got["up"].total_return is None and got["up"].out_of_range and got["up"].log_growth == pytest.approx(500 * math.log(10))
    assert got["down"].total_return == -1.0 and got["lost"].total_return == -1.0 and got["flip"].total_return == pytest.approx(-9.0)
    assert got["both"].total_return == pytest.approx(0.0, abs=1e-9) and not got["both"].out_of_range


def test_flatten_keeps_the_bars_of_a_day(spark):
    rows = [("A", dt.datetime(2024, 1, 1 + h // 24, h % 24), float(h)) for h in range(48)]
    d = spark.createDataFrame(rows, "ticker string, ts timestamp, close double")
    back = Q.unflatten(Q.flatten(d, ["close"])).where("value is not null").orderBy("ts").collect()
    assert [r.value for r in back] == [float(h) for h in range(48)] and [r.ts for r in back] == [t for _, t, _ in rows]


def test_map_columns_are_carried(spark):
    d = closes(spark, range(30)).withColumn("m", F.create_map(F.lit("k"), F.col("close")))
    assert S.pct_change(d).where("m['k'] = close and ret is not null").count() == 28  # the first two have none


def test_backtest_counts_tickers_without_trades(spark):
    d = closes(spark, [10.0, 10.0, 10.0])
    r = G.backtest_report(d, d.withColumnRenamed("close", "forecast")).head()
    assert (r.total_return, r.trades, r.sharpe) == (0.0, 0, None)


def test_empty_wide_csv(spark):
    path = scratch_path(spark, "empty-csv")
    spark.createDataFrame([], "ticker string, `2024-01-01_close` string").coalesce(1).write.option("header", True).csv(path)
    assert files.read_wide_csv(spark, path).count() == 0
