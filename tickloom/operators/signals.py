"""Signal rows and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickloom.functions import labels
from tickloom.operators.core import Piece, latest_n
from tickloom.operators.cross import price_at
from tickloom.operators.series import (
    backtest_summary, macd_step, rsi_step, run_steps, signal_of, threshold_signal, trade_pairs,
)


def signal_rows(forecast: DataFrame, bars: DataFrame, model: str, threshold: float = 0.01, confidence: float | None = None,
                every: str = "1d") -> DataFrame:
    """Signals shaped for storage: the actual price where there is one, else the forecast."""
    s = threshold_signal(forecast, "forecast", threshold, every=every)
    s = price_at(s.select("ticker", "ts", "forecast", "pct_change", "signal"), bars)
    return s.select(
        "ticker", F.lit(model).alias("model"), F.to_date("ts").alias("signal_date"), F.col("signal").alias("signal_type"),
        F.coalesce("actual_price", "forecast").alias("price"), F.col("forecast").alias("predicted_price"),
        (F.col("pct_change") * 100).alias("expected_profit"), F.lit(confidence).cast("double").alias("confidence"),
        F.to_json(F.struct(F.lit(model).alias("model_type"), F.lit(threshold).alias("threshold"), "forecast")).alias("indicators"))


def signal_report(bars: DataFrame, forecast: DataFrame, threshold: float = 0.01, every: str = "1d") -> DataFrame:
    """One row per ticker: latest signal, indicators over the last 50 closes, confidence, targets, risk.

    ``forecast`` is (ticker, ts, forecast). All windows run over at most 50 bars and two forecasts per ticker.
    """
    recent = latest_n(bars, 50)
    by_time = Window.partitionBy("ticker").orderBy("ts")  # at most 50 rows
    d = recent.withColumn("_i", F.row_number().over(by_time) - 1).withColumn("_b", F.lit(0))
    piece = Piece(["ticker"])
    for step in (rsi_step("close"), macd_step("close")):
        d = step.apply(d, piece)
    prev = F.lag("close").over(piece.order)
    d = d.withColumn("_r", F.col("close") / F.when(prev != 0, prev) - 1)
    newest20 = F.col("age") <= 20
    now = d.groupBy("ticker").agg(
        F.max_by("close", "ts").alias("current_price"), F.max_by("rsi", "ts").alias("_rsi"),
        F.max_by("macd", "ts").alias("macd"), F.stddev_samp("_r").alias("_vol"),
        F.avg(F.when(newest20, F.col("close"))).alias("_avg"), F.count(F.when(newest20, F.col("close"))).alias("_k"))
    price = F.col("current_price")
    now = now.withColumn("ma20", F.when(F.col("_k") >= 20, F.col("_avg")).otherwise(price)).drop("_avg", "_k")
    now = now.withColumn("ma_trend", F.when(price > F.col("ma20"), "Bullish").otherwise("Bearish"))
    two = latest_n(forecast.select("ticker", "ts", "forecast"), 2).groupBy("ticker").agg(
        F.max_by("forecast", "ts").alias("_z"), F.min_by("forecast", "ts").alias("_a"), F.count(F.lit(1)).alias("_m"))
    change = F.col("_z") / F.when((F.col("_m") == 2) & (F.col("_a") != 0), F.col("_a")) - 1
    last = two.select("ticker", signal_of(change, threshold).alias("current_signal"))
    d = now.join(last, "ticker", "left")
    signal = F.col("current_signal")
    d = d.withColumns({"current_signal": F.coalesce(signal, F.lit("HOLD")), "rsi": F.coalesce("_rsi", F.lit(50.0))})
    d = d.withColumns({
        "confidence": labels.confidence(signal, F.col("rsi")), "expected_return": labels.expected_return(signal),
        "risk_score": labels.risk_score(F.col("_vol"))})
    return d.withColumns({
        "target_price": price * (1 + F.col("expected_return")), "stop_loss": labels.stop_loss(signal, price),
        "risk_level": labels.risk_level(F.col("risk_score"))}).drop("_rsi", "_vol")


def signal_pnl(bars: DataFrame, forecast: DataFrame, threshold: float = 0.01, every: str = "1d") -> DataFrame:
    """The closed signals that go with a report: entry and exit, their prices and the profit of each, per ticker."""
    s = threshold_signal(forecast, "forecast", threshold, every=every).select("ticker", "ts", "signal")
    return trade_pairs(price_at(s, bars), "actual_price", every=every)


def report_history(bars: DataFrame, periods: int = 7) -> DataFrame:
    """The bars to show next to a report: at least 30, twice the forecast length if that is more."""
    return latest_n(bars, max(30, 2 * periods))


def backtest_report(prices: DataFrame, forecast: DataFrame, threshold: float = 0.01, every: str = "1d") -> DataFrame:
    """Return, trades and Sharpe-like ratio of the forecast's signals at the given prices, per ticker."""
    s = threshold_signal(forecast, "forecast", threshold, every=every)
    s = price_at(s.select("ticker", "ts", "signal"), prices)
    trades = trade_pairs(s, "actual_price", every=every)
    return forecast.select("ticker").distinct().join(backtest_summary(trades), "ticker", "left").na.fill(
        0, ["total_return", "trades"])


def backtest_series(prices: DataFrame, forecast: DataFrame, threshold: float = 0.01, every: str = "1d") -> DataFrame:
    """What goes with a backtest at every time: price, signal, RSI and MACD of the prices."""
    shown = run_steps(prices.select("ticker", "ts", "close"), [rsi_step("close"), macd_step("close")], every=every)
    s = threshold_signal(forecast, "forecast", threshold, every=every).select("ticker", "ts", "signal")
    return shown.join(s, ["ticker", "ts"], "left")


def projection(last_price: DataFrame, signals: DataFrame, periods: int = 7) -> DataFrame:
    """Simple outlook from a stored signal: the price grows 1 % per step, the confidence shrinks.

    ``signals`` is (ticker, signal), the current one.
    """
    sure = F.when(F.col("signal") == "HOLD", 0.6).otherwise(0.8)
    d = last_price.join(signals, "ticker", "left").withColumn("signal", F.coalesce("signal", F.lit("HOLD")))
    d = d.withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(periods - 1))))
    return d.withColumns({
        "price": F.col("current_price") * (1 + F.col("step") * 0.01),
        "confidence": F.greatest(F.lit(0.1), sure - F.col("step") * 0.05),
        "expected_return": labels.expected_return(F.col("signal"), 0.03, -0.02),
        "code": labels.signal_code(F.col("signal"))})


def with_history(bars: DataFrame, forecast: DataFrame, col: str = "close") -> DataFrame:
    """History and forecast below each other: (ticker, ts, value, kind)."""
    return bars.select("ticker", "ts", F.col(col).alias("value"), F.lit("history").alias("kind")).unionByName(
        forecast.select("ticker", "ts", F.col("forecast").alias("value"), F.lit("forecast").alias("kind")))
