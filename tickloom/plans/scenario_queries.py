"""Scenarios, signals and forecast errors."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickloom.operators import metrics as E
from tickloom.operators import scenarios as X
from tickloom.operators import series as S
from tickloom.operators import signals as G
from tickloom.operators.core import run_steps
from tickloom.plans.quality_queries import rounded
from tickloom.plans.registry import DAY, day, query, r, rnd
from tickloom.plans.series_queries import _DELTA, _GAIN, _MACD, PAIRS, RETURNS, SIGNALS
from tickloom.plans.views import bars_day, bars_month, using

W = "OVER (PARTITION BY ticker ORDER BY ts)"

_GRID = f"""grid AS (SELECT ticker, q AS quantity, p AS current_price, p * f AS target_price, p * q AS investment, p * f * q AS future_value,
  p * f * q - p * q AS profit_loss, (p * f - p) / p * 100 AS price_change_pct, (p * f * q - p * q) / (p * q) * 100 AS profit_loss_pct
  FROM (SELECT ticker, arg_max(close, ts) AS p FROM bars_day GROUP BY ticker),
  (SELECT unnest({X.QUANTITIES}) AS q), (SELECT unnest({X.PRICE_FACTORS}) AS f))"""
_GRID_COLS = ["current_price", "target_price", "investment", "future_value", "profit_loss", "price_change_pct", "profit_loss_pct"]


@query("x1_price_grid", using("bars_day", "SELECT ticker, CAST(quantity AS DOUBLE) AS quantity, " + ", ".join(f"{r(c, 2)} AS {c}" for c in _GRID_COLS) + " FROM grid", _GRID))
def x1(spark, sf):
    return X.price_grid(bars_day(spark, sf)).select("ticker", "quantity", *rounded(_GRID_COLS, 2))


@query("j7_scenario_grid", using("bars_day", f"SELECT ticker, count(*) AS scenarios, {r('min(target_price)', 2)} AS lowest, {r('max(target_price)', 2)} AS highest FROM grid GROUP BY ticker", _GRID))
def j7(spark, sf):
    return X.price_grid(bars_day(spark, sf)).groupBy("ticker").agg(
        F.count(F.lit(1)).alias("scenarios"), rnd(F.min("target_price"), 2).alias("lowest"), rnd(F.max("target_price"), 2).alias("highest"))


@query("a21_scenario_rollup", using("bars_day", f"""SELECT ticker, {r('max(profit_loss)', 2)} AS max_profit, {r('min(profit_loss)', 2)} AS min_profit, {r('avg(profit_loss)', 2)} AS avg_profit,
  count(*) AS scenarios, {r('arg_max(profit_loss_pct, profit_loss)', 2)} AS best_roi, {r('arg_min(profit_loss_pct, profit_loss)', 2)} AS worst_roi FROM grid GROUP BY ticker""", _GRID))
def a21(spark, sf):
    d = X.scenario_rollup(X.price_grid(bars_day(spark, sf)))
    return d.select("ticker", *rounded(["max_profit", "min_profit", "avg_profit", "best_roi", "worst_roi"], 2), "scenarios")


_MOMENTS = "moments AS (SELECT ticker, arg_max(close, ts) AS p, avg(ret) AS m, stddev_samp(ret) AS sd FROM ret GROUP BY ticker)"


def _strategy_sql(sell: str) -> str:
    return f"""SELECT ticker, {r('p')} AS buy_price, {r('sell')} AS sell_price, {r('final')} AS final_price,
  CASE WHEN sell <= p * 0.9 THEN 'Stop Loss Hit' WHEN sell >= p * 1.2 THEN 'Take Profit Hit' ELSE 'Normal Exit' END AS outcome,
  {r('1000 / p * final', 4)} AS exit_value, {r('1000 / p * final - 1000', 4)} AS profit_loss, {r('(1000 / p * final - 1000) / 10', 4)} AS roi_pct,
  CAST(100 AS DOUBLE) AS max_loss, CAST(200 AS DOUBLE) AS max_gain, CAST(2 AS DOUBLE) AS risk_reward_ratio
  FROM (SELECT *, CASE WHEN sell <= p * 0.9 THEN p * 0.9 WHEN sell >= p * 1.2 THEN p * 1.2 ELSE sell END AS final
  FROM (SELECT *, {sell} AS sell FROM moments LEFT JOIN (SELECT ticker, avg(close) FILTER (volume > 40) AS fc FROM bars_day GROUP BY ticker) USING (ticker)))"""


def _strategy(d):
    return d.select("ticker", *rounded(["buy_price", "sell_price", "final_price", "exit_value", "profit_loss", "roi_pct"]),
                    "outcome", "max_loss", "max_gain", "risk_reward_ratio")


@query("x2_strategy_outcome", using("bars_day", _strategy_sql("p * pow(1 + m, 2)"), RETURNS, _MOMENTS))
def x2(spark, sf):
    return _strategy(X.strategy_outcome(bars_day(spark, sf), 1000, 2))


@query("x2_strategy_forecast", using("bars_day", _strategy_sql("coalesce(fc, p * pow(1 + m, 2))"), RETURNS, _MOMENTS))
def x2_forecast(spark, sf):
    b = bars_day(spark, sf)
    f = b.groupBy("ticker").agg(F.avg(F.when(F.col("volume") > 40, F.col("close"))).alias("forecast")).withColumn("step", F.lit(2))
    return _strategy(X.strategy_outcome(b, 1000, 2, forecast=f))


_WEIGHTS = {"Brand#1": 40.0, "Brand#2": 30.0, "Brand#3": 20.0, "Brand#4": 10.0}
_POS = "positions AS (SELECT ticker, w, p, 10000 * w / 100 AS inv, m * 30 AS ret30, sd * sqrt(252) AS vol, 10000 * w / 100 / p * (p * (1 + m * 30)) AS predicted FROM moments JOIN (VALUES " \
    + ", ".join(f"('{t}', {w})" for t, w in _WEIGHTS.items()) + ") v(ticker, w) USING (ticker))"


@query("x3_portfolio", using("bars_day", f"""SELECT ticker, CAST(w AS DOUBLE) AS allocation_pct, {r('inv')} AS investment, {r('p')} AS current_price, {r('inv / p')} AS quantity,
  {r('ret30 * 100')} AS expected_return, {r('vol * 100')} AS volatility, {r('predicted', 2)} AS predicted_value FROM positions""", RETURNS, _MOMENTS, _POS))
def x3(spark, sf):
    d = X.portfolio(bars_day(spark, sf), _WEIGHTS, 10000)
    return d.select("ticker", "allocation_pct", *rounded(["investment", "current_price", "quantity", "expected_return", "volatility"]),
                    rnd("predicted_value", 2).alias("predicted_value"))


@query("j10_portfolio_summary", using("bars_day", f"""SELECT {r('c', 2)} AS total_current_value, {r('v', 2)} AS total_predicted_value, {r('(v - c) / c * 100')} AS expected_return_pct,
  {r('s * 100')} AS portfolio_volatility_pct, {r('((v - c) / c * 100 - 0.02) / (s * 100)')} AS sharpe_ratio FROM
  (SELECT sum(inv) AS c, sum(predicted) AS v, sqrt(sum(w * w / 10000 * vol * vol)) AS s FROM positions)""", RETURNS, _MOMENTS, _POS))
def j10(spark, sf):
    d = X.portfolio_summary(X.portfolio(bars_day(spark, sf), _WEIGHTS, 10000))
    return d.select(*rounded(["total_current_value", "total_predicted_value"], 2),
                    *rounded(["expected_return_pct", "portfolio_volatility_pct", "sharpe_ratio"]))


@query("x3_portfolio_covariance", using("bars_day", f"""SELECT {r('c', 2)} AS total_current_value, {r('v', 2)} AS total_predicted_value, {r('(v - c) / c * 100')} AS expected_return_pct,
  {r('s')} AS portfolio_volatility_pct, {r('CASE WHEN s > 0 THEN ((v - c) / c * 100 - 0.02) / s ELSE 0 END')} AS sharpe_ratio FROM (SELECT sum(inv) AS c, sum(predicted) AS v FROM positions),
  (SELECT coalesce(stddev_samp(j), 0) * sqrt(252) * 100 AS s FROM (SELECT ts, sum(w / 100 * ret) AS j FROM ret JOIN positions USING (ticker) WHERE ret IS NOT NULL GROUP BY ts HAVING count(*) = 4))""", RETURNS, _MOMENTS, _POS))
def x3_covariance(spark, sf):
    b = bars_day(spark, sf)
    d = X.portfolio_summary(X.portfolio(b, _WEIGHTS, 10000), X.joint_volatility(b, _WEIGHTS))
    return d.select(*rounded(["total_current_value", "total_predicted_value"], 2),
                    *rounded(["expected_return_pct", "portfolio_volatility_pct", "sharpe_ratio"]))


_DCA = ["""q AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY ts DESC) AS age, count(*) OVER (PARTITION BY ticker) AS n FROM bars_day)""",
        "tail AS (SELECT *, 364 - age AS i FROM q WHERE age <= 364 AND n >= 364)",
        "buys AS (SELECT ticker, ts, close AS price, 100.0 AS investment, 100.0 / close AS quantity FROM tail WHERE i % 7 = 0)"]


@query("x4_dca_purchases", using("bars_day", f"""SELECT ticker, {DAY}, CAST(row_number() {W} AS INTEGER) AS period, {r('price')} AS price, {r(f'sum(quantity) {W}', 6)} AS cumulative_quantity,
  {r(f'sum(investment) {W}', 2)} AS cumulative_investment FROM buys""", *_DCA))
def x4_buys(spark, sf):
    d = X.dca_purchases(bars_day(spark, sf), 100)
    return d.select("ticker", day(), "period", rnd("price").alias("price"), rnd("cumulative_quantity", 6).alias("cumulative_quantity"),
                    rnd("cumulative_investment", 2).alias("cumulative_investment"))


@query("x4_dca", using("bars_day", f"""SELECT ticker, purchases, {r('tq', 6)} AS total_quantity, {r('5200 / tq')} AS avg_purchase_price, {r('tq * z', 2)} AS final_value,
  {r('5200 / a * z', 2)} AS lump_sum_value, {r('(tq * z - 5200) / 52', 4)} AS roi_pct, CASE WHEN tq * z > 5200 / a * z THEN 'DCA' ELSE 'Lump Sum' END AS advantage
  FROM (SELECT ticker, count(*) AS purchases, sum(quantity) AS tq FROM buys GROUP BY ticker)
  JOIN (SELECT ticker, arg_max(close, ts) AS z, arg_min(close, ts) AS a FROM tail GROUP BY ticker) USING (ticker)""", *_DCA))
def x4(spark, sf):
    d = X.dca(bars_day(spark, sf), 100)
    return d.select("ticker", "purchases", rnd("total_quantity", 6).alias("total_quantity"), *rounded(["avg_purchase_price", "roi_pct"]),
                    *rounded(["final_value", "lump_sum_value"], 2), "advantage")


# predictions to score: the value before, and the mean of the five before
_PRED = [f"h AS (SELECT ticker, ts, close AS actual, lag(close) {W} AS last, CASE WHEN count(close) OVER p5 = 5 THEN avg(close) OVER p5 END AS mean5 FROM bars_day WINDOW p5 AS (PARTITION BY ticker ORDER BY ts ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING))",
         "joined AS (SELECT ticker, 'last' AS model, ts, actual, last AS predicted FROM h WHERE last IS NOT NULL UNION ALL SELECT ticker, 'mean5', ts, actual, mean5 FROM h WHERE mean5 IS NOT NULL)",
         "moved AS (SELECT *, actual - lag(actual) OVER m AS da, predicted - lag(predicted) OVER m AS dp FROM joined WINDOW m AS (PARTITION BY ticker, model ORDER BY ts))"]


def predictions(spark, sf):
    b = run_steps(bars_day(spark, sf), [S.lag_step("close", 1, "last"), S.sma_step("close", 5, "_m5")])
    b = run_steps(b, [S.lag_step("_m5", 1, "mean5")])
    return b.unpivot(["ticker", "ts"], ["last", "mean5"], "model", "predicted").where(F.col("predicted").isNotNull())


def joined(spark, sf):
    actual = bars_day(spark, sf).select("ticker", "ts", F.col("close").alias("actual"))
    return E.shared(actual, predictions(spark, sf))


@query("j4_actual_predicted", using("bars_day", f"SELECT ticker, model, {DAY}, {r('actual')} AS actual, {r('predicted')} AS predicted FROM joined", *_PRED))
def j4(spark, sf):
    return joined(spark, sf).select("ticker", "model", day(), rnd("actual").alias("actual"), rnd("predicted").alias("predicted"))


@query("a11_forecast_metrics", using("bars_day", f"""SELECT ticker, model, {r('sqrt(avg((actual - predicted) ** 2))')} AS rmse, {r('avg(abs(actual - predicted))')} AS mae,
  {r('avg(abs((actual - predicted) / actual)) * 100')} AS mape, {r('1 - sum((actual - predicted) ** 2) / (var_pop(actual) * count(*))')} AS r2,
  {r('avg(CASE WHEN da IS NOT NULL AND dp IS NOT NULL THEN CAST(sign(da) = sign(dp) AS INTEGER) END) * 100')} AS direction_accuracy FROM moved GROUP BY ticker, model""", *_PRED))
def a11(spark, sf):
    d = E.forecast_metrics(joined(spark, sf))
    return d.select("ticker", "model", *rounded(["rmse", "mae", "mape", "r2", "direction_accuracy"]))


@query("a12_forecast_error", using("bars_day", f"""SELECT ticker, model, {r('sqrt(avg((actual - predicted) ** 2))')} AS rmse, {r('avg(abs(actual - predicted))')} AS mae,
  {r('avg(abs((actual - predicted) / nullif(actual, 0))) * 100')} AS mape FROM joined GROUP BY ticker, model""", *_PRED))
def a12(spark, sf):
    return E.forecast_error(joined(spark, sf)).select("ticker", "model", *rounded(["rmse", "mae", "mape"]))


@query("a14_cv_summary", using("bars_day", f"""SELECT ticker, model, """ + ", ".join(
    f"{r(f'{f}({m})')} AS {n}_{m}" for m in ("rmse", "mae", "mape") for n, f in (("mean", "avg"), ("std", "stddev_pop"))) + """ FROM
  (SELECT ticker, model, year(ts) AS fold, sqrt(avg((actual - predicted) ** 2)) AS rmse, avg(abs(actual - predicted)) AS mae,
  avg(abs((actual - predicted) / actual)) * 100 AS mape FROM joined GROUP BY ALL) GROUP BY ticker, model""", *_PRED))
def a14(spark, sf):
    folds = E.forecast_error(joined(spark, sf).withColumn("fold", F.year("ts")), ["ticker", "model", "fold"])
    d = E.cv_summary(folds)
    return d.select("ticker", "model", *rounded([c for c in d.columns if c not in ("ticker", "model")]))


_PERF = """perf AS (SELECT *, CASE WHEN zeros > 0 THEN -1.0 WHEN log_growth <= 709 THEN CASE WHEN minus % 2 = 1 THEN -1.0 ELSE 1.0 END * exp(log_growth) - 1 END AS total_return
  FROM (SELECT ticker, count(*) AS trades, sum(CASE WHEN trade_return <> -1 THEN ln(abs(1 + trade_return)) END) AS log_growth,
  count(*) FILTER (trade_return = -1) AS zeros, count(*) FILTER (trade_return < -1) AS minus,
  CASE WHEN count(*) > 1 AND stddev_pop(trade_return) > 0 THEN avg(trade_return) / stddev_pop(trade_return) * sqrt(count(*)) END AS sharpe FROM round_trips GROUP BY ticker))"""
_GROWTH = f"{r('CASE WHEN abs(total_return) < 1e12 THEN total_return END', 6)} AS total_return, {r('log_growth', 6)} AS log_growth"


def _growth():
    """The return where decimals can hold it, and the logarithm of the growth, which they always can."""
    total = F.col("total_return")
    return rnd(F.when(F.abs(total) < 1e12, total), 6).alias("total_return"), rnd("log_growth", 6).alias("log_growth")


@query("a13_backtest_summary", using("bars_day", f"SELECT ticker, {_GROWTH}, trades, {r('sharpe')} AS sharpe FROM perf", *PAIRS, _PERF))
def a13(spark, sf):
    t = S.trade_pairs(S.threshold_signal(bars_day(spark, sf)))
    return S.backtest_summary(t).select("ticker", *_growth(), "trades", rnd("sharpe").alias("sharpe"))


@query("u3_history_forecast", using("bars_month", f"""SELECT ticker, {DAY}, {r('value')} AS value, kind FROM (
  SELECT ticker, ts, close AS value, 'history' AS kind FROM bars_month UNION ALL SELECT ticker, ts + INTERVAL 10 YEAR, close, 'forecast' FROM bars_month)"""))
def u3(spark, sf):
    b = bars_month(spark, sf)
    f = b.select("ticker", (F.col("ts") + F.expr("INTERVAL 10 YEAR")).alias("ts"), F.col("close").alias("forecast"))
    return G.with_history(b, f).select("ticker", day(), rnd("value").alias("value"), "kind")


@query("p18_signal_rows", using("bars_day", f"""SELECT s.ticker, 'naive' AS model, strftime(s.ts, '%Y-%m-%d') AS signal_day, s.signal AS signal_type, {r('coalesce(b.close, s.close)')} AS price,
  {r('s.close')} AS predicted_price, {r('s.ret * 100')} AS expected_profit, CAST(0.02 AS DOUBLE) AS threshold FROM
  (SELECT *, CASE WHEN ret > 0.02 THEN 'BUY' WHEN ret < -0.02 THEN 'SELL' ELSE 'HOLD' END AS signal FROM
    (SELECT *, close / lag(close) {W} - 1 AS ret FROM (SELECT ticker, ts, lag(close) {W} AS close FROM bars_day) WHERE close IS NOT NULL)) s
  LEFT JOIN (SELECT * FROM bars_day WHERE volume > 20) b ON b.ticker = s.ticker AND b.ts = s.ts"""))
def p18(spark, sf):
    b = bars_day(spark, sf)
    f = run_steps(b, [S.lag_step("close", 1, "forecast")]).select("ticker", "ts", "forecast").where(F.col("forecast").isNotNull())
    s = G.signal_rows(f, b.where("volume > 20"), "naive", 0.02)
    return s.select("ticker", "model", F.date_format("signal_date", "yyyy-MM-dd").alias("signal_day"), "signal_type",
                    *rounded(["price", "predicted_price", "expected_profit"]),
                    F.get_json_object("indicators", "$.threshold").cast("double").alias("threshold"))


_LAST50 = "l50 AS (SELECT ticker, ts, close FROM (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY ts DESC) AS age FROM bars_day) WHERE age <= 50)"
_REPORT = [
    _LAST50,
    f"d50 AS (SELECT *, close - lag(close) {W} AS dx, close / lag(close) {W} - 1 AS rt, row_number() {W} AS i, row_number() OVER (PARTITION BY ticker ORDER BY ts DESC) AS age FROM l50)",
    "rs AS (SELECT ticker, avg(greatest(dx, 0)) AS g, avg(-least(dx, 0)) AS l FROM d50 WHERE age <= 14 GROUP BY ticker)",
    f"em AS (SELECT ticker, i, close AS e12, close AS e26 FROM d50 WHERE i = 1 UNION ALL SELECT d.ticker, d.i, d.close * {2 / 13!r} + em.e12 * {1 - 2 / 13!r}, d.close * {2 / 27!r} + em.e26 * {1 - 2 / 27!r} FROM em JOIN d50 d ON d.ticker = em.ticker AND d.i = em.i + 1)",
    "md AS (SELECT ticker, arg_max(e12 - e26, i) AS macd FROM em GROUP BY ticker)",
    "base AS (SELECT ticker, arg_max(close, ts) AS price, stddev_samp(rt) AS vol, avg(close) FILTER (age <= 20) AS ma20 FROM d50 GROUP BY ticker)",
    RETURNS,
    "sg AS (SELECT ticker, arg_max(CASE WHEN ret > 0.01 THEN 'BUY' WHEN ret < -0.01 THEN 'SELL' ELSE 'HOLD' END, ts) AS signal FROM ret GROUP BY ticker)",
    """rep AS (SELECT *, CASE WHEN l > 0 THEN 100 - 100 / (1 + g / l) WHEN g > 0 THEN 100 ELSE 50 END AS rsi,
    CASE signal WHEN 'BUY' THEN 0.05 WHEN 'SELL' THEN -0.03 ELSE 0 END AS er, least(vol * 10, 1) AS risk FROM base JOIN rs USING (ticker) JOIN md USING (ticker) JOIN sg USING (ticker))""",
]


@query("m18_signal_report", using("bars_day", f"""SELECT ticker, signal AS current_signal, {r('price')} AS current_price, {r('rsi')} AS rsi, {r('macd')} AS macd, {r('ma20')} AS ma20,
  CASE WHEN price > ma20 THEN 'Bullish' ELSE 'Bearish' END AS ma_trend, {r("least(0.7 + CASE WHEN (signal = 'BUY' AND rsi < 30) OR (signal = 'SELL' AND rsi > 70) THEN 0.2 ELSE 0 END, 1)")} AS confidence,
  {r('price * (1 + er)')} AS target_price, {r("CASE WHEN signal = 'BUY' THEN price * 0.95 ELSE price * 1.05 END")} AS stop_loss, {r('risk')} AS risk_score,
  CASE WHEN risk > 0.7 THEN 'High' WHEN risk > 0.4 THEN 'Medium' ELSE 'Low' END AS risk_level FROM rep""", *_REPORT, recursive=True))
def m18(spark, sf):
    b = bars_day(spark, sf)
    f = b.select("ticker", "ts", F.col("close").alias("forecast"))
    return G.signal_report(b, f).select(
        "ticker", "current_signal", *rounded(["current_price", "rsi", "macd", "ma20", "confidence", "target_price", "stop_loss", "risk_score"]),
        "ma_trend", "risk_level")


@query("m18_report_history", using("bars_day", f"SELECT ticker, {DAY}, {r('close')} AS close FROM (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY ts DESC) AS age FROM bars_day) WHERE age <= 60"))
def m18_history(spark, sf):
    return G.report_history(bars_day(spark, sf), 30).select("ticker", day(), rnd("close").alias("close"))


_AT5 = [p.replace("0.01", "0.05") for p in PAIRS]


@query("m18_signal_pnl", using("bars_day", f"""SELECT ticker, strftime(entry_ts, '%Y-%m-%d') AS entry_day, strftime(exit_ts, '%Y-%m-%d') AS exit_day,
  {r('pnl')} AS pnl, {r('trade_return', 6)} AS trade_return FROM round_trips""", *_AT5))
def m18_pnl(spark, sf):
    b = bars_day(spark, sf)
    t = G.signal_pnl(b, b.select("ticker", "ts", F.col("close").alias("forecast")), 0.05)
    return t.select("ticker", F.date_format("entry_ts", "yyyy-MM-dd").alias("entry_day"), F.date_format("exit_ts", "yyyy-MM-dd").alias("exit_day"),
                    rnd("pnl").alias("pnl"), rnd("trade_return", 6).alias("trade_return"))


@query("m19_backtest_report", using("bars_day", f"SELECT ticker, {_GROWTH}, trades, {r('sharpe')} AS sharpe FROM perf", *_AT5, _PERF))
def m19(spark, sf):
    b = bars_day(spark, sf)
    f = b.select("ticker", "ts", F.col("close").alias("forecast"))
    return G.backtest_report(b, f, 0.05).select("ticker", *_growth(), "trades", rnd("sharpe").alias("sharpe"))


_SERIES = [RETURNS, SIGNALS.replace("0.01", "0.05"), *_MACD, _DELTA, _GAIN]


@query("m19_backtest_series", using("bars_month", f"""SELECT v.ticker, strftime(v.ts, '%Y-%m-%d') AS d, {r('signals.close')} AS price, signal,
  {r('CASE WHEN k = 14 THEN CASE WHEN l > 0 THEN 100 - 100 / (1 + g / l) WHEN g > 0 THEN 100 END END')} AS rsi, {r('macd')} AS macd, {r('s')} AS signal_line
  FROM gain v JOIN signals USING (ticker, ts) JOIN sig USING (ticker, ts)""", *[c.replace("bars_day", "bars_month") for c in _SERIES], recursive=True))
def m19_series(spark, sf):
    b = bars_month(spark, sf)
    d = G.backtest_series(b, b.select("ticker", "ts", F.col("close").alias("forecast")), 0.05, every="1mo")
    return d.select("ticker", day(), rnd("close").alias("price"), "signal", *rounded(["rsi", "macd", "signal_line"]))
