"""Ordered-series queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickloom.operators import series as S
from tickloom.plans.registry import DAY, day, query, r, rnd
from tickloom.plans.views import bars_day, bars_month, gappy, ticks, using

W = "OVER (PARTITION BY ticker ORDER BY ts)"


def over(n: int) -> str:
    return f"OVER (PARTITION BY ticker ORDER BY ts ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


RETURNS = f"ret AS (SELECT *, close / lag(close) {W} - 1 AS ret FROM bars_day)"


@query("w1_pct_change", using("bars_day", f"SELECT ticker, {DAY}, {r('ret', 6)} AS ret FROM ret", RETURNS))
def w1(spark, sf):
    return S.pct_change(bars_day(spark, sf)).select("ticker", day(), rnd("ret", 6).alias("ret"))


@query("w2_diff", using("bars_day", f"SELECT ticker, {DAY}, {r(f'close - lag(close) {W}')} AS diff FROM bars_day"))
def w2(spark, sf):
    return S.diff(bars_day(spark, sf)).select("ticker", day(), rnd("diff").alias("diff"))


def _sma_sql(c: str, n: int) -> str:
    return f"{r(f'CASE WHEN count({c}) {over(n)} = {n} THEN avg({c}) {over(n)} END')} AS {c}_sma_{n}"


_SMA = {"open": [7], "high": [7], "low": [7], "volume": [7], "close": [7, 20, 50, 200]}


@query("w3_sma", using("bars_day", f"SELECT ticker, {DAY}, " + ", ".join(
    _sma_sql(c, n) for c, ns in _SMA.items() for n in ns) + " FROM bars_day"))
def w3(spark, sf):
    return S.sma(bars_day(spark, sf), _SMA).select(
        "ticker", day(), *[rnd(f"{c}_sma_{n}").alias(f"{c}_sma_{n}") for c, ns in _SMA.items() for n in ns])


@query("w4_rolling_vol", using("bars_day", f"""SELECT ticker, {DAY},
  {r(f'CASE WHEN count(ret) {over(14)} = 14 THEN stddev_samp(ret) {over(14)} END', 6)} AS vol_14,
  {r(f'CASE WHEN count(ret) {over(20)} = 20 THEN stddev_samp(ret) {over(20)} * sqrt(252) * 100 END')} AS vol_20
  FROM ret""", RETURNS))
def w4(spark, sf):
    steps = [S.rolling_vol_step("close", 14, out="vol_14"),
             S.rolling_vol_step("close", 20, periods=252, percent=True, out="vol_20")]
    return S.run_steps(bars_day(spark, sf), steps).select(
        "ticker", day(), rnd("vol_14", 6).alias("vol_14"), rnd("vol_20").alias("vol_20"))


@query("w5_rolling_vol_pop", using("bars_day", f"""SELECT ticker, {DAY},
  {r(f'CASE WHEN count(ret) {over(20)} = 20 THEN stddev_pop(ret) {over(20)} * sqrt(252) * 100 END', 2)} AS vol
  FROM ret""", RETURNS))
def w5(spark, sf):
    return S.rolling_vol(bars_day(spark, sf), n=20, population=True, periods=252, percent=True).select(
        "ticker", day(), rnd("vol", 2).alias("vol"))


_DELTA = f"delta AS (SELECT *, close - lag(close) {W} AS dx FROM bars_day)"
_GAIN = f"""gain AS (SELECT ticker, ts, count(dx) {over(14)} AS k,
  avg(CASE WHEN dx > 0 THEN dx WHEN dx IS NOT NULL THEN 0 END) {over(14)} AS g,
  avg(CASE WHEN dx < 0 THEN -dx WHEN dx IS NOT NULL THEN 0 END) {over(14)} AS l FROM delta)"""


@query("w6_rsi", using("bars_day", f"""SELECT ticker, {DAY}, {r('''CASE WHEN k < 14 THEN NULL WHEN l = 0 AND g = 0
  THEN NULL WHEN l = 0 THEN 100 ELSE 100 - 100 / (1 + g / l) END''')} AS rsi FROM gain""", _DELTA, _GAIN))
def w6(spark, sf):
    return S.rsi(bars_day(spark, sf)).select("ticker", day(), rnd("rsi").alias("rsi"))


@query("w7_rsi_ui", using("bars_day", f"""SELECT ticker, {DAY}, {r('''CASE WHEN l = 0 THEN 100 - 100 / 101.0
  ELSE 100 - 100 / (1 + g / l) END''')} AS rsi FROM gain WHERE k = 14""", _DELTA, _GAIN))
def w7(spark, sf):
    return (S.rsi(bars_day(spark, sf), zero_loss="cap").where(F.col("rsi").isNotNull())
            .select("ticker", day(), rnd("rsi").alias("rsi")))


def _ema_ctes(spans: dict[str, int], source: str = "bars_day") -> list[str]:
    first = ", ".join(f"close AS {n}" for n in spans)
    nxt = ", ".join(f"b.close * {2 / (s + 1)!r} + e.{n} * {1 - 2 / (s + 1)!r}" for n, s in spans.items())
    return [
        f"numbered AS (SELECT ticker, ts, close, row_number() {W} AS i FROM {source})",
        f"""ema AS (SELECT ticker, ts, i, {first} FROM numbered WHERE i = 1 UNION ALL
        SELECT b.ticker, b.ts, b.i, {nxt} FROM ema e JOIN numbered b ON b.ticker = e.ticker AND b.i = e.i + 1)""",
    ]


@query("w8_ema", using("bars_day", f"SELECT ticker, {DAY}, {r('e12')} AS ema_12, {r('e26')} AS ema_26 FROM ema",
                       *_ema_ctes({"e12": 12, "e26": 26}), recursive=True))
def w8(spark, sf):
    d = S.run_steps(bars_day(spark, sf), [S.ema_step("close", 12), S.ema_step("close", 26)])
    return d.select("ticker", day(), rnd("ema_12").alias("ema_12"), rnd("ema_26").alias("ema_26"))


_MACD = [
    *_ema_ctes({"e12": 12, "e26": 26}),
    "line AS (SELECT ticker, ts, i, e12 - e26 AS macd FROM ema)",
    """sig AS (SELECT ticker, ts, i, macd, macd AS s FROM line WHERE i = 1 UNION ALL
    SELECT l.ticker, l.ts, l.i, l.macd, l.macd * 0.2 + g.s * 0.8 FROM sig g
    JOIN line l ON l.ticker = g.ticker AND l.i = g.i + 1)""",
]


@query("w9_macd", using("bars_day", f"""SELECT ticker, {DAY}, {r('macd')} AS macd, {r('s')} AS signal_line,
  {r('macd - s')} AS hist FROM sig""", *_MACD, recursive=True))
def w9(spark, sf):
    return S.macd(bars_day(spark, sf)).select(
        "ticker", day(), rnd("macd").alias("macd"), rnd("signal_line").alias("signal_line"),
        rnd("hist").alias("hist"))


@query("w10_macd_ui", using("bars_day", f"""SELECT ticker, {DAY}, {r('macd')} AS macd,
  {r('CASE WHEN i >= 34 THEN s END')} AS signal_line FROM sig WHERE i >= 26""", *_MACD, recursive=True))
def w10(spark, sf):
    return (S.macd(bars_day(spark, sf), warm_up=True).where(F.col("macd").isNotNull())
            .select("ticker", day(), rnd("macd").alias("macd"), rnd("signal_line").alias("signal_line")))


def _gap_ema(spans: dict[str, int], source: str, value: str, to: str) -> list[str]:
    """Exponential averages with missing values: a known value after g rows weighs a / (keep^g + a)."""
    def nxt(n: str, span: int) -> str:
        a, w = repr(2 / (span + 1)), f"pow({1 - 2 / (span + 1)!r}, e.gap + 1)"
        return f"CASE WHEN b.{value} IS NULL THEN e.{n} WHEN e.{n} IS NULL THEN b.{value} ELSE ({w} * e.{n} + {a} * b.{value}) / ({w} + {a}) END"
    first = ", ".join(f"{value} AS {n}" for n in spans)
    steps = ", ".join(nxt(n, k) for n, k in spans.items())
    return [f"""{to} AS (SELECT ticker, ts, i, {first}, 0 AS gap FROM {source} WHERE i = 1 UNION ALL
        SELECT b.ticker, b.ts, b.i, {steps}, CASE WHEN b.{value} IS NULL THEN e.gap + 1 ELSE 0 END
        FROM {to} e JOIN {source} b ON b.ticker = e.ticker AND b.i = e.i + 1)"""]


_GAPS = [f"holes AS (SELECT ticker, ts, close, row_number() {W} AS i FROM gappy)",
         *_gap_ema({"e12": 12, "e26": 26}, "holes", "close", "gema")]


@query("w8_ema_gaps", using("gappy", f"SELECT ticker, {DAY}, {r('e12')} AS ema_12, {r('e26')} AS ema_26 FROM gema", *_GAPS, recursive=True))
def w8_gaps(spark, sf):
    d = S.run_steps(gappy(spark, sf), [S.ema_step("close", 12), S.ema_step("close", 26)])
    return d.select("ticker", day(), rnd("ema_12").alias("ema_12"), rnd("ema_26").alias("ema_26"))


@query("w9_macd_gaps", using("gappy", f"""SELECT ticker, {DAY}, {r('macd')} AS macd, {r('s')} AS signal_line, {r('macd - s')} AS hist
  FROM gsig JOIN gline USING (ticker, ts)""", *_GAPS, "gline AS (SELECT ticker, ts, i, e12 - e26 AS macd FROM gema)",
  *_gap_ema({"s": 9}, "gline", "macd", "gsig"), recursive=True))
def w9_gaps(spark, sf):
    return S.macd(gappy(spark, sf)).select(
        "ticker", day(), rnd("macd").alias("macd"), rnd("signal_line").alias("signal_line"), rnd("hist").alias("hist"))


_LAGS = ", ".join(f"{r(f'l{i}')} AS lag_{i}" for i in range(1, 6))


@query("w11_lag_features", using("bars_day", f"SELECT ticker, {DAY}, {r('close')} AS close, {_LAGS} FROM lagged WHERE l5 IS NOT NULL",
       "lagged AS (SELECT ticker, ts, close, " + ", ".join(f"lag(close, {i}) {W} AS l{i}" for i in range(1, 6)) + " FROM bars_day)"))
def w11(spark, sf):
    return S.lag_features(bars_day(spark, sf), "close", 5).select(
        "ticker", day(), *[rnd(c).alias(c) for c in ["close", "lag_1", "lag_2", "lag_3", "lag_4", "lag_5"]])


SIGNALS = "signals AS (SELECT *, CASE WHEN ret > 0.01 THEN 'BUY' WHEN ret < -0.01 THEN 'SELL' ELSE 'HOLD' END AS signal FROM ret)"


@query("w12_threshold_signal", using("bars_day", f"SELECT ticker, {DAY}, {r('ret', 6)} AS pct_change, signal FROM signals",
                                     RETURNS, SIGNALS))
def w12(spark, sf):
    return S.threshold_signal(bars_day(spark, sf)).select(
        "ticker", day(), rnd("pct_change", 6).alias("pct_change"), "signal")


PAIRS = [
    RETURNS, SIGNALS,
    f"acts AS (SELECT ticker, ts, close, signal, lag(signal) {W} AS prev FROM signals WHERE signal <> 'HOLD')",
    """turns AS (SELECT * FROM acts WHERE (signal = 'BUY' AND (prev IS NULL OR prev = 'SELL'))
    OR (signal = 'SELL' AND prev = 'BUY'))""",
    f"paired AS (SELECT ticker, ts, signal, close AS exit_price, lag(close) {W} AS entry_price, lag(ts) {W} AS entry_ts FROM turns)",
    """round_trips AS (SELECT ticker, entry_ts, ts AS exit_ts, entry_price, exit_price, exit_price - entry_price AS pnl,
    (exit_price - entry_price) / entry_price AS trade_return FROM paired WHERE signal = 'SELL')""",
]


@query("w13_trade_pairs", using("bars_day", f"""SELECT ticker, strftime(entry_ts, '%Y-%m-%d') AS entry_day,
  strftime(exit_ts, '%Y-%m-%d') AS exit_day, {r('entry_price')} AS entry_price, {r('exit_price')} AS exit_price
  FROM round_trips""", *PAIRS))
def w13(spark, sf):
    t = S.trade_pairs(S.threshold_signal(bars_day(spark, sf)))
    return t.select("ticker", F.date_format("entry_ts", "yyyy-MM-dd").alias("entry_day"),
                    F.date_format("exit_ts", "yyyy-MM-dd").alias("exit_day"),
                    rnd("entry_price").alias("entry_price"), rnd("exit_price").alias("exit_price"))


@query("w14_trade_return", using("bars_day", f"""SELECT ticker, strftime(exit_ts, '%Y-%m-%d') AS exit_day, {r('pnl')} AS pnl,
  {r('trade_return', 6)} AS trade_return FROM round_trips""", *PAIRS))
def w14(spark, sf):
    t = S.trade_pairs(S.threshold_signal(bars_day(spark, sf)))
    return t.select("ticker", F.date_format("exit_ts", "yyyy-MM-dd").alias("exit_day"),
                    rnd("pnl").alias("pnl"), rnd("trade_return", 6).alias("trade_return"))


@query("w15_train_test_split", using("bars_day", f"""SELECT ticker, {DAY},
  CASE WHEN i <= floor(n * 0.8) THEN 'train' ELSE 'test' END AS part FROM p""",
  f"p AS (SELECT ticker, ts, row_number() {W} AS i, count(*) OVER (PARTITION BY ticker) AS n FROM bars_day)"))
def w15(spark, sf):
    return S.train_test_split(bars_day(spark, sf), 0.2).select("ticker", day(), "part")


@query("w16_ts_folds", using("bars_day", """SELECT ticker, fold, part, count(*) AS bars,
  strftime(min(ts), '%Y-%m-%d') AS first_day, strftime(max(ts), '%Y-%m-%d') AS last_day
  FROM (SELECT *, CASE WHEN i < n - (5 - fold) * size THEN 'train' ELSE 'test' END AS part FROM f
  WHERE i < n - (5 - fold) * size + size) GROUP BY ALL""",
  f"p AS (SELECT ticker, ts, row_number() {W} - 1 AS i, count(*) OVER (PARTITION BY ticker) AS n FROM bars_day)",
  "f AS (SELECT p.*, n // 6 AS size, CAST(fold AS INTEGER) AS fold FROM p, range(0, 5) t(fold))"))
def w16(spark, sf):
    return S.ts_folds(bars_day(spark, sf), 5).groupBy("ticker", "fold", "part").agg(
        F.count(F.lit(1)).alias("bars"), F.date_format(F.min("ts"), "yyyy-MM-dd").alias("first_day"),
        F.date_format(F.max("ts"), "yyyy-MM-dd").alias("last_day"))


@query("w17_ma_trend", using("bars_day", f"""SELECT ticker, {r('last')} AS last, {r('ma')} AS ma,
  CASE WHEN last > ma THEN 'Bullish' ELSE 'Bearish' END AS trend FROM m""",
  f"""q AS (SELECT ticker, ts, close, row_number() OVER (PARTITION BY ticker ORDER BY ts DESC) AS age FROM bars_day)""",
  """m AS (SELECT ticker, arg_max(close, ts) AS last,
  CASE WHEN count(*) >= 20 THEN avg(close) ELSE arg_max(close, ts) END AS ma FROM q WHERE age <= 20 GROUP BY ticker)"""))
def w17(spark, sf):
    return S.ma_trend(bars_day(spark, sf)).select("ticker", rnd("last").alias("last"), rnd("ma").alias("ma"), "trend")


@query("w18_cumulative", using("bars_day", f"""SELECT ticker, {DAY}, {r(f'sum(volume) {W}', 2)} AS cum_volume,
  {r(f'sum(volume * close) {W}', 2)} AS cum_spent FROM bars_day"""))
def w18(spark, sf):
    b = bars_day(spark, sf).withColumn("spent", F.col("volume") * F.col("close"))
    return S.cumulative(b, {"cum_volume": "volume", "cum_spent": "spent"}).select(
        "ticker", day(), rnd("cum_volume", 2).alias("cum_volume"), rnd("cum_spent", 2).alias("cum_spent"))


@query("w18_cumulative_ticks", using("ticks", f"""SELECT ticker, epoch_us(ts) AS moment, CAST(sum(cents) {W} AS BIGINT) AS cum_cents FROM
  (SELECT ticker, ts, sum(CAST(coalesce(round(price * 100), 0) AS BIGINT)) AS cents FROM ticks
  WHERE ticker IS NOT NULL AND ts IS NOT NULL GROUP BY ticker, ts)"""))
def w18_ticks(spark, sf):
    """Ticks have no interval, so their chunks are cut by measured counts."""
    cents = F.coalesce(F.round(F.col("price") * 100), F.lit(0)).cast("long")
    moments = ticks(spark, sf).groupBy("ticker", "ts").agg(F.sum(cents).alias("cents"))
    return S.cumulative(moments, {"cum_cents": "cents"}, every=None).select(
        "ticker", F.unix_micros(F.col("ts").cast("timestamp")).alias("moment"), "cum_cents")


@query("p15_downsample", using("bars_day", f"""SELECT ticker, {DAY}, {r('volume', 2)} AS volume FROM p
  WHERE n <= 100 OR i % CAST(ceil(n / 100.0) AS BIGINT) = 0""",
  f"p AS (SELECT ticker, ts, volume, row_number() {W} - 1 AS i, count(*) OVER (PARTITION BY ticker) AS n FROM bars_day)"))
def p15(spark, sf):
    return S.downsample(bars_day(spark, sf), 100).select("ticker", day(), rnd("volume", 2).alias("volume"))


def flagship(spark, sf):
    """Monthly bars with a moving average and the relative strength index, per ticker."""
    steps = [S.sma_step("close", 7, "sma_7"), S.rsi_step("close", 14), S.pct_change_step("close")]
    return S.run_steps(bars_month(spark, sf), steps, every="1mo").select(
        "ticker", day(), *[rnd(c).alias(c) for c in ["open", "high", "low", "close", "volume", "sma_7", "rsi", "ret"]])


query("bars_indicators", using("bars_month", f"""SELECT ticker, {DAY}, {r('open')} AS open, {r('high')} AS high, {r('low')} AS low,
  {r('close')} AS close, {r('volume')} AS volume,
  {r(f'CASE WHEN count(close) {over(7)} = 7 THEN avg(close) {over(7)} END')} AS sma_7,
  {r(f'''CASE WHEN count(dx) {over(14)} = 14 THEN CASE WHEN l > 0 THEN 100 - 100 / (1 + g / l) WHEN g > 0 THEN 100 END END''')} AS rsi,
  {r('ret')} AS ret
  FROM (SELECT *, avg(greatest(dx, 0)) {over(14)} AS g, avg(-least(dx, 0)) {over(14)} AS l FROM
  (SELECT *, close - lag(close) {W} AS dx, close / lag(close) {W} - 1 AS ret FROM bars_month))"""))(flagship)
