"""Indicators over ordered series.

Each ``*_step`` adds columns and can be combined with others in one ``run_steps`` call, so a whole
indicator set costs one exchange. The functions at the end are the operators built on them.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.operators.core import (
    Keys, Piece, Step, carry_last, key_list, latest_n, number_rows, run_steps, running_sum,
)

FORGET = 41.0    # -ln of the weight (1e-18) at which an exponential average has forgotten a value
SEGMENT = 200.0  # -ln of the decay after which a new summing segment begins
JUMP = 230.0     # -ln of the weight (1e-100) below which a value does not count any more


def _full(value: Column, col: Column, p: Piece, n: int) -> Column:
    """``value`` only where the frame holds ``n`` known inputs."""
    return F.when(F.count(col).over(p.last_rows(n)) == n, value)


# --- steps -------------------------------------------------------------------------------------

def lag_step(col: str, n: int = 1, out: str | None = None) -> Step:
    name = out or f"lag_{n}"
    return Step(n, lambda d, p: d.withColumn(name, F.lag(col, n).over(p.order)))


def lags_step(col: str, n: int) -> Step:
    def apply(d: DataFrame, p: Piece) -> DataFrame:
        return d.withColumns({f"lag_{i}": F.lag(col, i).over(p.order) for i in range(1, n + 1)})
    return Step(n, apply)


def diff_step(col: str, out: str = "diff") -> Step:
    return Step(1, lambda d, p: d.withColumn(out, F.col(col) - F.lag(col).over(p.order)))


def pct_change_step(col: str, out: str = "ret") -> Step:
    def apply(d: DataFrame, p: Piece) -> DataFrame:
        prev = F.lag(col).over(p.order)
        return d.withColumn(out, F.when(prev != 0, F.col(col) / prev - 1))
    return Step(1, apply)


def sma_step(col: str, n: int, out: str | None = None) -> Step:
    c = F.col(col)
    return Step(n - 1, lambda d, p: d.withColumn(
        out or f"sma_{n}", _full(F.avg(c).over(p.last_rows(n)), c, p, n)))


def rolling_vol_step(col: str, n: int, population: bool = False, periods: int | None = None,
                     percent: bool = False, out: str = "vol") -> Step:
    """Deviation of the last ``n`` returns; ``periods`` annualises it."""
    scale = (math.sqrt(periods) if periods else 1.0) * (100.0 if percent else 1.0)
    dev = F.stddev_pop if population else F.stddev_samp

    def apply(d: DataFrame, p: Piece) -> DataFrame:
        d = pct_change_step(col, "_ret").apply(d, p)
        r = F.col("_ret")
        return d.withColumn(out, _full(dev(r).over(p.last_rows(n)) * scale, r, p, n)).drop("_ret")
    return Step(n, apply)


def rsi_step(col: str, n: int = 14, out: str = "rsi", zero_loss: str = "limit") -> Step:
    """Relative strength from plain means of the last ``n`` gains and losses.

    Without losses the index is 100, or null when there are no gains either; with
    ``zero_loss='cap'`` the ratio is taken as 100 in both cases.
    """
    def apply(d: DataFrame, p: Piece) -> DataFrame:
        d = diff_step(col, "_d").apply(d, p)
        change, frame = F.col("_d"), p.last_rows(n)
        gains = F.avg(F.when(change.isNotNull(), F.greatest(change, F.lit(0.0)))).over(frame)
        losses = F.avg(F.when(change.isNotNull(), -F.least(change, F.lit(0.0)))).over(frame)
        d = d.withColumns({"_g": _full(gains, change, p, n), "_l": _full(losses, change, p, n)})
        g, l = F.col("_g"), F.col("_l")
        value = 100 - 100 / (1 + g / F.when(l != 0, l))
        if zero_loss == "cap":
            value = F.when(l == 0, F.lit(100 - 100 / 101)).otherwise(value)
        else:
            value = F.when((l == 0) & (g > 0), F.lit(100.0)).otherwise(value)
        return d.withColumn(out, value).drop("_d", "_g", "_l")
    return Step(n, apply)


def _keep(span: int) -> float:
    return 1 - 2 / (span + 1)


def _step_decay(keep: float, gap: int) -> float:
    """-ln of the weight that the average before keeps when a known value follows ``gap`` rows later."""
    w = keep ** gap
    return -math.log(w / (w + 1 - keep)) if w > 0 else JUMP


def ema_memory(span: int) -> int:
    """Rows after which an older value has lost its weight, whatever the gaps between known values."""
    keep = _keep(span)
    if keep <= 0:
        return 1
    return max(math.ceil(FORGET / _step_decay(keep, gap)) * gap for gap in range(1, 2 + math.ceil(FORGET / -math.log(keep))))


def ema_step(col: str, span: int, out: str | None = None) -> Step:
    """Exponential average over the known values, started at the first one.

    A value ``g`` rows after the known one before gets the share a / (keep^g + a) with a = 1 - keep, so missing
    rows age the average and leave no hole in its weights; on rows without a value the average stays, for as long as
    it is remembered. The average is the sum of share * value * decay since then, built in segments whose decay
    stays in the range of doubles; the end of the segment before is added with its decay.
    """
    name = out or f"ema_{span}"
    keep, memory = _keep(span), ema_memory(span)
    if keep <= 0:
        return Step(0, lambda d, p: d.withColumn(name, F.col(col)))

    def apply(d: DataFrame, p: Piece) -> DataFrame:
        x, upto = F.col(col), p.order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        known = F.when(x.isNotNull(), F.col("_j"))
        d = d.withColumn("_j", F.row_number().over(p.order))
        d = d.withColumns({"_g": F.col("_j") - F.last(known, ignorenulls=True).over(p.before()),
                           "_age": F.col("_j") - F.last(known, ignorenulls=True).over(upto)})
        weight = F.pow(F.lit(keep), F.col("_g"))
        share = F.when(F.col("_g").isNull(), 1.0).when(F.col("_g") == 1, 1 - keep).otherwise((1 - keep) / (weight + (1 - keep)))
        decay = F.when(weight < 1e-99, JUMP).otherwise(-F.log(weight / (weight + (1 - keep))))
        follows = x.isNotNull() & F.col("_g").isNotNull()
        # single steps decay by ``keep`` each and are counted, so that only gaps are sums of logarithms
        d = d.withColumns({
            "_x": x * share, "_m": F.sum(F.when(follows & (F.col("_g") == 1), 1).otherwise(0)).over(upto),
            "_c": F.sum(F.when(follows & (F.col("_g") > 1), decay).otherwise(0.0)).over(upto)})
        d = d.withColumn("_q", F.floor((F.col("_m") * -math.log(keep) + F.col("_c")) / SEGMENT))
        d = d.withColumns({"_dm": F.col("_m") - F.first("_m").over(p.within("_q")), "_dc": F.col("_c") - F.first("_c").over(p.within("_q"))})

        def kept(steps: Column, log: Column) -> Column:
            return F.pow(F.lit(keep), steps) * F.exp(-log)

        d = d.withColumn("_e", F.sum(F.col("_x") / kept(F.col("_dm"), F.col("_dc"))).over(p.within("_q")) * kept(F.col("_dm"), F.col("_dc")))
        ended = F.when(F.lead("_q").over(p.order) != F.col("_q"), F.struct(F.col("_e").alias("e"), "_m", "_c"))
        d = d.withColumn("_end", ended).withColumn("_z", F.last("_end", ignorenulls=True).over(p.before()))
        before = F.coalesce(F.col("_z.e") * kept(F.col("_m") - F.col("_z._m"), F.col("_c") - F.col("_z._c")), F.lit(0.0))
        return d.withColumn(name, F.when(F.col("_age") <= memory, F.col("_e") + before)).drop(
            "_j", "_g", "_age", "_x", "_m", "_c", "_q", "_dm", "_dc", "_e", "_end", "_z")
    return Step(memory, apply)


def macd_step(col: str, fast: int = 12, slow: int = 26, signal: int = 9) -> Step:
    """``macd`` = fast - slow average, ``signal_line`` = average of it, ``hist`` = their difference."""
    def apply(d: DataFrame, p: Piece) -> DataFrame:
        d = ema_step(col, fast, "_fast").apply(d, p)
        d = ema_step(col, slow, "_slow").apply(d, p)
        d = d.withColumn("macd", F.col("_fast") - F.col("_slow")).drop("_fast", "_slow")
        d = ema_step("macd", signal, "signal_line").apply(d, p)
        return d.withColumn("hist", F.col("macd") - F.col("signal_line"))
    return Step(max(ema_memory(fast), ema_memory(slow)) + ema_memory(signal), apply)


def signal_of(change: Column, threshold: float) -> Column:
    return (F.when(change > threshold, "BUY").when(change < -threshold, "SELL").otherwise("HOLD"))


# --- operators ---------------------------------------------------------------------------------

def pct_change(df: DataFrame, col: str = "close", out: str = "ret", **key) -> DataFrame:
    return run_steps(df, [pct_change_step(col, out)], **key)


def diff(df: DataFrame, col: str = "close", out: str = "diff", **key) -> DataFrame:
    return run_steps(df, [diff_step(col, out)], **key)


def sma(df: DataFrame, windows: dict[str, list[int]], **key) -> DataFrame:
    """Plain moving averages: ``{"close": [7, 20]}`` adds ``close_sma_7`` and ``close_sma_20``."""
    return run_steps(df, [
        sma_step(c, n, f"{c}_sma_{n}") for c, ns in windows.items() for n in ns], **key)


def rolling_vol(df: DataFrame, col: str = "close", n: int = 20, population: bool = False,
                periods: int | None = None, percent: bool = False, out: str = "vol", **key) -> DataFrame:
    return run_steps(df, [rolling_vol_step(col, n, population, periods, percent, out)], **key)


def rsi(df: DataFrame, col: str = "close", n: int = 14, zero_loss: str = "limit", **key) -> DataFrame:
    return run_steps(df, [rsi_step(col, n, "rsi", zero_loss)], **key)


def ema(df: DataFrame, col: str = "close", span: int = 12, **key) -> DataFrame:
    return run_steps(df, [ema_step(col, span)], **key)


def macd(df: DataFrame, col: str = "close", fast: int = 12, slow: int = 26, signal: int = 9,
         warm_up: bool = False, **key) -> DataFrame:
    """With ``warm_up`` the first slow-1 (line) and slow+signal-2 (signal, hist) rows are null."""
    step = macd_step(col, fast, slow, signal)
    if not warm_up:
        return run_steps(df, [step], **key)
    d = run_steps(df, [step], positions=True, **key)
    settled = F.col("_i") >= slow + signal - 2
    return d.withColumns({
        "macd": F.when(F.col("_i") >= slow - 1, F.col("macd")),
        "signal_line": F.when(settled, F.col("signal_line")),
        "hist": F.when(settled, F.col("hist")),
    }).drop("_i", "_n")


def lag_features(df: DataFrame, col: str = "close", n: int = 5, **key) -> DataFrame:
    """``lag_1 .. lag_n``; rows without all of them are dropped."""
    names = [f"lag_{i}" for i in range(1, n + 1)]
    return run_steps(df, [lags_step(col, n)], **key).na.drop(subset=[col, *names])


def threshold_signal(df: DataFrame, col: str = "close", threshold: float = 0.01, **key) -> DataFrame:
    """``pct_change`` and ``signal``: BUY above the threshold, SELL below minus it, else HOLD."""
    d = pct_change(df, col, "pct_change", **key)
    return d.withColumn("signal", signal_of(F.col("pct_change"), threshold))


def trade_pairs(df: DataFrame, price: str = "close", by: Keys = "ticker", ts: str = "ts",
                every: str = "1d") -> DataFrame:
    """Long-only round trips: enter at the first BUY while flat, leave at the next SELL.

    Without the HOLD rows, an entry is a BUY after nothing or a SELL and an exit is a SELL after a
    BUY, so the latest entry before an exit is the one it closes.
    """
    keys = key_list(by)
    acts = df.where(F.col("signal").isin("BUY", "SELL")).select(
        *keys, ts, "signal", F.col(price).alias("_price"))
    acts = carry_last(acts, {"_prev": F.col("signal")}, keys, ts, every, strict=True)
    turns = acts.where(
        F.when(F.col("signal") == "BUY", F.coalesce(F.col("_prev") == "SELL", F.lit(True)))
        .otherwise(F.coalesce(F.col("_prev") == "BUY", F.lit(False))))
    entry = F.when(F.col("signal") == "BUY", F.struct(F.col(ts).alias("ts"), "_price"))
    paired = carry_last(turns, {"_entry": entry}, keys, ts, every).withColumns(
        {"entry_ts": F.col("_entry.ts"), "entry_price": F.col("_entry._price")})
    return paired.where(F.col("signal") == "SELL").select(
        *keys, "entry_ts", F.col(ts).alias("exit_ts"), "entry_price",
        F.col("_price").alias("exit_price"),
    ).withColumns({
        "pnl": F.col("exit_price") - F.col("entry_price"),
        "trade_return": (F.col("exit_price") - F.col("entry_price"))
        / F.when(F.col("entry_price") != 0, F.col("entry_price")),
    })


def backtest_summary(trades: DataFrame, by: Keys = "ticker") -> DataFrame:
    """Compound return, number of trades and mean/deviation * sqrt(n) (null below two trades).

    ``log_growth`` is the logarithm of the size of the compounded factor. The product itself is built from it
    and from the sign of its factors, so no partial product leaves the range of doubles; ``total_return`` is null,
    and ``out_of_range`` true, where the result itself does. A factor of 0 loses everything, for good.
    """
    r = F.col("trade_return")
    factor = 1 + r
    n, dev = F.count(F.lit(1)), F.stddev_pop(r)
    d = trades.groupBy(*key_list(by)).agg(
        F.sum(F.when(factor != 0, F.log(F.abs(factor)))).alias("log_growth"),
        F.count_if(factor == 0).alias("_zero"), F.count_if(factor < 0).alias("_minus"), F.count(r).alias("_k"),
        n.alias("trades"), F.when((n > 1) & (dev > 0), F.avg(r) / dev * F.sqrt(n)).alias("sharpe"))
    size = F.when(F.col("_zero") > 0, 0.0).when(F.col("log_growth") <= 709, F.exp("log_growth"))
    signed = F.when(F.col("_minus") % 2 == 1, -size).otherwise(size)
    return d.withColumns({
        "total_return": F.when(F.col("_k") > 0, signed - 1),
        "out_of_range": (F.col("_zero") == 0) & (F.col("log_growth") > 709)}).drop("_zero", "_minus", "_k")


def train_test_split(df: DataFrame, test_size: float = 0.2, by: Keys = "ticker", ts: str = "ts",
                     every: str = "1d") -> DataFrame:
    """Adds ``part``: the first int(n * (1 - test_size)) rows of each key train, the rest test."""
    d = number_rows(df, by, ts, every)
    cut = F.floor(F.col("_n") * (1 - test_size))
    return d.withColumn("part", F.when(F.col("_i") < cut, "train").otherwise("test")).drop("_i", "_n")


def ts_folds(df: DataFrame, k: int = 5, by: Keys = "ticker", ts: str = "ts",
             every: str = "1d") -> DataFrame:
    """Expanding folds: one row per fold a bar takes part in, with ``fold`` (0-based) and ``part``.

    Each test part has n div (k+1) rows; fold i tests the rows from n - (k-i) * size on.
    """
    d = number_rows(df, by, ts, every)
    size = F.floor(F.col("_n") / (k + 1))
    d = d.withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(k - 1))))
    start = F.col("_n") - (k - F.col("fold")) * size
    d = d.where((size > 0) & (F.col("_i") < start + size))
    return d.withColumn("part", F.when(F.col("_i") < start, "train").otherwise("test")).drop("_i", "_n")


def ma_trend(df: DataFrame, col: str = "close", n: int = 20, by: Keys = "ticker",
             ts: str = "ts") -> DataFrame:
    """Bullish where the last value is above the mean of the last ``n`` (of itself if there are fewer)."""
    recent = latest_n(df, n, by, ts).groupBy(*key_list(by)).agg(
        F.max_by(col, ts).alias("last"), F.avg(col).alias("_avg"), F.count(col).alias("_k"))
    ma = F.when(F.col("_k") >= n, F.col("_avg")).otherwise(F.col("last"))
    return recent.withColumn("ma", ma).withColumn(
        "trend", F.when(F.col("last") > F.col("ma"), "Bullish").otherwise("Bearish")).drop("_avg", "_k")


def cumulative(df: DataFrame, cols: dict[str, str], by: Keys = "ticker", ts: str = "ts",
               every: str | None = "1d") -> DataFrame:
    """Running totals, ``{"cum_volume": "volume"}``."""
    return running_sum(df, {out: F.col(c) for out, c in cols.items()}, by, ts, every)


def downsample(df: DataFrame, n: int = 100, by: Keys = "ticker", ts: str = "ts",
               every: str = "1d") -> DataFrame:
    """Keeps each ceil(len / n)-th row of a series longer than ``n``."""
    d = number_rows(df, by, ts, every)
    step = F.ceil(F.col("_n") / n)
    return d.where((F.col("_n") <= n) | (F.col("_i") % step == 0)).drop("_i", "_n")
