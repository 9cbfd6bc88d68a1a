"""What-if scenarios, computed for all tickers of a call at once."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.functions.numeric import safe_div
from tickloom.operators.core import Keys, key_list, latest_n
from tickloom.operators.series import pct_change

# Default target prices as factors of the current one, and default quantities.
PRICE_FACTORS = [0.5, 0.8, 0.9, 1.1, 1.2, 1.5, 2.0]
QUANTITIES = [1.0, 10.0, 100.0, 1000.0]

RISK_FREE = 0.02  # fixed value: annual rate


def latest_price(bars: DataFrame, by: Keys = "ticker", ts: str = "ts") -> DataFrame:
    return bars.groupBy(*key_list(by)).agg(F.max_by("close", ts).alias("current_price"))


def price_grid(bars: DataFrame, factors: Sequence[float] = PRICE_FACTORS, quantities: Sequence[float] = QUANTITIES,
               by: Keys = "ticker", ts: str = "ts") -> DataFrame:
    """One row per key, quantity and target price; the grid is a fixed list exploded on one row per key."""
    d = latest_price(bars, by, ts).where(F.col("current_price") > 0)
    d = d.withColumn("quantity", F.explode(F.array(*[F.lit(float(q)) for q in quantities])))
    d = d.withColumn("_f", F.explode(F.array(*[F.lit(float(f)) for f in factors])))
    p, q = F.col("current_price"), F.greatest(F.col("quantity"), F.lit(0.0))
    d = d.withColumn("target_price", p * F.col("_f"))
    d = d.withColumns({"investment": p * q, "future_value": F.col("target_price") * q})
    d = d.withColumn("profit_loss", F.col("future_value") - F.col("investment"))
    return d.withColumns({
        "price_change_pct": (F.col("target_price") - p) / p * 100,
        "profit_loss_pct": F.coalesce(safe_div(F.col("profit_loss"), F.col("investment")) * 100, F.lit(0.0)),
    }).drop("_f")


def scenario_rollup(grid: DataFrame, by: Keys = "ticker") -> DataFrame:
    """Best, worst and mean profit, their number, and the rate of the best and worst scenario."""
    order = F.struct(F.col("profit_loss"), -F.col("quantity"), -F.col("target_price"))
    worst = F.struct(F.col("profit_loss"), F.col("quantity"), F.col("target_price"))
    return grid.groupBy(*key_list(by)).agg(
        F.max("profit_loss").alias("max_profit"), F.min("profit_loss").alias("min_profit"),
        F.avg("profit_loss").alias("avg_profit"), F.count(F.lit(1)).alias("scenarios"),
        F.max_by("profit_loss_pct", order).alias("best_roi"), F.min_by("profit_loss_pct", worst).alias("worst_roi"))


def _return_moments(bars: DataFrame, by: Keys, ts: str, every: str) -> DataFrame:
    return pct_change(bars, "close", "_r", by=by, ts=ts, every=every).groupBy(*key_list(by)).agg(
        F.max_by("close", ts).alias("current_price"),
        F.coalesce(F.avg("_r"), F.lit(0.0)).alias("_mean"), F.stddev_samp("_r").alias("_dev"))


def strategy_outcome(bars: DataFrame, investment: float, days: int = 30, stop_loss_pct: float = 10,
                     take_profit_pct: float = 20, buy_price: float | None = None, sell_price: float | None = None,
                     forecast: DataFrame | None = None, by: Keys = "ticker", ts: str = "ts", every: str = "1d") -> DataFrame:
    """Outcome of buying now and leaving after ``days`` at the given, forecast or trend price.

    A price at or beyond the stop or the target is cut there. ``forecast`` has the keys, ``step`` and
    ``forecast``; without it (or for keys it lacks) the mean return compounds.
    """
    if investment <= 0:
        raise ValueError("the investment must be greater than 0")
    keys = key_list(by)
    d = _return_moments(bars, by, ts, every)
    d = d.withColumn("buy_price", F.lit(float(buy_price)) if buy_price else F.col("current_price")).where(F.col("buy_price") > 0)
    trend = F.col("buy_price") * F.pow(1 + F.col("_mean"), F.lit(days))
    if sell_price is not None:
        exit_price: Column = F.lit(float(sell_price))
    elif forecast is not None:
        ends = forecast.where(F.col("step") == days).select(*keys, F.col("forecast").alias("_fc"))
        d = d.join(ends, keys, "left")
        exit_price = F.coalesce(F.col("_fc"), trend)
    else:
        exit_price = trend
    stop = F.col("buy_price") * (1 - stop_loss_pct / 100) if stop_loss_pct > 0 else F.lit(0.0)
    take = F.col("buy_price") * (1 + take_profit_pct / 100) if take_profit_pct > 0 else F.lit(math.inf)
    d = d.withColumns({
        "quantity": F.lit(float(investment)) / F.col("buy_price"), "stop_loss_price": stop,
        "take_profit_price": take, "sell_price": exit_price})
    low, high = F.col("sell_price") <= F.col("stop_loss_price"), F.col("sell_price") >= F.col("take_profit_price")
    d = d.withColumns({
        "final_price": F.when(low, F.col("stop_loss_price")).when(high, F.col("take_profit_price")).otherwise(F.col("sell_price")),
        "outcome": F.when(low, "Stop Loss Hit").when(high, "Take Profit Hit").otherwise("Normal Exit")})
    d = d.withColumn("exit_value", F.greatest(F.col("quantity") * F.col("final_price"), F.lit(0.0)))
    d = d.withColumn("profit_loss", F.col("exit_value") - investment)
    max_loss = investment * stop_loss_pct / 100 if stop_loss_pct > 0 else 0.0
    max_gain = investment * take_profit_pct / 100 if take_profit_pct > 0 else 0.0
    return d.withColumns({
        "roi_pct": F.col("profit_loss") / investment * 100,
        "max_loss": F.lit(float(max_loss)), "max_gain": F.lit(float(max_gain)),
        "risk_reward_ratio": F.lit(max_gain / max_loss if max_loss > 0 else math.inf),
    }).drop("_mean", "_dev", "_fc")


def portfolio(bars: DataFrame, allocations: Mapping[str, float] | Sequence[str], total: float, days: int = 30,
              ts: str = "ts", every: str = "1d") -> DataFrame:
    """Positions of a portfolio. Weights in percent must sum to 100; a plain list means equal ones."""
    if total <= 0 or not allocations:
        raise ValueError("a portfolio needs a positive total and at least one ticker")
    weights = dict(allocations) if isinstance(allocations, Mapping) else {t: 100.0 / len(allocations) for t in allocations}
    if abs(sum(weights.values()) - 100) > 0.01:
        raise ValueError(f"weights sum to {sum(weights.values())}, not to 100")
    share = F.element_at(F.create_map(*[x for t, w in weights.items() for x in (F.lit(t), F.lit(float(w)))]), F.col("ticker"))
    d = _return_moments(bars.where(F.col("ticker").isin(*weights)), "ticker", ts, every).where(F.col("current_price") > 0)
    d = d.withColumn("allocation_pct", share)
    d = d.withColumns({
        "investment": F.col("allocation_pct") / 100 * total,
        "expected_return": F.col("_mean") * days * 100,
        "volatility": F.coalesce("_dev", F.lit(0.0)) * math.sqrt(252) * 100,
        "predicted_price": F.col("current_price") * (1 + F.col("_mean") * days)})
    d = d.withColumn("quantity", F.col("investment") / F.col("current_price"))
    return d.withColumn("predicted_value", F.greatest(F.col("quantity") * F.col("predicted_price"), F.lit(0.0))).drop("_mean", "_dev")


def joint_volatility(bars: DataFrame, allocations: Mapping[str, float], ts: str = "ts", every: str = "1d") -> Column:
    """Annual deviation of the weighted return in percent, over the times at which every ticker has one.

    The deviation of the weighted sum holds all covariances, so no matrix is needed.
    """
    share = F.element_at(F.create_map(*[x for t, w in allocations.items() for x in (F.lit(t), F.lit(float(w)))]), F.col("ticker"))
    r = pct_change(bars.where(F.col("ticker").isin(*allocations)), "close", "_r", ts=ts, every=every).where(F.col("_r").isNotNull())
    joint = r.groupBy(ts).agg(F.sum(share / 100 * F.col("_r")).alias("_j"), F.count(F.lit(1)).alias("_k")).where(F.col("_k") == len(allocations))
    return joint.agg(F.coalesce(F.stddev_samp("_j"), F.lit(0.0)) * math.sqrt(252) * 100).scalar()


def portfolio_summary(positions: DataFrame, volatility: Column | None = None) -> DataFrame:
    """Value, expected return, deviation and return per deviation.

    Without ``volatility`` the positions count as independent; ``joint_volatility`` takes their covariance in.
    """
    w, v = F.col("allocation_pct") / 100, F.col("volatility") / 100
    d = positions.agg(
        F.sum("investment").alias("total_current_value"), F.sum("predicted_value").alias("total_predicted_value"),
        (F.sqrt(F.sum(w * w * v * v)) * 100).alias("portfolio_volatility_pct"))
    if volatility is not None:
        d = d.withColumn("portfolio_volatility_pct", volatility)
    gain = F.col("total_predicted_value") - F.col("total_current_value")
    d = d.withColumn("expected_return_pct", F.coalesce(safe_div(gain, F.col("total_current_value")) * 100, F.lit(0.0)))
    return d.withColumn("sharpe_ratio", F.coalesce(
        safe_div(F.col("expected_return_pct") - RISK_FREE, F.col("portfolio_volatility_pct")), F.lit(0.0)))


def dca_purchases(bars: DataFrame, amount: float, every_n: int = 7, periods: int = 52, by: Keys = "ticker",
                  ts: str = "ts") -> DataFrame:
    """Purchases at every ``every_n``-th of the last ``every_n * periods`` bars, with running totals.

    Keys with fewer bars are left out. A window group holds at most that many bars.
    """
    if min(amount, every_n, periods) <= 0:
        raise ValueError("amount, frequency and periods must be greater than 0")
    keys, need = key_list(by), every_n * periods
    recent = latest_n(bars, need, by, ts)
    enough = Window.partitionBy(*keys)
    d = recent.withColumn("_n", F.count(F.lit(1)).over(enough)).where(F.col("_n") == need)
    d = d.where(((need - F.col("age")) % every_n == 0) & (F.col("close") > 0))
    w = Window.partitionBy(*keys).orderBy(ts)
    d = d.select(*keys, ts, F.col("close").alias("price"), F.lit(float(amount)).alias("investment"),
                 (F.lit(float(amount)) / F.col("close")).alias("quantity"))
    return d.withColumns({
        "period": F.row_number().over(w), "cumulative_quantity": F.sum("quantity").over(w),
        "cumulative_investment": F.sum("investment").over(w)})


def dca(bars: DataFrame, amount: float, every_n: int = 7, periods: int = 52, by: Keys = "ticker",
        ts: str = "ts") -> DataFrame:
    """Result of the regular purchases next to one purchase at the start; the total counts all periods."""
    keys, total = key_list(by), float(amount * periods)
    bought = dca_purchases(bars, amount, every_n, periods, by, ts).groupBy(*keys).agg(
        F.sum("quantity").alias("total_quantity"), F.count(F.lit(1)).alias("purchases"))
    ends = latest_n(bars, every_n * periods, by, ts).groupBy(*keys).agg(
        F.max_by("close", ts).alias("final_price"), F.min_by("close", ts).alias("lump_sum_price"))
    d = bought.join(ends, keys)
    d = d.withColumns({
        "total_investment": F.lit(total),
        "avg_purchase_price": F.lit(total) / F.col("total_quantity"),
        "final_value": F.greatest(F.col("total_quantity") * F.col("final_price"), F.lit(0.0)),
        "lump_sum_value": F.coalesce(safe_div(F.lit(total), F.greatest(F.col("lump_sum_price"), F.lit(0.0))), F.lit(0.0))
        * F.greatest(F.col("final_price"), F.lit(0.0))})
    return d.withColumns({
        "profit_loss": F.col("final_value") - total,
        "roi_pct": (F.col("final_value") - total) / total * 100,
        "lump_sum_roi_pct": (F.col("lump_sum_value") - total) / total * 100,
        "advantage": F.when(F.col("final_value") > F.col("lump_sum_value"), "DCA").otherwise("Lump Sum")})
