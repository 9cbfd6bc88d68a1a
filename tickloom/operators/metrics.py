"""Forecast errors and their summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.operators.core import Keys, key_list
from tickloom.operators.series import diff_step, run_steps


def _errors() -> tuple[Column, Column, Column]:
    a, p = F.col("actual"), F.col("predicted")
    rmse = F.sqrt(F.avg((a - p) * (a - p)))
    mape = F.avg(F.when(a != 0, F.abs((a - p) / a))) * 100
    return rmse, F.avg(F.abs(a - p)), mape


def shared(actual: DataFrame, predicted: DataFrame, by: Keys = "ticker", ts: str = "ts") -> DataFrame:
    """Actual and predicted values at the times both have: ``actual`` (keys, ts, actual) may lack some
    keys of ``predicted`` (such as the model)."""
    on = [c for c in [*key_list(by), ts] if c in actual.columns]
    return predicted.join(actual, on)


def forecast_metrics(joined: DataFrame, by: Keys = ("ticker", "model"), ts: str = "ts", every: str = "1d") -> DataFrame:
    """RMSE, MAE, MAPE, R2 and the share of steps with the right direction; undefined ones are 0."""
    keys = key_list(by)
    d = run_steps(joined, [diff_step("actual", "_da"), diff_step("predicted", "_dp")], keys, ts, every)
    rmse, mae, mape = _errors()
    sse = F.sum((F.col("actual") - F.col("predicted")) * (F.col("actual") - F.col("predicted")))
    sst = F.var_pop("actual") * F.count("actual")
    r2 = F.when(sst > 0, 1 - sse / sst).when(sse == 0, 1.0).otherwise(0.0)
    same = F.when(F.col("_da").isNotNull() & F.col("_dp").isNotNull(),
                  (F.signum("_da") == F.signum("_dp")).cast("double"))
    out = d.groupBy(*keys).agg(
        rmse.alias("rmse"), mae.alias("mae"), mape.alias("mape"), r2.alias("r2"),
        (F.avg(same) * 100).alias("direction_accuracy"))
    return out.na.fill(0.0, ["rmse", "mae", "mape", "r2", "direction_accuracy"])


def forecast_error(joined: DataFrame, by: Keys = ("ticker", "model")) -> DataFrame:
    """RMSE, MAE and MAPE, null where undefined."""
    rmse, mae, mape = _errors()
    return joined.groupBy(*key_list(by)).agg(rmse.alias("rmse"), mae.alias("mae"), mape.alias("mape"))


def cv_summary(folds: DataFrame, by: Keys = "ticker") -> DataFrame:
    """Mean and population deviation of each error over the folds, per key and model."""
    return folds.groupBy(*key_list(by), "model").agg(*[
        f(m).alias(f"{n}_{m}") for m in ("rmse", "mae", "mape") for n, f in (("mean", F.avg), ("std", F.stddev_pop))])
