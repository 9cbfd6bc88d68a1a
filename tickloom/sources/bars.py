"""Bars from raw trades."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.functions.dates import bar_start


def bars_from_trades(trades: DataFrame, every: str = "1d", price: str = "price", size: str = "size",
                     by: Sequence[str] = ("ticker",), ts: str = "ts", order: Column | None = None,
                     tiebreak: Sequence[str] = ()) -> DataFrame:
    """Open, high, low, close, volume and trade count per key and bar.

    All aggregates combine before the exchange, so a hot ticker sends one row per bar and task.
    ``order`` is a number (long or decimal) that ranks the trades of a key by time, such as a trade
    number; numbers keep the aggregate a hash aggregate in generated code. Without it the time and
    the ``tiebreak`` columns decide, compared as a struct, for which Spark sorts.
    """
    moment = order if order is not None else F.struct(F.col(ts), *[F.col(c) for c in tiebreak])
    return (
        trades.groupBy(*by, bar_start(F.col(ts), every).alias("_bar"))
        .agg(
            F.min_by(price, moment).alias("open"),
            F.max(price).alias("high"),
            F.min(price).alias("low"),
            F.max_by(price, moment).alias("close"),
            F.sum(size).alias("volume"),
            F.count(F.lit(1)).alias("trades"),
        )
        .withColumnRenamed("_bar", ts)
    )
