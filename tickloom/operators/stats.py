"""Descriptive statistics per key."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.functions.numeric import finite, safe_div
from tickloom.operators.core import Keys, key_list
from tickloom.operators.quality import FEATURES, to_cells
from tickloom.operators.series import pct_change
from tickloom.session import checkpointed

SKETCH = 10_000
GRID = 64      # parts into which a bracket is cut by the next pass


def _narrowed(v: DataFrame, sketch: DataFrame, keys: list[str], probs: Sequence[float]) -> DataFrame:
    """``_cuts`` drawn together until no bracket holds more than ``SKETCH`` rows, or repeats of few values.

    Each pass counts what lies below a bracket and inside it, on the map side, and draws the next bracket around the
    wanted rank by a sketch of what is inside; so the passes grow with the logarithm of the rows.
    """
    while True:
        low = [F.col("_cuts")[2 * k] for k in range(len(probs))]
        high = [F.col("_cuts")[2 * k + 1] for k in range(len(probs))]
        held = v.join(sketch.where(F.col("_n") > SKETCH), keys)
        inside = [F.col("_v").between(a, z) for a, z in zip(low, high)]
        counts = checkpointed(held.groupBy(*keys, "_n", "_cuts").agg(*[
            c for k, (a, z) in enumerate(zip(low, high)) for c in (
                F.count_if(F.col("_v") < a).alias(f"b{k}"), F.count_if(inside[k] & (a < z)).alias(f"i{k}"))]))
        most = counts.agg(F.max(F.greatest(*[F.col(f"i{k}") for k in range(len(probs))], F.lit(0)))).first()[0] or 0
        if most <= SKETCH:
            return sketch
        shares = []
        for k, p in enumerate(probs):  # the wanted ranks as shares of what is inside, with the slack of a sketch
            size = F.greatest(F.col(f"i{k}"), F.lit(1))
            at = ((F.col("_n") - 1) * p - F.col(f"b{k}")) / size
            shares.append((F.greatest(F.lit(0.0), at - 4 / SKETCH), F.least(F.lit(1.0), at + 4 / SKETCH + 1 / size)))
        wide = counts.select(*keys, "_n", "_cuts", *[F.col(f"i{k}") for k in range(len(probs))],
                             *[s.alias(f"{e}{k}") for k, pair in enumerate(shares) for e, s in zip("lh", pair)])
        grid = [i / GRID for i in range(GRID + 1)]
        at = wide.join(v, keys).groupBy(*keys, "_n", "_cuts", *[c for k in range(len(probs)) for c in (f"i{k}", f"l{k}", f"h{k}")]).agg(*[
            F.percentile_approx(F.when(inside[k], F.col("_v")), grid, SKETCH).alias(f"g{k}") for k in range(len(probs))])
        cuts = []
        for k in range(len(probs)):
            small = (F.col(f"i{k}") <= SKETCH) | F.col(f"g{k}").isNull()
            below = F.greatest(F.floor(F.col(f"l{k}") * GRID) - 1, F.lit(0)).cast("int")
            above = F.least(F.ceil(F.col(f"h{k}") * GRID) + 1, F.lit(GRID)).cast("int")
            cuts += [F.when(small, low[k]).otherwise(F.get(f"g{k}", below)), F.when(small, high[k]).otherwise(F.get(f"g{k}", above))]
        moved = checkpointed(at.select(*keys, "_n", F.array(*cuts).alias("_cuts"), (F.array(*cuts) == F.col("_cuts")).alias("_same")))
        if not moved.where("not _same").take(1):
            return sketch  # what is left in a bracket are repeats of few values, which are counted by value
        sketch = checkpointed(sketch.join(moved.select(*keys), keys, "left_anti").select(*keys, "_n", "_cuts").unionByName(moved.drop("_same")))


def exact_quantiles(df: DataFrame, by: Keys, value: str, probs: Sequence[float]) -> DataFrame:
    """Exact interpolated quantiles ``q0, q1, ...`` per key without gathering a key in one task.

    A sketch with a proven rank error brackets each quantile. Brackets that hold more than ``SKETCH`` rows are drawn
    together by further sketches, so what is sorted in the end is bounded; everything below is just counted. Keys of
    up to ``SKETCH`` rows are sorted whole.
    """
    keys = key_list(by)
    v = df.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("_v"))
    slack = 4 / SKETCH
    cuts = [c for p in probs for c in (max(p - slack, 0.0), min(p + slack, 1.0))]
    sketch = v.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_n"), F.percentile_approx("_v", cuts, SKETCH).alias("_cuts"))
    # a bracket has 8 parts in SKETCH of the rows, so only keys of more than SKETCH * SKETCH / 8 rows can need another pass
    sketch = checkpointed(sketch)
    if (sketch.agg(F.max("_n")).first()[0] or 0) > SKETCH * SKETCH // 8:
        v = checkpointed(v)
        sketch = _narrowed(v, sketch, keys, probs)
    big = F.col("_n") > SKETCH
    ranges = F.array(*[
        F.when(~big | F.col("_v").between(F.col("_cuts")[2 * k], F.col("_cuts")[2 * k + 1]),
               F.struct(F.lit(k).alias("p"), F.col("_v").alias("w")))
        .when(F.col("_v") < F.col("_cuts")[2 * k],
              F.struct(F.lit(k).alias("p"), F.lit(None).cast("double").alias("w")))
        for k in range(len(probs))
    ])
    counted = (
        v.join(sketch, keys).select(*keys, "_n", F.inline(F.array_compact(ranges)))
        .groupBy(*keys, "_n", "p", "w").agg(F.count(F.lit(1)).alias("_k"))
    )
    upto = F.sum("_k").over(Window.partitionBy(*keys, "p").orderBy(F.col("w").asc_nulls_first())
                            .rowsBetween(Window.unboundedPreceding, 0))
    prob = F.element_at(F.array(*[F.lit(float(p)) for p in probs]), F.col("p") + 1)
    ranked = counted.withColumns({"_upto": upto, "_pos": (F.col("_n") - 1) * prob})
    low, high = F.floor("_pos"), F.ceil("_pos")
    below = F.max(F.when(F.col("w").isNull(), F.col("_upto")))
    picked = ranked.groupBy(*keys, "p").agg(
        F.min(F.when(F.col("_upto") > low, F.col("w"))).alias("_a"),
        F.min(F.when(F.col("_upto") > high, F.col("w"))).alias("_z"),
        F.first("_pos").alias("_pos"), below.alias("_below"))
    share = F.col("_pos") - low
    missed = (F.coalesce("_below", F.lit(0)) > low) | F.col("_a").isNull() | F.col("_z").isNull()
    exact = F.when(missed, F.raise_error(F.lit("quantile outside its bracket")).cast("double")).otherwise(F.col("_a") + (F.col("_z") - F.col("_a")) * share)
    picked = picked.withColumn("_q", exact)
    return picked.groupBy(*keys).agg(*[
        F.max(F.when(F.col("p") == k, F.col("_q"))).alias(f"q{k}") for k in range(len(probs))])


def _digits(col: Column) -> Column:
    """Two decimals for the volume, four for prices."""
    return F.when(F.col("feature") == "volume", F.round(col, 2)).otherwise(F.round(col, 4))


def describe_series(df: DataFrame, cols: Sequence[str] = FEATURES, by: Keys = "ticker", ts: str = "ts",
                    rounded: bool = True) -> DataFrame:
    """Per key and feature: rows, first and last day, mean, median, sample deviation, min, max."""
    keys = key_list(by)
    cells = to_cells(df, cols, [*keys, ts]).where(F.col("value").isNotNull())
    plain = cells.groupBy(*keys, "feature").agg(
        F.count(F.lit(1)).alias("n"), F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"),
        F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"),
        F.min("value").alias("min"), F.max("value").alias("max"))
    medians = exact_quantiles(cells, [*keys, "feature"], "value", [0.5]).withColumnRenamed("q0", "median")
    d = plain.join(medians, [*keys, "feature"])
    numbers = {c: finite(F.col(c)) for c in ["mean", "median", "std", "min", "max"]}
    return d.withColumns({c: _digits(v) if rounded else v for c, v in numbers.items()})


def return_stats(df: DataFrame, col: str = "close", by: Keys = "ticker", ts: str = "ts", every: str = "1d",
                 periods: int = 252) -> DataFrame:
    """Mean and deviation of the returns in percent, and the annualised deviation in percent."""
    r = pct_change(df.where(F.col(col).isNotNull()), col, "_r", by=by, ts=ts, every=every)
    dev = F.stddev_samp("_r")
    return r.groupBy(*key_list(by)).agg(
        F.count("_r").alias("returns"),
        (F.avg("_r") * 100).alias("daily_return_mean"),
        (dev * 100).alias("daily_return_std"),
        (dev * math.sqrt(periods) * 100).alias("volatility_annualized"),
    )


def price_change(df: DataFrame, col: str = "close", by: Keys = "ticker", ts: str = "ts") -> DataFrame:
    """Last minus first value, and in percent of the first (0 where the first is 0)."""
    d = df.groupBy(*key_list(by)).agg(F.min_by(col, ts).alias("_a"), F.max_by(col, ts).alias("_z"))
    return d.select(
        *key_list(by), (F.col("_z") - F.col("_a")).alias("price_change"),
        F.when(F.col("_a") == 0, 0.0).otherwise((F.col("_z") - F.col("_a")) / F.col("_a") * 100).alias("price_change_pct"))


def volume_stats(df: DataFrame, by: Keys = "ticker") -> DataFrame:
    return df.groupBy(*key_list(by)).agg(
        F.round(F.avg("volume"), 2).alias("avg_daily_volume"), F.round(F.sum("volume"), 2).alias("total_volume"))


def data_summary(df: DataFrame, ts: str = "ts", updated: str | None = None) -> DataFrame:
    """First and last time, rows and last update per ticker, source and interval."""
    return df.groupBy("ticker", "source", "interval").agg(
        F.min(ts).alias("first_date"), F.max(ts).alias("last_date"),
        F.count(F.lit(1)).alias("record_count"), F.max(updated or ts).alias("last_update"))


def db_rollup(summary: DataFrame) -> DataFrame:
    """Tickers, sources, rows and overall range of a ``data_summary``."""
    return summary.agg(
        F.count_distinct("ticker").alias("unique_tickers"),
        F.array_join(F.array_sort(F.collect_set("source")), ",").alias("sources"),
        F.sum("record_count").alias("total_records"),
        F.min("first_date").alias("start"), F.max("last_date").alias("end"))


def histogram(df: DataFrame, bins: int = 20, cols: Sequence[str] = FEATURES, by: Keys = "ticker") -> DataFrame:
    """Rows per equal-width bin between the least and greatest value, per key and feature."""
    keys = [*key_list(by), "feature"]
    cells = to_cells(df, cols, key_list(by)).where(F.col("value").isNotNull())
    span = cells.groupBy(*keys).agg(F.min("value").alias("_lo"), F.max("value").alias("_hi"))
    width = (F.col("_hi") - F.col("_lo")) / bins
    place = F.coalesce(safe_div(F.col("value") - F.col("_lo"), width), F.lit(0.0))
    return (
        cells.join(span, keys)
        .withColumn("bin", F.least(F.floor(place), F.lit(bins - 1)).cast("int"))
        .groupBy(*keys, "bin", "_lo", "_hi").agg(F.count(F.lit(1)).alias("n"))
        .withColumns({"lower": F.col("_lo") + width * F.col("bin"), "upper": F.col("_lo") + width * (F.col("bin") + 1)})
        .drop("_lo", "_hi")
    )


def box_stats(df: DataFrame, cols: Sequence[str] = FEATURES, by: Keys = "ticker") -> DataFrame:
    """Quartiles, whiskers (last values within 1.5 interquartile ranges) and outliers per feature."""
    keys = [*key_list(by), "feature"]
    cells = to_cells(df, cols, key_list(by)).where(F.col("value").isNotNull())
    q = exact_quantiles(cells, keys, "value", [0.25, 0.5, 0.75]).select(
        *keys, F.col("q0").alias("q1"), F.col("q1").alias("median"), F.col("q2").alias("q3"))
    reach = (F.col("q3") - F.col("q1")) * 1.5
    inside = F.col("value").between(F.col("q1") - reach, F.col("q3") + reach)
    return cells.join(q, keys).groupBy(*keys, "q1", "median", "q3").agg(
        F.min(F.when(inside, F.col("value"))).alias("whisker_low"),
        F.max(F.when(inside, F.col("value"))).alias("whisker_high"),
        F.count_if(~inside).alias("outliers"))
