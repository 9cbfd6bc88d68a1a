"""Forecast models over all tickers at once.

Autoregressions are least squares on differenced series: the normal equations of every key are sums,
so one aggregate gathers them with partial sums on the map side, and a vectorised step solves the
small systems, one row per key. Tree models are grown for all keys at once (``trees``), each on its own lags.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickloom.functions.dates import bars_ahead
from tickloom.operators.core import Keys, Piece, Step, key_list, latest_n, number_rows, run_steps
from tickloom.operators.metrics import cv_summary, forecast_error, forecast_metrics
from tickloom.operators.series import lags_step, train_test_split, ts_folds
from tickloom.operators.trees import DEPTH, TreeModel, grow_boosted, grow_forest, packed, predicted, walked
from tickloom.session import checkpointed

Z95 = 1.959963984540054  # fixed value: two-sided 95 % point of the normal distribution
MIN_ROWS = 30            # fixed value: fewest rows a tree model is trained on

AR_LAGS = [1, 2, 3, 4, 5]
SEASONAL_LAGS = [1, 12, 13]
SEASON = 12


# --- autoregression ----------------------------------------------------------------------------

def _difference_polynomial(d: int, season: int | None) -> np.ndarray:
    """Coefficients of (1-B)^d (1-B^season) by power of B."""
    poly = np.array([1.0])
    for _ in range(d):
        poly = np.convolve(poly, [1.0, -1.0])
    if season:
        poly = np.convolve(poly, [1.0] + [0.0] * (season - 1) + [-1.0])
    return poly


def _differenced(col: str, lags: Sequence[int], d: int, season: int | None) -> Step:
    """``_w`` (the differenced series) and ``_x1 ..`` (its lags)."""
    poly = _difference_polynomial(d, season)

    def apply(df: DataFrame, p: Piece) -> DataFrame:
        w: Column = F.col(col)
        for k, c in enumerate(poly):
            if k and c:
                w = w + F.lit(float(c)) * F.lag(col, k).over(p.order)
        df = df.withColumn("_w", w)
        return df.withColumns({f"_x{i}": F.lag("_w", lag).over(p.order) for i, lag in enumerate(lags)})
    return Step(len(poly) - 1 + max(lags), apply)


def _solve(lags: Sequence[int], d: int, season: int | None, keys: Sequence[str]):
    p, poly = len(lags), _difference_polynomial(d, season)
    at = np.triu_indices(p)

    def solve(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            coef, recur, sigma2 = [], [], []
            for xx, xw, ww, n in zip(pdf["xx"], pdf["xw"], pdf["ww"], pdf["n"]):
                gram = np.zeros((p, p))
                gram[at] = xx
                gram = gram + np.triu(gram, 1).T
                b = np.asarray(xw, dtype=float)
                phi = np.linalg.lstsq(gram, b, rcond=None)[0]
                # y_t as a weighted sum of its own past: (1 - sum phi B^lag) * differences
                ar = np.zeros(max(lags) + 1)
                ar[0] = 1.0
                ar[list(lags)] = -phi
                coef.append(phi.tolist())
                recur.append((-np.convolve(ar, poly)[1:]).tolist())
                sigma2.append(max(float(ww - phi @ b), 0.0) / n)
            yield pdf[[*keys, "n"]].assign(coef=coef, recur=recur, sigma2=sigma2)
    return solve


def ar_fit(df: DataFrame, col: str = "close", lags: Sequence[int] = AR_LAGS, d: int = 1, season: int | None = None,
           by: Keys = "ticker", ts: str = "ts", every: str = "1d") -> DataFrame:
    """Least-squares autoregression of the differenced series, without constant.

    Returns per key: ``n`` equations, ``coef`` of the lags, ``sigma2``, and ``recur``, the weights of
    the undifferenced past (newest first). Keys with fewer equations than coefficients are left out.
    """
    keys, lags = key_list(by), list(lags)
    rows = run_steps(df.select(*keys, ts, col), [_differenced(col, lags, d, season)], keys, ts, every)
    x = [f"_x{i}" for i in range(len(lags))]
    rows = rows.na.drop(subset=["_w", *x])
    sums = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.array(*[F.sum(F.col(a) * F.col(b)) for i, a in enumerate(x) for b in x[i:]]).alias("xx"),
        F.array(*[F.sum(F.col(a) * F.col("_w")) for a in x]).alias("xw"),
        F.sum(F.col("_w") * F.col("_w")).alias("ww"),
    ).where(F.col("n") > len(lags))
    schema = T.StructType([
        *[sums.schema[k] for k in keys], T.StructField("n", T.LongType()),
        T.StructField("coef", T.ArrayType(T.DoubleType())), T.StructField("recur", T.ArrayType(T.DoubleType())),
        T.StructField("sigma2", T.DoubleType())])
    return sums.mapInPandas(_solve(lags, d, season, keys), schema)


def seasonal_ar_fit(df: DataFrame, col: str = "close", **key) -> DataFrame:
    """Seasonal differences regressed on lags 1, 12 and 13 (no moving-average terms)."""
    return ar_fit(df, col, SEASONAL_LAGS, 1, SEASON, **key)


# --- moving-average terms ----------------------------------------------------------------------

MA_LAGS = [1, 12, 13]    # a regular and a seasonal term, and their product
LONG_LAGS = [1, 2, 3, 12, 13, 14]


def arma_fit(df: DataFrame, col: str = "close", lags: Sequence[int] = SEASONAL_LAGS, ma_lags: Sequence[int] = MA_LAGS,
             d: int = 1, season: int | None = SEASON, long_lags: Sequence[int] = LONG_LAGS, by: Keys = "ticker",
             ts: str = "ts", every: str = "1d") -> DataFrame:
    """Autoregression with moving-average terms of the differenced series, by regression in two stages.

    A long autoregression gives the shocks (what it does not predict); then the series is regressed on its own lags and
    on lags of the shocks. Both stages are sums per key. Returns per key: ``n`` equations, ``coef`` (lags, then shocks),
    ``sigma2``, ``recur`` (the weights of the undifferenced past), and the newest values and shocks as ``ys`` and ``es``, oldest first.
    """
    keys, lags, ma_lags = key_list(by), list(lags), list(ma_lags)
    memory = max(long_lags) + d + (season or 0)
    rows = run_steps(df.select(*keys, ts, col), [_differenced(col, lags, d, season)], keys, ts, every)
    rows = ar_onestep(ar_fit(df, col, long_lags, d, season, by, ts, every), rows, memory, col, by, ts, every)
    rows = checkpointed(rows.withColumn("_e", F.col(col) - F.col("predicted")).drop("predicted"))

    def shocks(frame: DataFrame, p: Piece) -> DataFrame:
        return frame.withColumns({f"_x{len(lags) + i}": F.lag("_e", lag).over(p.order) for i, lag in enumerate(ma_lags)})

    x = [f"_x{i}" for i in range(len(lags) + len(ma_lags))]
    used = run_steps(rows, [Step(max(ma_lags), shocks)], keys, ts, every).na.drop(subset=["_w", *x])
    sums = used.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.array(*[F.sum(F.col(a) * F.col(b)) for i, a in enumerate(x) for b in x[i:]]).alias("xx"),
        F.array(*[F.sum(F.col(a) * F.col("_w")) for a in x]).alias("xw"),
        F.sum(F.col("_w") * F.col("_w")).alias("ww")).where(F.col("n") > len(x))
    newest = max(max(lags) + d + (season or 0), max(ma_lags))
    tails = latest_n(rows, newest, keys, ts).groupBy(*keys).agg(F.max(ts).alias("last"), F.array_sort(
        F.collect_list(F.struct(F.col(ts).alias("t"), F.col(col).alias("y"), F.col("_e").alias("e")))).alias("_tail"))
    tails = tails.select(*keys, "last", F.transform("_tail", lambda p: p["y"]).alias("ys"), F.transform("_tail", lambda p: p["e"]).alias("es"))
    p, at, poly = len(x), np.triu_indices(len(x)), _difference_polynomial(d, season)

    def solve(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            coef, recur, sigma2 = [], [], []
            for xx, xw, ww, n in zip(pdf["xx"], pdf["xw"], pdf["ww"], pdf["n"]):
                gram = np.zeros((p, p))
                gram[at] = xx
                gram = gram + np.triu(gram, 1).T
                b = np.asarray(xw, dtype=float)
                c = np.linalg.lstsq(gram, b, rcond=None)[0]
                ar = np.zeros(max(lags) + 1)
                ar[0], ar[lags] = 1.0, -c[:len(lags)]
                coef.append(c.tolist())
                recur.append((-np.convolve(ar, poly)[1:]).tolist())
                sigma2.append(max(float(ww - c @ b), 0.0) / n)
            yield pdf[[*keys, "n"]].assign(coef=coef, recur=recur, sigma2=sigma2)

    numbers = T.ArrayType(T.DoubleType())
    schema = T.StructType([*[sums.schema[k] for k in keys], T.StructField("n", T.LongType()), T.StructField("coef", numbers),
                           T.StructField("recur", numbers), T.StructField("sigma2", T.DoubleType())])
    return sums.mapInPandas(solve, schema).join(tails, keys)


def arma_forecast(fit: DataFrame, h: int, ma_lags: Sequence[int] = MA_LAGS, model: str = "seasonal_arma",
                  by: Keys = "ticker", ts: str = "ts", every: str = "1d") -> DataFrame:
    """Mean and 95 % bounds for the next ``h`` bars of ``arma_fit``; shocks to come are 0 in the mean."""
    keys, ma_lags = key_list(by), list(ma_lags)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            out = []
            for r in pdf.itertuples(index=False):
                recur, theta = np.asarray(r.recur), dict(zip(ma_lags, r.coef[len(r.coef) - len(ma_lags):]))
                if len(r.ys) < len(recur):
                    continue
                y, psi = list(r.ys), [1.0]
                for s in range(1, h + 1):
                    known = sum(t * r.es[s - 1 - lag] for lag, t in theta.items() if lag >= s)
                    y.append(float(recur @ np.asarray(y[-len(recur):])[::-1]) + known)
                    psi.append(float(sum(w * psi[s - 1 - i] for i, w in enumerate(recur[:s]))) + theta.get(s, 0.0))
                spread = Z95 * np.sqrt(r.sigma2 * np.cumsum(np.square(psi[:h])))
                named = [getattr(r, k) for k in keys]
                out += [(*named, s + 1, r.last, y[len(r.ys) + s], float(spread[s])) for s in range(h)]
            yield pd.DataFrame(out, columns=[*keys, "step", "last", "forecast", "spread"])

    schema = T.StructType([*[fit.schema[k] for k in keys], T.StructField("step", T.IntegerType()), fit.schema["last"],
                           T.StructField("forecast", T.DoubleType()), T.StructField("spread", T.DoubleType())])
    d = fit.mapInPandas(run, schema)
    return d.select(*keys, F.lit(model).alias("model"), "step", bars_ahead(F.col("last"), F.col("step"), every).alias(ts), "forecast",
                    (F.col("forecast") - F.col("spread")).alias("lower"), (F.col("forecast") + F.col("spread")).alias("upper"))


def _continue(start: Column, weights: Column, steps: int) -> Column:
    """``start`` extended by ``steps`` values, each the weighted sum of the newest ones before it."""
    def step(acc: Column, _: Column) -> Column:
        newest = F.reverse(F.slice(acc, -F.size(weights), F.size(weights)))
        products = F.zip_with(newest, weights, lambda a, b: a * b)
        return F.array_append(acc, F.aggregate(products, F.lit(0.0), lambda s, v: s + v))
    return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, step)


def _tails(df: DataFrame, col: str, size: int, keys: list[str], ts: str) -> DataFrame:
    """The newest ``size`` values per key, oldest first, and the last time."""
    return latest_n(df.where(F.col(col).isNotNull()), size, keys, ts).groupBy(*keys).agg(
        F.max(ts).alias("_last"),
        F.transform(F.array_sort(F.collect_list(F.struct(F.col(ts), F.col(col).alias("v")))), lambda p: p["v"]).alias("_tail"))


def ar_forecast(fit: DataFrame, df: DataFrame, h: int, col: str = "close", model: str = "ar", by: Keys = "ticker",
                ts: str = "ts", every: str = "1d", memory: int = 6) -> DataFrame:
    """Mean and 95 % bounds for the next ``h`` bars: (keys, model, step, ts, forecast, lower, upper).

    ``memory`` is the number of past values the fit looks at (largest lag plus differences). The
    error grows with the squared weights a shock keeps, which follow the same recursion.
    """
    keys = key_list(by)
    d = fit.join(_tails(df, col, memory, keys, ts), keys).where(F.size("_tail") >= F.size("recur"))
    path = F.slice(_continue(F.col("_tail"), F.col("recur"), h), F.size("_tail") + 1, h)
    impulse = F.concat(F.array_repeat(F.lit(0.0), F.size("recur") - 1), F.array(F.lit(1.0)))
    shocks = F.slice(_continue(impulse, F.col("recur"), h), F.size("recur"), h)
    d = d.select(*keys, "_last", "sigma2", F.posexplode(F.arrays_zip(path.alias("p"), shocks.alias("s"))).alias("_k", "_v"),
                 shocks.alias("_s"))
    spread = F.aggregate(F.slice("_s", 1, F.col("_k") + 1), F.lit(0.0), lambda acc, x: acc + x * x)
    d = d.withColumn("_sd", F.sqrt(F.col("sigma2") * spread))
    ahead = bars_ahead(F.col("_last"), F.col("_k") + 1, every)
    return d.select(
        *keys, F.lit(model).alias("model"), (F.col("_k") + 1).alias("step"), ahead.alias(ts),
        F.col("_v.p").alias("forecast"), (F.col("_v.p") - Z95 * F.col("_sd")).alias("lower"),
        (F.col("_v.p") + Z95 * F.col("_sd")).alias("upper"))


def ar_onestep(fit: DataFrame, df: DataFrame, memory: int, col: str = "close", by: Keys = "ticker", ts: str = "ts",
               every: str = "1d") -> DataFrame:
    """The prediction of each row from the actual values before it: adds ``predicted``."""
    keys = key_list(by)
    d = run_steps(df, [lags_step(col, memory)], keys, ts, every)
    fit_keys = [k for k in keys if k in fit.columns]
    past = F.array(*[F.col(f"lag_{i}") for i in range(1, memory + 1)])
    d = d.join(fit.select(*fit_keys, "recur"), fit_keys)
    product = F.zip_with(F.slice(past, 1, F.size("recur")), F.col("recur"), lambda a, b: a * b)
    predicted = F.aggregate(product, F.lit(0.0), lambda s, v: s + v)
    return d.withColumn("predicted", predicted).where(F.col("predicted").isNotNull()).drop(
        "recur", *[f"lag_{i}" for i in range(1, memory + 1)])


# --- trees -------------------------------------------------------------------------------------

def _lag_names(lags: int) -> list[str]:
    return [f"lag_{i}" for i in range(1, lags + 1)]


def lag_rows(df: DataFrame, col: str = "close", lags: int = 5, by: Keys = "ticker", ts: str = "ts",
             every: str = "1d") -> DataFrame:
    """Rows with all their lags as features; ``label`` is the value to predict."""
    d = run_steps(df, [lags_step(col, lags)], by, ts, every).na.drop(subset=[col, *_lag_names(lags)])
    return d.withColumn("label", F.col(col))


def tree_fit(rows: DataFrame, kind: str = "random_forest", trees: int = 100, depth: int | None = None,
             seed: int = 42, by: Keys = "ticker", lags: int = 5, **options) -> TreeModel:
    """A forest or boosted trees of every key over ``lag_rows``; keys with fewer than 30 rows get no model."""
    keys = key_list(by)
    enough = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= MIN_ROWS)
    train = checkpointed(rows.join(enough.select(*keys), keys, "left_semi").select(*keys, "ts", *_lag_names(lags), "label"))
    if train.isEmpty():
        raise ValueError(f"no key has {MIN_ROWS} clean rows")
    if kind == "random_forest":
        return grow_forest(train, _lag_names(lags), "label", keys, trees=trees, depth=depth or DEPTH, seed=seed, **options)
    if kind == "boosted_trees":
        return grow_boosted(train, _lag_names(lags), "label", keys, trees=trees, depth=depth or 6, **options)
    raise ValueError(f"unknown kind of trees: {kind}")


def tree_onestep(model: TreeModel, rows: DataFrame) -> DataFrame:
    """Predictions of ``lag_rows`` from their actual lags."""
    return predicted(model, rows)


def recursive_forecast(model: TreeModel, df: DataFrame, h: int, col: str = "close", lags: int = 5, name: str = "trees",
                       by: Keys = "ticker", ts: str = "ts", every: str = "1d") -> DataFrame:
    """Next ``h`` values, each prediction becoming the newest lag; one row per key walks its own trees."""
    keys = key_list(by)
    state = _tails(df, col, lags, keys, ts).where(F.size("_tail") == lags).join(packed(model), keys)

    def step(past: Column, _: Column) -> Column:
        return F.array_append(past, walked(model, [F.element_at(past, -i) for i in range(1, lags + 1)]))

    path = F.aggregate(F.sequence(F.lit(1), F.lit(h)), F.col("_tail"), step)
    d = state.select(*keys, "_last", F.posexplode(F.slice(path, lags + 1, h)).alias("_k", "forecast"))
    ahead = bars_ahead(F.col("_last"), F.col("_k") + 1, every)
    return d.select(*keys, F.lit(name).alias("model"), (F.col("_k") + 1).alias("step"), ahead.alias(ts), "forecast",
                    F.lit(None).cast("double").alias("lower"), F.lit(None).cast("double").alias("upper"))


# --- comparison --------------------------------------------------------------------------------

Predictor = Callable[..., DataFrame]


def ar_model(col: str = "close", lags: Sequence[int] = AR_LAGS, season: int | None = None, every: str = "1d") -> Predictor:
    """Trains on the first frame; predicts each row of the second that is marked ``part = 'test'``."""
    def predict(train: DataFrame, rows: DataFrame, by: Keys = "ticker") -> DataFrame:
        fit = ar_fit(train, col, lags, 1, season, by, every=every)
        return ar_onestep(fit, rows, max(lags) + 1 + (season or 0), col, by, every=every)
    return predict


def ar_path_model(col: str = "close", lags: Sequence[int] = AR_LAGS, season: int | None = None, every: str = "1d") -> Predictor:
    """As ``ar_model``, but the test rows are predicted in one go from the end of the training rows."""
    def predict(train: DataFrame, rows: DataFrame) -> DataFrame:
        test = number_rows(rows.where(F.col("part") == "test"), "ticker", "ts", every)
        longest = test.agg(F.max("_n")).first()[0] or 0
        if not longest:
            raise ValueError("no rows to predict")
        path = ar_forecast(ar_fit(train, col, lags, 1, season, every=every), train, longest, col, every=every,
                           memory=max(lags) + 1 + (season or 0))
        steps = path.select("ticker", F.col("step").alias("_s"), F.col("forecast").alias("predicted"))
        return test.withColumn("_s", F.col("_i") + 1).join(steps, ["ticker", "_s"]).drop("_i", "_n", "_s")
    return predict


def tree_model(kind: str, col: str = "close", lags: int = 5, trees: int = 100, depth: int | None = None,
               every: str = "1d") -> Predictor:
    def predict(train: DataFrame, rows: DataFrame, by: Keys = "ticker") -> DataFrame:
        model = tree_fit(lag_rows(train, col, lags, by, every=every), kind, trees, depth, by=by, lags=lags)
        return tree_onestep(model, lag_rows(rows, col, lags, by, every=every))
    return predict


def default_models(col: str = "close", every: str = "1d", trees: int = 100) -> dict[str, Predictor]:
    return {
        "ar": ar_model(col, every=every),
        "seasonal_ar": ar_model(col, SEASONAL_LAGS, SEASON, every),
        "random_forest": tree_model("random_forest", col, trees=trees, every=every),
        "boosted_trees": tree_model("boosted_trees", col, trees=trees, every=every),
    }


def compare_models(df: DataFrame, models: dict[str, Predictor] | None = None, test_size: float = 0.2,
                   col: str = "close", every: str = "1d") -> tuple[DataFrame, dict[str, str]]:
    """Errors per ticker and model on the held-out rows, and the messages of models that failed.

    The default models all predict one step ahead from actual values, so their errors compare; ``ar_path_model`` scores the
    whole path instead and belongs among its like. Each row's ``best`` tells whether the model has the smallest RMSE of its ticker.
    """
    rows = checkpointed(train_test_split(df.select("ticker", "ts", col), test_size, every=every))
    train = rows.where(F.col("part") == "train")
    scored, failed = None, {}
    for name, predict in (models or default_models(col, every)).items():
        try:
            p = checkpointed(predict(train, rows).where(F.col("part") == "test").select(
                "ticker", F.lit(name).alias("model"), "ts", F.col(col).alias("actual"), "predicted"))
        except (Py4JJavaError, PySparkException):
            raise  # a failing job says nothing about the model
        except Exception as e:  # a failing model is reported, the others still count
            failed[name] = f"{type(e).__name__}: {e}"
            continue
        scored = p if scored is None else scored.unionByName(p)
    if scored is None:
        raise ValueError(f"every model failed: {failed}")
    return _mark_best(forecast_metrics(scored, every=every), "rmse"), failed


def _mark_best(errors: DataFrame, score: str) -> DataFrame:
    """``best``: whether the model has the smallest error of its ticker (a group is one row per model)."""
    w = Window.partitionBy("ticker").orderBy(F.col(score).asc_nulls_last(), "model")
    return errors.withColumn("best", F.row_number().over(w) == 1)


def cross_validate_ar(df: DataFrame, k: int = 5, lags: Sequence[int] = AR_LAGS, col: str = "close", name: str = "ar",
                      every: str = "1d") -> DataFrame:
    """Errors per ticker and fold of one-step predictions; all folds are fitted in one aggregate."""
    keys = ["ticker", "fold"]
    rows = ts_folds(df.select("ticker", "ts", col), k, every=every)
    fit = ar_fit(rows.where(F.col("part") == "train"), col, lags, by=keys, every=every)
    p = ar_onestep(fit, rows, max(lags) + 1, col, keys, every=every).where(F.col("part") == "test")
    return forecast_error(p.select(*keys, F.lit(name).alias("model"), F.col(col).alias("actual"), "predicted"), [*keys, "model"])


def cross_validate(df: DataFrame, k: int = 5, models: dict[str, Predictor] | None = None, col: str = "close",
                   every: str = "1d") -> tuple[DataFrame, dict[str, str]]:
    """Mean and deviation of the fold errors per ticker and model, with the best model marked, and the messages of
    models that could not be fitted. ``folds`` tells how many folds the numbers rest on.

    A fold is a key beside the ticker, so every model is fitted to all folds at once."""
    keys = ["ticker", "fold"]
    rows = checkpointed(ts_folds(df.select("ticker", "ts", col), k, every=every))
    train, errors, failed = rows.where(F.col("part") == "train"), None, {}
    for name, predict in (models or default_models(col, every)).items():
        try:
            p = predict(train, rows, keys).where(F.col("part") == "test")
        except ValueError as e:  # too few rows in every fold
            failed[name] = str(e)
            continue
        found = checkpointed(forecast_error(
            p.select(*keys, F.lit(name).alias("model"), F.col(col).alias("actual"), "predicted"), [*keys, "model"]))
        errors = found if errors is None else errors.unionByName(found)
    if errors is None:
        raise ValueError(f"every model failed: {failed}")
    counts = errors.groupBy("ticker", "model").agg(F.count(F.lit(1)).alias("folds"))
    return _mark_best(cv_summary(errors).join(counts, ["ticker", "model"]), "mean_rmse"), failed


def horizons(forecast: DataFrame, ends: Sequence[int] = (1, 7, 30, 90)) -> DataFrame:
    """The forecast rows of each horizon: a row counts for every horizon it lies within."""
    reach = F.filter(F.array(*[F.lit(e) for e in ends]), lambda e: e >= F.col("step"))
    return forecast.withColumn("horizon", F.explode(reach))
