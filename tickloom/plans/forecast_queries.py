"""Forecast queries. Numbers of tree models have no SQL twin."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickloom.operators import forecast as M
from tickloom.operators import trees as B
from tickloom.plans.quality_queries import rounded
from tickloom.plans.registry import DAY, day, query, r, rnd
from tickloom.plans.views import bars_day, bars_month, using
from tickloom.session import checkpointed

W = "OVER (PARTITION BY ticker ORDER BY ts)"


def _fit2(source: str, by: str = "ticker") -> list[str]:
    """Least squares with two lags in closed form."""
    w = f"OVER (PARTITION BY {by} ORDER BY ts)"
    return [
        f"w0 AS (SELECT *, close - lag(close) {w} AS w FROM {source})",
        f"w1 AS (SELECT *, lag(w, 1) {w} AS a, lag(w, 2) {w} AS b FROM w0)",
        f"g AS (SELECT {by}, count(*) AS n, sum(a * a) AS aa, sum(a * b) AS ab, sum(b * b) AS bb, sum(a * w) AS aw, sum(b * w) AS bw, sum(w * w) AS ww FROM w1 WHERE b IS NOT NULL GROUP BY {by})",
        f"f0 AS (SELECT {by}, n, aw, bw, ww, (aw * bb - bw * ab) / (aa * bb - ab * ab) AS p1, (bw * aa - aw * ab) / (aa * bb - ab * ab) AS p2 FROM g)",
        f"fit AS (SELECT {by}, n, p1, p2, (ww - p1 * aw - p2 * bw) / n AS s2 FROM f0)",
    ]


@query("m8_ar_fit", using("bars_day", f"SELECT ticker, n, {r('p1', 6)} AS phi_1, {r('p2', 6)} AS phi_2, {r('s2', 0)} AS sigma2 FROM fit", *_fit2("bars_day")))
def m8(spark, sf):
    f = M.ar_fit(bars_day(spark, sf), lags=[1, 2])
    return f.select("ticker", "n", rnd(F.col("coef")[0], 6).alias("phi_1"), rnd(F.col("coef")[1], 6).alias("phi_2"),
                    rnd("sigma2", 0).alias("sigma2"))


@query("m8_ar5_fit")
def m8_five(spark, sf):
    f = M.ar_fit(bars_day(spark, sf))
    return f.select("ticker", "n", *[rnd(F.col("coef")[i], 6).alias(f"phi_{i + 1}") for i in range(5)], rnd("sigma2", 0).alias("sigma2"))


_PATH = [*_fit2("bars_day"),
         f"t AS (SELECT ticker, arg_max(ts, ts) AS last_ts, arg_max(close, ts) AS y1, arg_max(l1, ts) AS y2, arg_max(l2, ts) AS y3 FROM (SELECT ticker, ts, close, lag(close) {W} AS l1, lag(close, 2) {W} AS l2 FROM bars_day) GROUP BY ticker)",
         """path AS (SELECT ticker, 0 AS step, last_ts, s2, p1, p2, y1, y2, y3, CAST(1 AS DOUBLE) AS e1, CAST(0 AS DOUBLE) AS e2, CAST(0 AS DOUBLE) AS e3, CAST(0 AS DOUBLE) AS v
         FROM t JOIN fit USING (ticker) UNION ALL
         SELECT ticker, step + 1, last_ts, s2, p1, p2, (1 + p1) * y1 + (p2 - p1) * y2 - p2 * y3, y1, y2,
         (1 + p1) * e1 + (p2 - p1) * e2 - p2 * e3, e1, e2, v + e1 * e1 FROM path WHERE step < 30)"""]


@query("m9_ar_forecast", using("bars_day", f"""SELECT ticker, 'ar2' AS model, step, strftime(last_ts + step * INTERVAL 1 DAY, '%Y-%m-%d') AS d, {r('y1', 3)} AS forecast,
  {r(f'y1 - {M.Z95!r} * sqrt(s2 * v)', 3)} AS lower, {r(f'y1 + {M.Z95!r} * sqrt(s2 * v)', 3)} AS upper FROM path WHERE step > 0""", *_PATH, recursive=True))
def m9(spark, sf):
    b = bars_day(spark, sf)
    f = M.ar_forecast(M.ar_fit(b, lags=[1, 2]), b, 30, model="ar2", memory=3)
    return f.select("ticker", "model", "step", day(), *rounded(["forecast", "lower", "upper"], 3))


@query("m13_onestep", using("bars_day", f"""SELECT ticker, {DAY}, {r('close', 3)} AS actual, {r('l1 + p1 * (l1 - l2) + p2 * (l2 - l3)', 3)} AS predicted FROM
  (SELECT ticker, ts, close, lag(close) {W} AS l1, lag(close, 2) {W} AS l2, lag(close, 3) {W} AS l3 FROM bars_day) JOIN fit USING (ticker) WHERE l3 IS NOT NULL""", *_fit2("bars_day")))
def m13(spark, sf):
    b = bars_day(spark, sf)
    p = M.ar_onestep(M.ar_fit(b, lags=[1, 2]), b, 3)
    return p.select("ticker", day(), rnd("close", 3).alias("actual"), rnd("predicted", 3).alias("predicted"))


_FOLDS = [f"p AS (SELECT ticker, ts, close, row_number() {W} - 1 AS i, count(*) OVER (PARTITION BY ticker) AS n FROM bars_day)",
          "ff AS (SELECT p.*, n // 6 AS size, CAST(k AS INTEGER) AS fold FROM p, range(0, 5) t(k))",
          "fr AS (SELECT * FROM ff WHERE i < n - (5 - fold) * size + size)",
          "train AS (SELECT * FROM fr WHERE i < n - (5 - fold) * size)",
          *_fit2("train", "ticker, fold")]


@query("m15_cross_validate_ar", using("bars_day", f"""SELECT ticker, fold, 'ar' AS model, {r('sqrt(avg((close - predicted) ** 2))', 3)} AS rmse, {r('avg(abs(close - predicted))', 3)} AS mae,
  {r('avg(abs((close - predicted) / close)) * 100', 3)} AS mape FROM (SELECT ticker, fold, close, i, total, size, l1 + p1 * (l1 - l2) + p2 * (l2 - l3) AS predicted FROM
  (SELECT ticker, fold, ts, close, i, n AS total, size, lag(close) OVER q AS l1, lag(close, 2) OVER q AS l2, lag(close, 3) OVER q AS l3 FROM fr WINDOW q AS (PARTITION BY ticker, fold ORDER BY ts))
  JOIN (SELECT ticker, fold, p1, p2 FROM fit) USING (ticker, fold)) WHERE i >= total - (5 - fold) * size GROUP BY ticker, fold""", *_FOLDS))
def m15_ar(spark, sf):
    d = M.cross_validate_ar(bars_day(spark, sf), 5, lags=[1, 2])
    return d.select("ticker", "fold", "model", *rounded(["rmse", "mae", "mape"], 3))


@query("m16_horizons")
def m16(spark, sf):
    b = bars_day(spark, sf)
    f = M.horizons(M.ar_forecast(M.ar_fit(b), b, 90, memory=6))
    return f.select("ticker", "horizon", "step", day(), *rounded(["forecast", "lower", "upper"], 3))


@query("m16_horizons_ar2", using("bars_day", f"""SELECT ticker, CAST(h AS INTEGER) AS horizon, step, strftime(last_ts + step * INTERVAL 1 DAY, '%Y-%m-%d') AS d, {r('y1', 3)} AS forecast
  FROM path, (SELECT unnest([1, 7, 30, 90]) AS h) WHERE step > 0 AND step <= h""", *_PATH[:-1], _PATH[-1].replace("step < 30", "step < 90"), recursive=True))
def m16_two(spark, sf):
    b = bars_day(spark, sf)
    f = M.horizons(M.ar_forecast(M.ar_fit(b, lags=[1, 2]), b, 90, memory=3))
    return f.select("ticker", "horizon", "step", day(), rnd("forecast", 3).alias("forecast"))


@query("m17_seasonal_ar")
def m17(spark, sf):
    b = bars_day(spark, sf)
    f = M.ar_forecast(M.seasonal_ar_fit(b), b, 12, model="seasonal_ar", memory=26)
    return f.select("ticker", "model", "step", *rounded(["forecast", "lower", "upper"], 3))


@query("m17_seasonal_arma_forecast")
def m17_arma_forecast(spark, sf):
    f = M.arma_forecast(M.arma_fit(bars_day(spark, sf)), 12)
    return f.select("ticker", "model", "step", *rounded(["forecast", "lower", "upper"], 3))


# seasonal differences, a long fit of two lags for the shocks, then one lag and one shock in closed form
@query("m17_seasonal_arma", using("bars_day", f"""SELECT ticker, n, {r('p', 6)} AS phi, {r('t', 6)} AS theta, {r('(ww - p * aw - t * ew) / n', 0)} AS sigma2 FROM
  (SELECT *, (aw * ee - ew * ae) / (aa * ee - ae * ae) AS p, (ew * aa - aw * ae) / (aa * ee - ae * ae) AS t FROM
  (SELECT ticker, count(*) AS n, sum(a * a) AS aa, sum(a * e1) AS ae, sum(e1 * e1) AS ee, sum(a * w) AS aw, sum(e1 * w) AS ew, sum(w * w) AS ww
  FROM (SELECT *, lag(e) {W} AS e1 FROM shock) WHERE e1 IS NOT NULL GROUP BY ticker))""",
  f"s0 AS (SELECT ticker, ts, close - lag(close) {W} - lag(close, 12) {W} + lag(close, 13) {W} AS w FROM bars_day)",
  f"s1 AS (SELECT *, lag(w) {W} AS a, lag(w, 2) {W} AS b FROM s0)",
  "g AS (SELECT ticker, sum(a * a) AS aa, sum(a * b) AS ab, sum(b * b) AS bb, sum(a * w) AS aw, sum(b * w) AS bw FROM s1 WHERE b IS NOT NULL GROUP BY ticker)",
  """shock AS (SELECT ticker, ts, w, a, w - a * (aw * bb - bw * ab) / (aa * bb - ab * ab) - b * (bw * aa - aw * ab) / (aa * bb - ab * ab) AS e
  FROM (SELECT s1.ticker, ts, w, a, b FROM s1 WHERE b IS NOT NULL) JOIN g USING (ticker))"""))
def m17_arma(spark, sf):
    f = M.arma_fit(bars_day(spark, sf), lags=[1], ma_lags=[1], long_lags=[1, 2])
    return f.select("ticker", "n", rnd(F.col("coef")[0], 6).alias("phi"), rnd(F.col("coef")[1], 6).alias("theta"), rnd("sigma2", 0).alias("sigma2"))


TREES, DEPTH, ROUNDS, ROUND_DEPTH, HORIZON = 8, 4, 4, 2, 12


def _lag_rows(source: str, by: str = "ticker") -> str:
    lags = ", ".join(f"lag(close, {i}) OVER (PARTITION BY {by} ORDER BY ts) AS lag_{i}" for i in range(1, 6))
    return f"SELECT * FROM (SELECT *, {lags} FROM {source}) WHERE lag_5 IS NOT NULL"


def _binned(value: str) -> str:
    return f"CASE WHEN hi > lo THEN greatest(0, least({B.BINS - 1}, floor(({value} - lo) / (hi - lo) * {B.BINS}))) ELSE 0 END"


def _prepared(rows: str, out: str, by: str) -> list[str]:
    """Bins and units of the training rows of keys with at least 30 of them."""
    lags = ", ".join(f"lag_{i}" for i in range(1, 6))
    bins = ", ".join(f"CAST({_binned(f'lag_{i}')} AS INTEGER)" for i in range(1, 6))
    return [
        f"{out}_r AS MATERIALIZED (SELECT {by}, min(least({lags}, close)) AS lo, max(greatest({lags}, close)) AS hi FROM {rows} GROUP BY {by} HAVING count(*) >= {M.MIN_ROWS})",
        f"""{out}_b AS MATERIALIZED (SELECT {by}, ts, [{bins}] AS b, CASE WHEN hi > lo THEN CAST(floor((close - lo) / (hi - lo) * {B.UNITS} + 0.5) AS BIGINT) ELSE 0 END AS y
        FROM {rows} JOIN {out}_r USING ({by}))"""]


def _grown(pos: str, out: str, by: str, depth: int, penalty: float = 0.0, rate: float = 1.0) -> list[str]:
    """Trees over ``pos`` (by, id columns, tree, w, q, b), nodes numbered as in a heap; leaves of all rows and their values."""
    key, parts, now = f"{by}, tree, node", [], f"{out}_p0"
    parts.append(f"{now} AS MATERIALIZED (SELECT *, 1 AS node FROM {pos})")

    def score(s: str, w: str) -> str:
        return f"CAST({s} AS DOUBLE) * CAST({s} AS DOUBLE) / ({w} + {penalty})"

    for d in range(depth):
        parts += [
            f"{out}_c{d} AS (SELECT {key}, f, b[f + 1] AS cut, sum(w) AS w, sum(w * q) AS s FROM {now}, range(0, 5) t(f) WHERE w > 0 GROUP BY ALL)",
            f"""{out}_u{d} AS (SELECT {key}, f, cut, sum(w) OVER o AS lw, sum(s) OVER o AS ls, sum(w) OVER a AS w, sum(s) OVER a AS s FROM {out}_c{d}
            WINDOW a AS (PARTITION BY {key}, f), o AS (PARTITION BY {key}, f ORDER BY cut))""",
            f"""{out}_s{d} AS MATERIALIZED (SELECT {key}, f, cut FROM (SELECT *, {score("s", "w")} AS whole,
            {score("ls", "lw")} + {score("(s - ls)", "(w - lw)")} - {score("s", "w")} AS gain FROM {out}_u{d} WHERE lw < w)
            WHERE gain > whole * 1e-10 + 1e-6 QUALIFY row_number() OVER (PARTITION BY {key} ORDER BY gain DESC, f, cut) = 1)""",
            f"""{out}_p{d + 1} AS MATERIALIZED (SELECT p.* EXCLUDE (node), CASE WHEN x.f IS NULL THEN p.node ELSE 2 * p.node + CASE WHEN p.b[x.f + 1] > x.cut THEN 1 ELSE 0 END END AS node
            FROM {now} p LEFT JOIN {out}_s{d} x USING ({key}))"""]
        now = f"{out}_p{d + 1}"
    splits = " UNION ALL ".join(f"SELECT * FROM {out}_s{d}" for d in range(depth))
    return [*parts, f"{out}_leaf AS MATERIALIZED (SELECT {key}, CAST(sum(w * q) AS DOUBLE) / (sum(w) + {penalty}) * {rate} AS value FROM {now} WHERE w > 0 GROUP BY ALL)",
            f"{out}_split AS MATERIALIZED ({splits})", f"{out}_at AS MATERIALIZED (SELECT * FROM {now})"]


def _forest(rows: str, out: str, by: str = "ticker", trees: int = TREES, depth: int = DEPTH) -> list[str]:
    text = ", ".join(f"CAST({k.strip()} AS VARCHAR)" for k in by.split(","))
    hashed = f"substring(md5(concat_ws('|', '42', {text}, CAST(CAST(epoch(ts) AS BIGINT) AS VARCHAR), CAST(tree AS VARCHAR))), 1, 8)"
    weight = " + ".join(f"CAST(h >= '{t}' AS INTEGER)" for t in B.POISSON)
    return [*_prepared(rows, out, by),
            f"{out}_w AS MATERIALIZED (SELECT *, {weight} AS w, y AS q FROM (SELECT *, {hashed} AS h FROM {out}_b, range(0, {trees}) t(tree)))",
            *_grown(f"(SELECT {by}, ts, b, tree, w, q FROM {out}_w)", out, by, depth)]


def _boosted(rows: str, out: str, by: str = "ticker", rounds: int = ROUNDS, depth: int = ROUND_DEPTH) -> list[str]:
    parts = [*_prepared(rows, out, by), f"{out}_m AS (SELECT {by}, sum(y) / count(*) AS base FROM {out}_b GROUP BY {by})",
             f"{out}_f0 AS MATERIALIZED (SELECT *, base AS f FROM {out}_b JOIN {out}_m USING ({by}))"]
    for t in range(rounds):
        one = f"{out}_t{t}"
        parts += _grown(f"(SELECT {by}, ts, b, {t} AS tree, 1 AS w, CAST(floor(y - f + 0.5) AS BIGINT) AS q FROM {out}_f{t})", one, by, depth, B.PENALTY, B.RATE)
        parts.append(f"""{out}_f{t + 1} AS MATERIALIZED (SELECT x.* EXCLUDE (f), x.f + value AS f FROM {out}_f{t} x JOIN {one}_at USING ({by}, ts)
          JOIN {one}_leaf USING ({by}, tree, node))""")
    return [*parts, *[f"{out}_{x} AS MATERIALIZED ({' UNION ALL '.join(f'SELECT * FROM {out}_t{t}_{x}' for t in range(rounds))})" for x in ("split", "leaf")]]


def _walked(rows: str, model: str, out: str, by: str, depth: int, trees: int, boosted: bool) -> list[str]:
    """``predicted`` for rows (by, ts, lags) by the trees of a model."""
    bins = ", ".join(f"CAST({_binned(f'lag_{i}')} AS INTEGER)" for i in range(1, 6))
    parts = [f"{out}_0 AS MATERIALIZED (SELECT x.*, lo, hi, [{bins}] AS b, tree, 1 AS node FROM {rows} x JOIN {model}_r USING ({by}), range(0, {trees}) t(tree))"]
    for d in range(depth):
        parts.append(f"""{out}_{d + 1} AS MATERIALIZED (SELECT p.* EXCLUDE (node), CASE WHEN x.f IS NULL THEN p.node ELSE 2 * p.node + CASE WHEN p.b[x.f + 1] > x.cut THEN 1 ELSE 0 END END AS node
          FROM {out}_{d} p LEFT JOIN {model}_split x USING ({by}, tree, node))""")
    units = f"any_value(base) + sum(value)" if boosted else f"sum(value) / {trees}"
    base = f"JOIN {model}_m USING ({by})" if boosted else ""
    return [*parts, f"""{out} AS MATERIALIZED (SELECT {by}, ts, any_value(close) AS close, any_value(lo) + ({units}) / {B.UNITS} * (any_value(hi) - any_value(lo)) AS predicted
      FROM {out}_{depth} JOIN {model}_leaf USING ({by}, tree, node) {base} GROUP BY {by}, ts)"""]


_ROWS = f"x AS MATERIALIZED ({_lag_rows('bars_day')})"
_PREDICTED = f"SELECT ticker, {DAY}, {r('close', 2)} AS close, {r('predicted', 2)} AS predicted FROM out"


def _lagged(spark, sf):
    return checkpointed(M.lag_rows(bars_day(spark, sf).select("ticker", "ts", "close")))


@query("m10_random_forest", using("bars_day", _PREDICTED, _ROWS, *_forest("x", "fo"), *_walked("x", "fo", "out", "ticker", DEPTH, TREES, False)))
def m10(spark, sf):
    rows = _lagged(spark, sf)
    model = M.tree_fit(rows, "random_forest", TREES, DEPTH)
    return M.tree_onestep(model, rows).select("ticker", day(), *rounded(["close", "predicted"], 2))


@query("m10_forest_rules", using("bars_day", f"SELECT ticker, count(*) - 5 AS predicted, true AS within_range FROM bars_day GROUP BY ticker HAVING count(*) - 5 >= {M.MIN_ROWS}"))
def m10_rules(spark, sf):
    """A forest averages labels, so its predictions lie within the range of the ticker's labels; every row with five lags has one."""
    rows = _lagged(spark, sf)
    d = M.tree_onestep(M.tree_fit(rows, "random_forest", TREES, DEPTH), rows)
    d = d.join(rows.groupBy("ticker").agg(F.min("label").alias("low"), F.max("label").alias("high")), "ticker")
    inside = F.col("predicted").between(F.col("low") - 1e-2, F.col("high") + 1e-2)
    return d.groupBy("ticker").agg(F.count(F.lit(1)).alias("predicted"), F.bool_and(inside).alias("within_range"))


@query("m11_boosted_trees", using("bars_day", _PREDICTED, _ROWS, *_boosted("x", "bo"), *_walked("x", "bo", "out", "ticker", ROUND_DEPTH, ROUNDS, True)))
def m11(spark, sf):
    rows = _lagged(spark, sf)
    model = M.tree_fit(rows, "boosted_trees", ROUNDS, ROUND_DEPTH)
    return M.tree_onestep(model, rows).select("ticker", day(), *rounded(["close", "predicted"], 2))


def _path(model: str, depth: int, trees: int, h: int) -> list[str]:
    """One row per ticker, its newest values walking the trees ``h`` times."""
    newest = ", ".join(["close AS lag_1", *[f"lag_{i - 1} AS lag_{i}" for i in range(2, 6)]])
    parts = [f"s0 AS (SELECT ticker, ts, 0.0 AS close, {newest} FROM x QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY ts DESC) = 1)"]
    for k in range(h):
        shifted = ", ".join([f"w{k}.predicted AS lag_1", *[f"s{k}.lag_{i - 1} AS lag_{i}" for i in range(2, 6)]])
        parts += [*_walked(f"s{k}", model, f"w{k}", "ticker", depth, trees, False),
                  f"s{k + 1} AS MATERIALIZED (SELECT ticker, s{k}.ts, 0.0 AS close, {shifted} FROM s{k} JOIN w{k} USING (ticker))"]
    return [*parts, "out AS (" + " UNION ALL ".join(f"SELECT ticker, {k + 1} AS step, predicted FROM w{k}" for k in range(h)) + ")"]


@query("m12_recursive_forecast", using("bars_day", f"SELECT ticker, 'random_forest' AS model, CAST(step AS INTEGER) AS step, {r('predicted', 2)} AS forecast FROM out",
                                       _ROWS, *_forest("x", "fo"), *_path("fo", DEPTH, TREES, HORIZON)))
def m12(spark, sf):
    b = checkpointed(bars_day(spark, sf).select("ticker", "ts", "close"))
    model = M.tree_fit(M.lag_rows(b), "random_forest", TREES, DEPTH)
    f = M.recursive_forecast(model, b, HORIZON, name="random_forest")
    return f.select("ticker", "model", "step", rnd("forecast", 2).alias("forecast"))


def _tree_models():
    return {"random_forest": M.tree_model("random_forest", trees=TREES, depth=DEPTH),
            "boosted_trees": M.tree_model("boosted_trees", trees=ROUNDS, depth=ROUND_DEPTH)}


def _default_models():
    return {"ar": M.ar_model(), "seasonal_ar": M.ar_model(lags=M.SEASONAL_LAGS, season=M.SEASON), **_tree_models()}


@query("m14_compare_models")
def m14(spark, sf):
    d, failed = M.compare_models(bars_day(spark, sf), _default_models())
    return d.withColumn("failed", F.lit("; ".join(f"{k}: {v}" for k, v in sorted(failed.items())))).select(
        "failed", "ticker", "model", "best", *rounded(["rmse", "mae", "mape", "r2", "direction_accuracy"], 3))


_HELD_OUT = ["n AS (SELECT ticker, ts, close, row_number() OVER (PARTITION BY ticker ORDER BY ts) AS i, count(*) OVER (PARTITION BY ticker) AS n FROM bars_day)",
             f"x AS MATERIALIZED ({_lag_rows('n')})", "tr AS MATERIALIZED (SELECT * FROM x WHERE i <= floor(n * 0.8))"]
_ERRORS = f"{r('sqrt(avg((close - predicted) ** 2))', 3)} AS rmse, {r('avg(abs(close - predicted))', 3)} AS mae"


@query("m14_trees", using("bars_day", f"""SELECT ticker, model, row_number() OVER (PARTITION BY ticker ORDER BY sq, model) = 1 AS best, rmse, mae FROM
  (SELECT ticker, model, sqrt(avg((close - predicted) ** 2)) AS sq, {_ERRORS} FROM
  (SELECT 'random_forest' AS model, * FROM fout UNION ALL SELECT 'boosted_trees', * FROM bout) JOIN n USING (ticker, ts, close) WHERE i > floor(n * 0.8) GROUP BY ticker, model)""",
                          *_HELD_OUT, *_forest("tr", "fo"), *_walked("x", "fo", "fout", "ticker", DEPTH, TREES, False),
                          *_boosted("tr", "bo"), *_walked("x", "bo", "bout", "ticker", ROUND_DEPTH, ROUNDS, True)))
def m14_trees(spark, sf):
    d, _ = M.compare_models(bars_day(spark, sf), _tree_models())
    return d.select("ticker", "model", "best", *rounded(["rmse", "mae"], 3))


_SPLIT = ["s AS (SELECT ticker, ts, close, row_number() OVER (PARTITION BY ticker ORDER BY ts) AS i, count(*) OVER (PARTITION BY ticker) AS n FROM bars_month)",
          "train AS (SELECT * FROM s WHERE i <= floor(n * 0.8))", *_fit2("train"),
          f"t AS (SELECT ticker, arg_max(close, ts) AS y1, arg_max(l1, ts) AS y2, arg_max(l2, ts) AS y3 FROM (SELECT ticker, ts, close, lag(close) {W} AS l1, lag(close, 2) {W} AS l2 FROM train) GROUP BY ticker)",
          """path AS (SELECT ticker, 0 AS step, p1, p2, y1, y2, y3 FROM t JOIN fit USING (ticker) UNION ALL
          SELECT ticker, step + 1, p1, p2, (1 + p1) * y1 + (p2 - p1) * y2 - p2 * y3, y1, y2 FROM path WHERE step < 30)"""]


@query("m14_multistep", using("bars_month", f"""SELECT ticker, 'ar2' AS model, true AS best, {r('sqrt(avg((close - y1) ** 2))', 3)} AS rmse, {r('avg(abs(close - y1))', 3)} AS mae
  FROM s JOIN path USING (ticker) WHERE i > floor(n * 0.8) AND step = i - floor(n * 0.8) GROUP BY ticker""", *_SPLIT, recursive=True))
def m14_multistep(spark, sf):
    d, _ = M.compare_models(bars_month(spark, sf), {"ar2": M.ar_path_model(lags=[1, 2], every="1mo")}, every="1mo")
    return d.select("ticker", "model", "best", *rounded(["rmse", "mae"], 3))


@query("m15_cross_validate")
def m15(spark, sf):
    d, failed = M.cross_validate(bars_day(spark, sf), 5, _default_models())
    return d.withColumn("failed", F.lit("; ".join(f"{k}: {v}" for k, v in sorted(failed.items())))).select(
        "ticker", "model", "best", "folds", "failed", *rounded(["mean_rmse", "std_rmse", "mean_mae", "mean_mape"], 3))


_FOLD_ROWS = [_FOLDS[0], _FOLDS[1], f"x AS MATERIALIZED ({_lag_rows('(SELECT * FROM ff WHERE i < n - (5 - fold) * size + size)', 'ticker, fold')})",
              "tr AS MATERIALIZED (SELECT * FROM x WHERE i < n - (5 - fold) * size)"]


@query("m15_trees", using("bars_day", f"""SELECT ticker, model, count(*) AS folds, {r('avg(e)', 3)} AS mean_rmse, {r('avg(a)', 3)} AS mean_mae FROM
  (SELECT ticker, fold, model, sqrt(avg((close - predicted) ** 2)) AS e, avg(abs(close - predicted)) AS a FROM
  (SELECT 'random_forest' AS model, * FROM fout UNION ALL SELECT 'boosted_trees', * FROM bout) JOIN ff USING (ticker, fold, ts, close)
  WHERE i >= n - (5 - fold) * size GROUP BY ticker, fold, model) GROUP BY ticker, model""",
                          *_FOLD_ROWS, *_forest("tr", "fo", "ticker, fold"), *_walked("x", "fo", "fout", "ticker, fold", DEPTH, TREES, False),
                          *_boosted("tr", "bo", "ticker, fold"), *_walked("x", "bo", "bout", "ticker, fold", ROUND_DEPTH, ROUNDS, True)))
def m15_trees(spark, sf):
    d, _ = M.cross_validate(bars_day(spark, sf), 5, _tree_models())
    return d.select("ticker", "model", "folds", *rounded(["mean_rmse", "mean_mae"], 3))
