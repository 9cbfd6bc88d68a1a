"""P1-P18 (but P15, P18): repair, scaling and shape queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickloom.functions.dates import day_text
from tickloom.functions.numeric import INF, sanitize, to_number
from tickloom.operators import quality as Q
from tickloom.plans.registry import DAY, day, query, r, rnd
from tickloom.plans.views import bars_day, bars_hour, bars_month, gappy, ticks, trades, using

FE = Q.FEATURES
W = "OVER (PARTITION BY ticker ORDER BY ts)"
UP = "OVER (PARTITION BY ticker ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
DOWN = "OVER (PARTITION BY ticker ORDER BY ts DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"


def rounded(cols, digits=4):
    return [rnd(c, digits).alias(c) for c in cols]


def r_all(cols, digits=4):
    return ", ".join(f"{r(c, digits)} AS {c}" for c in cols)


def _fill(c: str, over: str) -> str:
    return f"last_value({c} IGNORE NULLS) {over}"


@query("p1_unify_schema", using("gappy", f"SELECT ticker, {DAY}, {r_all(['open', 'high', 'low', 'close', 'volume'])} FROM filled",
    "raw AS (SELECT ticker, ts, open, high, low, close, 0.0 AS volume FROM gappy)",
    "fwd AS (SELECT ticker, ts, volume, " + ", ".join(f"{_fill(c, UP)} AS {c}" for c in FE[:4]) + " FROM raw)",
    "filled AS (SELECT ticker, ts, volume, " + ", ".join(
        f"coalesce({c}, {_fill(c, DOWN)}) AS {c}" for c in FE[:4]) + " FROM fwd)"))
def p1(spark, sf):
    raw = gappy(spark, sf).select(
        "ticker", "ts", F.col("open").cast("string").alias("Open Price"), F.col("high").alias("High"),
        F.col("low").alias("low"), F.coalesce(F.col("close").cast("string"), F.lit("n/a")).alias("Close"))
    return Q.unify_schema(raw).select("ticker", day(), *rounded(FE))


@query("p2_to_numeric", using("ticks", f"""SELECT ticker, count(*) AS total, count(*) FILTER (x IS NULL) AS bad,
  {r('sum(x)', 2)} AS total_value FROM (SELECT ticker, CASE WHEN event_id % 7 <> 0 THEN price END AS x FROM ticks) GROUP BY ticker"""))
def p2(spark, sf):
    t = ticks(spark, sf).withColumn("text", F.when(F.col("event_id") % 7 == 0, F.lit("x")).otherwise(
        F.col("price").cast("string")))
    x = to_number(F.col("text"))
    return t.groupBy("ticker").agg(F.count(F.lit(1)).alias("total"), F.count_if(x.isNull()).alias("bad"),
                                   rnd(F.sum(x), 2).alias("total_value"))


def _interp_sql(c: str) -> str:
    return f"""coalesce({c}, CASE WHEN {c}_zi > {c}_ai THEN {c}_av + ({c}_zv - {c}_av) * (i - {c}_ai) / ({c}_zi - {c}_ai) END,
    {c}_av, {c}_zv) AS {c}"""


def _interp_ctes(cols, source="gappy") -> list[str]:
    near = ", ".join(
        f"{_fill(f'CASE WHEN {c} IS NOT NULL THEN i END', o)} AS {c}_{p}i, {_fill(c, o)} AS {c}_{p}v"
        for c in cols for p, o in (("a", UP), ("z", DOWN)))
    return [f"pos AS (SELECT *, row_number() {W} - 1 AS i FROM {source})",
            f"near AS (SELECT *, {near} FROM pos)",
            "interp AS (SELECT ticker, ts, " + ", ".join(_interp_sql(c) for c in cols) + " FROM near)"]


@query("p3_interpolate", using("gappy", f"SELECT ticker, {DAY}, {r_all(FE)} FROM interp", *_interp_ctes(FE)))
def p3(spark, sf):
    return Q.interpolate(gappy(spark, sf), FE).select("ticker", day(), *rounded(FE))


_CELLS = " UNION ALL ".join(
    f"SELECT ticker, ts, '{c}' AS feature, {k} AS ord, {c} AS value FROM gappy" for k, c in enumerate(FE))


@query("p3_interpolate_flattened", using("gappy", f"SELECT ticker, {DAY}, feature, {r('value')} AS value FROM out",
    f"cells AS ({_CELLS})",
    "pos AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY ts, ord) AS i FROM cells)",
    """near AS (SELECT *, last_value(CASE WHEN value IS NOT NULL THEN i END IGNORE NULLS) OVER up AS ai, last_value(value IGNORE NULLS) OVER up AS av,
    last_value(CASE WHEN value IS NOT NULL THEN i END IGNORE NULLS) OVER dn AS zi, last_value(value IGNORE NULLS) OVER dn AS zv FROM pos
    WINDOW up AS (PARTITION BY ticker ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
    dn AS (PARTITION BY ticker ORDER BY i DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))""",
    "out AS (SELECT ticker, ts, feature, coalesce(value, CASE WHEN zi > ai THEN av + (zv - av) * (i - ai) / (zi - ai) END, av, zv) AS value FROM near)"))
def p3_flat(spark, sf):
    return Q.interpolate_flattened(gappy(spark, sf)).select("ticker", day(), "feature", rnd("value").alias("value"))


@query("p4_ffill", using("gappy", f"SELECT ticker, {DAY}, " + ", ".join(f"{r(_fill(c, UP))} AS {c}" for c in FE) + " FROM gappy"))
def p4f(spark, sf):
    return Q.ffill(gappy(spark, sf), FE).select("ticker", day(), *rounded(FE))


@query("p4_bfill", using("gappy", f"SELECT ticker, {DAY}, " + ", ".join(f"{r(_fill(c, DOWN))} AS {c}" for c in FE) + " FROM gappy"))
def p4b(spark, sf):
    return Q.bfill(gappy(spark, sf), FE).select("ticker", day(), *rounded(FE))


# here a "ticker" with a hole is a (ticker, month): the rule needs keys that are complete
@query("p5_drop_incomplete", using("gappy", """SELECT ticker, strftime(ts, '%Y-%m') AS month, count(*) AS bars FROM gappy
  GROUP BY ALL HAVING count(*) = count(open) AND count(*) = count(close)"""))
def p5(spark, sf):
    g = gappy(spark, sf).withColumn("month", F.date_format("ts", "yyyy-MM"))
    return Q.drop_incomplete(g, ["open", "close"], ["ticker", "month"]).groupBy("ticker", "month").agg(
        F.count(F.lit(1)).alias("bars"))


_RECENT = "recent AS (SELECT * FROM gappy WHERE CAST(ts AS DATE) IN (SELECT DISTINCT CAST(ts AS DATE) AS d FROM gappy ORDER BY d DESC LIMIT 90))"


@query("p6_restrict_recent_days", using("gappy", f"SELECT ticker, {DAY}, {r('close')} AS close FROM recent", _RECENT))
def p6(spark, sf):
    return Q.restrict_recent_days(gappy(spark, sf), 90).select("ticker", day(), rnd("close").alias("close"))


_MATRIX = [_RECENT, "cells AS (SELECT ticker, strftime(ts, '%Y-%m-%d') AS d, feature, value FROM (" + " UNION ALL ".join(
    f"SELECT ticker, ts, '{c}' AS feature, {c} AS value FROM recent" for c in FE) + "))"]
_KNOWN = [*_MATRIX,
    """k1 AS (SELECT * FROM cells WHERE value IS NOT NULL AND (d, feature) IN (SELECT (d, feature) FROM cells WHERE value IS NOT NULL
    GROUP BY d, feature HAVING count(*) >= floor((SELECT count(DISTINCT ticker) FROM cells) * 0.5)))""",
    """known AS (SELECT * FROM k1 WHERE ticker IN (SELECT ticker FROM k1 GROUP BY ticker
    HAVING count(*) >= floor((SELECT count(*) FROM (SELECT DISTINCT d, feature FROM k1)) * 0.5)))"""]


def matrix(spark, sf):
    recent = Q.restrict_recent_days(gappy(spark, sf), 90)
    return Q.to_cells(recent).withColumn("d", day_text(F.col("ts"))).drop("ts")


@query("p7_drop_sparse", using("gappy", f"SELECT ticker, d, feature, {r('value')} AS value FROM known", *_KNOWN))
def p7(spark, sf):
    return Q.drop_sparse(matrix(spark, sf)).select("ticker", "d", "feature", rnd("value").alias("value"))


@query("p8_fill_sparse", using("gappy", f"""SELECT ticker, d, feature, {r('''coalesce(
  last_value(value IGNORE NULLS) OVER (PARTITION BY d, feature ORDER BY ticker ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
  last_value(value IGNORE NULLS) OVER (PARTITION BY d, feature ORDER BY ticker DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0)''')} AS value
  FROM (SELECT t.ticker, c.d, c.feature, k.value FROM (SELECT DISTINCT ticker FROM known) t, (SELECT DISTINCT d, feature FROM known) c
  LEFT JOIN known k ON k.ticker = t.ticker AND k.d = c.d AND k.feature = c.feature)""", *_KNOWN))
def p8(spark, sf):
    return Q.fill_sparse(Q.drop_sparse(matrix(spark, sf))).select("ticker", "d", "feature", rnd("value").alias("value"))


@query("p9_standard_scale", using("bars_month", f"""SELECT ticker, d, feature, {r('''(value - avg(value) OVER w)
  / CASE WHEN stddev_pop(value) OVER w = 0 THEN 1 ELSE stddev_pop(value) OVER w END''')} AS scaled FROM cells
  WINDOW w AS (PARTITION BY d, feature)""", "cells AS (SELECT ticker, strftime(ts, '%Y-%m-%d') AS d, feature, value FROM (" + " UNION ALL ".join(
    f"SELECT ticker, ts, '{c}' AS feature, {c} AS value FROM bars_month" for c in FE) + "))"))
def p9(spark, sf):
    cells = Q.to_cells(bars_month(spark, sf)).withColumn("d", day_text(F.col("ts")))
    return Q.standard_scale(cells).select("ticker", "d", "feature", rnd("scaled").alias("scaled"))


@query("p10_quality_report", using("gappy", f"""SELECT
  (SELECT count(DISTINCT ticker) FROM gappy) AS tickers_before, (SELECT count(DISTINCT ts) FROM gappy) AS dates_before,
  (SELECT count(DISTINCT ts) FROM recent) AS dates_after,
  (SELECT CAST(sum({' + '.join(f'({c} IS NULL)::INT' for c in FE)}) AS BIGINT) FROM recent) AS missing_before,
  (SELECT CAST(sum({' + '.join(f'({c} IS NULL)::INT' for c in FE)}) AS BIGINT) FROM interp) AS missing_after_interpolation,
  (SELECT count(DISTINCT ticker) FROM interp WHERE ticker NOT IN (SELECT ticker FROM interp WHERE {' OR '.join(f'{c} IS NULL' for c in FE)})) AS tickers_after,
  (SELECT count(DISTINCT ticker) FROM interp WHERE {' OR '.join(f'{c} IS NULL' for c in FE)}) AS tickers_dropped,
  (SELECT CAST(coalesce(sum(cells), 0) AS BIGINT) FROM bare) AS missing_after_fill, (SELECT count(*) FROM bare) AS rows_dropped,
  (SELECT count(*) FROM gappy WHERE ticker IS NULL OR ts IS NULL) AS rows_without_place,
  (SELECT count(DISTINCT ts) * 5 FROM gappy) AS columns_found, (SELECT count(DISTINCT ts) * 5 FROM recent) AS columns_after""",
  _RECENT, *_interp_ctes(FE, "recent"), f"bare AS (SELECT ticker, count(*) * 5 AS cells FROM recent GROUP BY ticker HAVING {' + '.join(f'count({c})' for c in FE)} = 0)"))
def p10(spark, sf):
    return Q.quality_report(gappy(spark, sf), 90)


@query("p11_missing_ranges", using("bars_day", """SELECT ticker, strftime(min(d), '%Y-%m-%d') AS first_day, strftime(max(d), '%Y-%m-%d') AS last_day
  FROM (SELECT ticker, d, d - CAST(row_number() OVER (PARTITION BY ticker ORDER BY d) AS INTEGER) AS island FROM
  (SELECT t.ticker, CAST(c.d AS DATE) AS d FROM (SELECT DISTINCT ticker FROM bars_day) t,
  generate_series(DATE '1996-01-01', DATE '1997-12-31', INTERVAL 1 DAY) c(d)
  WHERE (t.ticker, CAST(c.d AS DATE)) NOT IN (SELECT (ticker, CAST(ts AS DATE)) FROM bars_day)))
  GROUP BY ticker, island"""))
def p11(spark, sf):
    gaps = Q.missing_ranges(bars_day(spark, sf), "1996-01-01", "1997-12-31")
    return gaps.select("ticker", F.date_format("first_day", "yyyy-MM-dd").alias("first_day"),
                       F.date_format("last_day", "yyyy-MM-dd").alias("last_day"))


@query("p12_flatten", using("bars_month", f"""SELECT t.ticker, strftime(m.ts, '%Y-%m-%d') || '_' || f AS name,
  {r("CASE f WHEN 'close' THEN b.close ELSE b.volume END")} AS value FROM (SELECT DISTINCT ticker FROM bars_month) t, (SELECT DISTINCT ts FROM bars_month) m,
  (SELECT unnest(['close', 'volume']) AS f) LEFT JOIN bars_month b ON b.ticker = t.ticker AND b.ts = m.ts"""))
def p12(spark, sf):
    """All columns of the wide table, as one row for each of its cells."""
    wide = Q.flatten(bars_month(spark, sf).select("ticker", "ts", *rounded(["close", "volume"])), ["close", "volume"])
    return wide.unpivot("ticker", [F.col(f"`{n}`") for n in wide.columns if n != "ticker"], "name", "value")


@query("p12_flatten_hours", using("bars_hour", f"SELECT ticker, strftime(ts, '%Y-%m-%d %H') AS h, {r('close')} AS value FROM bars_hour"))
def p12_hours(spark, sf):
    cells = Q.unflatten(Q.flatten(bars_hour(spark, sf), ["close"])).where(F.col("value").isNotNull())
    return cells.select("ticker", F.date_format("ts", "yyyy-MM-dd HH").alias("h"), rnd("value").alias("value"))


@query("p12_unflatten", using("bars_month", " UNION ALL ".join(
    f"SELECT ticker, {DAY}, '{c}' AS feature, {r(c)} AS value FROM bars_month" for c in ("close", "volume"))))
def p12_back(spark, sf):
    cells = Q.unflatten(Q.flatten(bars_month(spark, sf), ["close", "volume"]))
    return cells.where(F.col("value").isNotNull()).select(
        "ticker", F.date_format("d", "yyyy-MM-dd").alias("d"), "feature", rnd("value").alias("value"))


@query("p13_sanitize", using("ticks", f"""SELECT event_id, CASE event_id % 4 WHEN 0 THEN NULL WHEN 1 THEN NULL ELSE {r('price')} END AS a,
  CASE event_id % 4 WHEN 2 THEN NULL ELSE {r('price')} END AS b FROM ticks"""))
def p13(spark, sf):
    k = F.col("event_id") % 4
    a = F.when(k == 0, F.lit(float("nan"))).when(k == 1, F.lit(INF)).otherwise(F.col("price"))
    b = F.when(k == 2, F.lit(-INF)).otherwise(F.col("price"))
    d = sanitize(ticks(spark, sf).select("event_id", a.alias("a"), F.struct(b.alias("b")).alias("nested")))
    return d.select("event_id", rnd("a").alias("a"), rnd("nested.b").alias("b"))


@query("p14_missing_pct", using("gappy", f"""SELECT ticker, CAST(sum(m) AS BIGINT) AS missing, {r('sum(m) * 100.0 / (count(*) * 5)', 2)} AS missing_pct
  FROM (SELECT ticker, {' + '.join(f'({c} IS NULL)::INT' for c in FE)} AS m FROM gappy) GROUP BY ticker"""))
def p14(spark, sf):
    return Q.missing_pct(gappy(spark, sf)).select("ticker", "missing", rnd("missing_pct", 2).alias("missing_pct"))


def _over(n):
    return f"OVER (PARTITION BY ticker ORDER BY ts ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


_TAIL = "tail AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY ts DESC) AS age FROM bars_day) WHERE age <= 200)"
_CHART = [_TAIL, f"ret AS (SELECT *, close / lag(close) {W} - 1 AS ret FROM tail)",
    "lines AS (" + " UNION ALL ".join(
        [f"SELECT ticker, ts, 'candlestick' AS kind, '{c}' AS name, {c} AS value FROM tail" for c in FE[:4]]
        + ["SELECT ticker, ts, 'volume', 'volume', volume FROM tail"]
        + [f"SELECT ticker, ts, 'ma', 'ma{n}', CASE WHEN count(close) {_over(n)} = {n} THEN avg(close) {_over(n)} END FROM tail" for n in (7, 20, 50)]
        + [f"SELECT ticker, ts, 'volatility', 'volatility', CASE WHEN count(ret) {_over(20)} = 20 THEN stddev_samp(ret) {_over(20)} * sqrt(252) * 100 END FROM ret"]) + ")"]


@query("p16_chart_series", using("bars_day", f"SELECT kind, ticker, {DAY}, name, {r('value')} AS value FROM lines WHERE value IS NOT NULL", *_CHART))
def p16(spark, sf):
    b = bars_day(spark, sf)
    out = None
    for kind in ("candlestick", "volume", "ma", "volatility"):
        part = Q.chart_series(b, kind, 200).select(F.lit(kind).alias("kind"), "ticker", day(), "name", rnd("value").alias("value"))
        out = part if out is None else out.unionByName(part)
    return out


@query("p16_chart_points", using("bars_day", "SELECT kind, ticker, count(*) AS points FROM lines WHERE value IS NOT NULL GROUP BY kind, ticker", *_CHART))
def p16_points(spark, sf):
    b = bars_day(spark, sf)
    out = None
    for kind in ("candlestick", "volume", "ma", "volatility"):
        part = Q.chart_points(Q.chart_series(b, kind, 200)).withColumn("kind", F.lit(kind))
        out = part if out is None else out.unionByName(part)
    return out.select("kind", "ticker", "points")


@query("p16_temporal", using("bars_day", " UNION ALL ".join(
    f"SELECT ticker, {DAY}, '{c}' AS name, {r(c)} AS value FROM newest WHERE {c} IS NOT NULL" for c in FE),
    "newest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY ts DESC) AS age FROM bars_day) WHERE age <= 200)"))
def p16_temporal(spark, sf):
    return Q.chart_series(bars_day(spark, sf), "temporal", 200).select("ticker", day(), "name", rnd("value").alias("value"))


@query("p17_valid_ticker", using("trades", """SELECT ticker, count(*) AS n FROM trades
  WHERE l_linenumber NOT IN (1, 2) GROUP BY ticker"""))
def p17(spark, sf):
    k = F.col("l_linenumber")
    messy = F.when(k == 1, F.lit("  ")).when(k == 2, F.lit("NaN")).otherwise(F.concat(F.lit(" "), F.col("ticker"), F.lit("  ")))
    return Q.valid_ticker(trades(spark, sf).withColumn("ticker", messy)).groupBy("ticker").agg(F.count(F.lit(1)).alias("n"))
