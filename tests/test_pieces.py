"""Series operators over many small chunks and blocks, against pandas."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tickloom.operators import quality as Q
from tickloom.operators import series as S
from tickloom.operators.core import carry_last, latest_n, number_rows, running_sum, spread_lists

pytestmark = pytest.mark.usefixtures("small_pieces")


def series(rows=90, seed=1):
    """Two tickers with missing days, one of them much longer, and null values in ``gappy``."""
    rng = np.random.default_rng(seed)
    parts = []
    for ticker, n in (("A", rows), ("B", 9)):
        days = np.sort(rng.choice(rows * 2, n, replace=False))
        close = np.round(100 + np.cumsum(rng.normal(0, 1, n)), 2)
        gappy = np.where(rng.random(n) < 0.6, np.nan, close)
        parts.append(pd.DataFrame({"ticker": ticker, "ts": pd.Timestamp("2020-01-01") + pd.to_timedelta(days, "D"),
                                   "close": close, "gappy": gappy}))
    return pd.concat(parts, ignore_index=True)


@pytest.fixture
def pdf():
    return series()


@pytest.fixture
def df(spark, pdf):
    d = spark.createDataFrame(pdf).withColumn("ts", F.col("ts").cast("timestamp"))
    return d.withColumn("gappy", F.when(~F.isnan("gappy"), F.col("gappy"))).repartition(3)


def got(d, col):
    return d.select("ticker", "ts", col).toPandas().sort_values(["ticker", "ts"])[col].astype(float).to_numpy()


def want(pdf, fn, col="close"):
    return np.concatenate([fn(g.set_index("ts")[col]).to_numpy(dtype=float) for _, g in pdf.groupby("ticker")])


def same(a, b, tol=1e-9):
    np.testing.assert_allclose(a, b, rtol=tol, atol=tol, equal_nan=True)


def test_positions(df, pdf):
    d = number_rows(df)
    same(got(d, "_i"), np.concatenate([np.arange(len(g)) for _, g in pdf.groupby("ticker")]))
    same(got(d, "_n"), np.concatenate([np.full(len(g), len(g)) for _, g in pdf.groupby("ticker")]))


@pytest.mark.parametrize("n", [2, 7, 20])
def test_sma(df, pdf, n):
    same(got(S.sma(df, {"close": [n]}), f"close_sma_{n}"), want(pdf, lambda s: s.rolling(n).mean()))


def test_sma_with_nulls(df, pdf):
    same(got(S.sma(df, {"gappy": [2]}), "gappy_sma_2"), want(pdf, lambda s: s.rolling(2).mean(), "gappy"))


def test_returns_and_lags(df, pdf):
    same(got(S.pct_change(df), "ret"), want(pdf, lambda s: s.pct_change()))
    same(got(S.diff(df), "diff"), want(pdf, lambda s: s.diff()))
    d = S.lag_features(df, "close", 5)
    expected = want(pdf, lambda s: s.shift(5))
    same(got(d, "lag_5"), expected[~np.isnan(expected)])


@pytest.mark.parametrize("population", [False, True])
def test_rolling_vol(df, pdf, population):
    d = S.rolling_vol(df, n=6, population=population, periods=252, percent=True)
    same(got(d, "vol"), want(pdf, lambda s: s.pct_change().rolling(6).std(ddof=0 if population else 1) * np.sqrt(252) * 100), 1e-7)


def rsi(s, n=14):
    change = s.diff()
    up, down = change.clip(lower=0).rolling(n).mean(), (-change.clip(upper=0)).rolling(n).mean()
    return 100 - 100 / (1 + up / down)


def test_rsi(df, pdf):
    same(got(S.rsi(df), "rsi"), want(pdf, rsi))


@pytest.mark.parametrize("span", [1, 2, 5, 12])
def test_ema(df, pdf, span):
    same(got(S.ema(df, span=span), f"ema_{span}"), want(pdf, lambda s: s.ewm(span=span, adjust=False).mean()))


@pytest.mark.parametrize("span", [2, 5, 26])
def test_ema_with_gaps(df, pdf, span):
    same(got(S.ema(df, "gappy", span=span), f"ema_{span}"), want(pdf, lambda s: s.ewm(span=span, adjust=False).mean(), "gappy"))


def test_macd_with_long_gaps(spark):
    pdf = series(9000, seed=9)
    r = np.random.default_rng(1)
    hole = r.random(len(pdf)) < 0.6
    hole[:50] = hole[4000:4300] = True
    pdf["close"] = pdf["close"].where(~hole)
    df = spark.createDataFrame(pdf.drop(columns="gappy")).withColumn("ts", F.col("ts").cast("timestamp"))
    df = df.withColumn("close", F.when(~F.isnan("close"), F.col("close")))
    d = S.run_steps(df, [S.macd_step("close")])
    def line(s):
        return s.ewm(span=12, adjust=False).mean() - s.ewm(span=26, adjust=False).mean()
    same(got(d, "macd"), want(pdf, line), 1e-9)
    same(got(d, "signal_line"), want(pdf, lambda s: line(s).ewm(span=9, adjust=False).mean()), 1e-9)


def test_ema_over_many_blocks_and_segments(spark, monkeypatch):
    monkeypatch.setattr(S, "SEGMENT", 8.0)  # short segments: their ends must be carried on exactly
    monkeypatch.setattr(S, "FORGET", 60.0)
    pdf = series(3000, seed=5)
    df = spark.createDataFrame(pdf.drop(columns="gappy")).withColumn("ts", F.col("ts").cast("timestamp"))
    a = got(S.ema(df, span=3), "ema_3")
    # with segments this short the part before the last segment is cut at 3e-4 of its weight
    same(a, want(pdf, lambda s: s.ewm(span=3, adjust=False).mean()), 2e-3)


def test_ema_long_series(spark):
    pdf = series(6000, seed=7)
    df = spark.createDataFrame(pdf.drop(columns="gappy")).withColumn("ts", F.col("ts").cast("timestamp"))
    d = S.run_steps(df, [S.ema_step("close", 12), S.ema_step("close", 200), S.macd_step("close")])
    same(got(d, "ema_12"), want(pdf, lambda s: s.ewm(span=12, adjust=False).mean()), 1e-10)
    same(got(d, "ema_200"), want(pdf, lambda s: s.ewm(span=200, adjust=False).mean()), 1e-10)
    line = lambda s: s.ewm(span=12, adjust=False).mean() - s.ewm(span=26, adjust=False).mean()
    same(got(d, "macd"), want(pdf, line), 1e-8)
    same(got(d, "signal_line"), want(pdf, lambda s: line(s).ewm(span=9, adjust=False).mean()), 1e-8)
    same(got(d, "hist"), got(d, "macd") - got(d, "signal_line"))


def test_fills(df, pdf):
    same(got(Q.ffill(df, ["gappy"]), "gappy"), want(pdf, lambda s: s.ffill(), "gappy"))
    same(got(Q.bfill(df, ["gappy"]), "gappy"), want(pdf, lambda s: s.bfill(), "gappy"))


def test_interpolate(df, pdf):
    same(got(Q.interpolate(df, ["gappy"]), "gappy"),
         want(pdf, lambda s: s.reset_index(drop=True).interpolate(limit_direction="both"), "gappy"))


def test_carry_strict(df, pdf):
    d = carry_last(df, {"before": F.col("close")}, strict=True)
    same(got(d, "before"), want(pdf, lambda s: s.shift(1)))


def test_running_sum(df, pdf):
    same(got(running_sum(df, {"total": F.col("close")}), "total"), want(pdf, lambda s: s.cumsum()))


def state_machine(g, threshold):
    """Plain loop: enter at a BUY while flat, leave at a SELL while long."""
    change, entry, out = g["close"].pct_change(), None, []
    for (_, row), c in zip(g.iterrows(), change):
        if c > threshold and entry is None:
            entry = row
        elif c < -threshold and entry is not None:
            out.append((row["ticker"], entry["ts"], row["ts"], entry["close"], row["close"]))
            entry = None
    return out


def test_trades_match_the_loop(df, pdf):
    trades = S.trade_pairs(S.threshold_signal(df, threshold=0.004))
    rows = trades.select("ticker", "entry_ts", "exit_ts", "entry_price", "exit_price").toPandas()
    expected = [t for _, g in pdf.groupby("ticker") for t in state_machine(g, 0.004)]
    assert len(expected) > 8
    assert sorted(rows.itertuples(index=False, name=None)) == sorted(expected)


def test_split_and_folds(df, pdf):
    parts = S.train_test_split(df, 0.2).groupBy("ticker", "part").count().toPandas()
    counts = {(r.ticker, r.part): r["count"] for _, r in parts.iterrows()}
    assert counts[("A", "train")] == int(90 * 0.8) and counts[("B", "train")] == int(9 * 0.8)
    folds = S.ts_folds(df, 4).where("ticker = 'A' AND part = 'test'").groupBy("fold").count().toPandas()
    assert set(folds["count"]) == {90 // 5}


def test_downsample_keeps_every_kth(df):
    assert S.downsample(df, 20).where("ticker = 'A'").count() == len(range(0, 90, -(-90 // 20)))


def test_latest_n(df):
    assert latest_n(df, 4).groupBy("ticker").count().toPandas()["count"].tolist() == [4, 4]


def test_big_groups_are_spread_over_lists(spark):
    d = spark.range(2500).selectExpr("CASE WHEN id < 2400 THEN 'hot' ELSE 'cold' END AS k", "id AS item")
    lists = spread_lists(d, "k", "item", 100).collect()
    hot = [r for r in lists if r["k"] == "hot"]
    assert len(hot) > 20 and max(len(r["items"]) for r in hot) < 300
    assert sorted(i for r in lists for i in r["items"]) == list(range(2500))
