"""Trees, linkage and moving averages against plain NumPy."""

import numpy as np
import pandas as pd
import pytest
from test_models import frame, walk

from tickloom.operators import cluster as C
from tickloom.operators import forecast as M
from tickloom.operators import trees as B

BINS = 16


def binned(x, y):
    lo, hi = min(x.min(), y.min()), max(x.max(), y.max())
    place = np.clip(np.floor((x - lo) / (hi - lo) * BINS), 0, BINS - 1).astype(int)
    return place, np.floor((y - lo) / (hi - lo) * B.UNITS + 0.5), lo, hi


def grown(b, q, depth, penalty, rate, least=1):
    """The value that a tree gives each row."""
    def leaf():
        return np.full(len(q), q.sum() / (len(q) + penalty) * rate)

    if depth == 0:
        return leaf()
    whole, best = q.sum() ** 2 / (len(q) + penalty), None
    for f in range(b.shape[1]):
        for c in np.unique(b[:, f])[:-1]:
            left = b[:, f] <= c
            if min(left.sum(), (~left).sum()) < least:
                continue
            gain = q[left].sum() ** 2 / (left.sum() + penalty) + q[~left].sum() ** 2 / ((~left).sum() + penalty) - whole
            if gain > whole * 1e-10 + 1e-6 and (best is None or gain > best[0]):
                best = gain, left
    if best is None:
        return leaf()
    out, left = np.zeros(len(q)), best[1]
    out[left] = grown(b[left], q[left], depth - 1, penalty, rate, least)
    out[~left] = grown(b[~left], q[~left], depth - 1, penalty, rate, least)
    return out


def by_ticker(pdf):
    for t, g in pdf.groupby("ticker"):
        y = g["close"].to_numpy()
        yield t, np.column_stack([y[5 - i:len(y) - i] for i in range(1, 6)]), y[5:]


@pytest.mark.parametrize("depth,least", [(1, 1), (2, 1), (4, 5)])
@pytest.mark.parametrize("small", [B.SMALL, 0])
def test_a_tree_like_numpy(spark, monkeypatch, depth, least, small):
    monkeypatch.setattr(B, "SMALL", small)
    pdf, df = walk(spark, 90)
    rows = M.lag_rows(df)
    model = M.tree_fit(rows, trees=1, depth=depth, bins=BINS, min_leaf=least, bootstrap=False)
    got = {(r.ticker, round(r.close, 9)): r.predicted for r in M.tree_onestep(model, rows).collect()}
    for t, x, y in by_ticker(pdf):
        b, q, lo, hi = binned(x, y)
        want = lo + grown(b, q, depth, 0, 1, least) / B.UNITS * (hi - lo)
        np.testing.assert_allclose([got[t, round(v, 9)] for v in y], want, rtol=1e-9)


def test_boosted_trees_like_numpy(spark):
    pdf, df = walk(spark, 60)
    rows = M.lag_rows(df)
    model = M.tree_fit(rows, "boosted_trees", trees=3, depth=2, bins=BINS)
    got = {(r.ticker, round(r.close, 9)): r.predicted for r in M.tree_onestep(model, rows).collect()}
    for t, x, y in by_ticker(pdf):
        b, q, lo, hi = binned(x, y)
        f = np.full(len(q), q.mean())
        for _ in range(3):
            f = f + grown(b, np.floor(q - f + 0.5), 2, B.PENALTY, B.RATE)
        np.testing.assert_allclose([got[t, round(v, 9)] for v in y], lo + f / B.UNITS * (hi - lo), rtol=1e-9)


def test_a_flat_ticker_predicts_its_price(spark):
    pdf = pd.DataFrame({"ticker": "A", "ts": pd.date_range("2020-01-01", periods=50), "close": 7.0})
    df = spark.createDataFrame(pdf)
    model = M.tree_fit(M.lag_rows(df), trees=2, depth=3)
    assert {r.predicted for r in M.tree_onestep(model, M.lag_rows(df)).collect()} == {7.0}
    assert [r.forecast for r in M.recursive_forecast(model, df, 3).collect()] == [7.0] * 3


def linkage(x, k):
    """Joined by the shortest edges, ties by the identifiers, until ``k`` clusters are left."""
    label = list(range(len(x)))
    edges = sorted(((x[i, 0] - x[j, 0]) ** 2 + (x[i, 1] - x[j, 1]) ** 2, i, j) for i in range(len(x)) for j in range(i + 1, len(x)))
    for _, i, j in edges:
        if len(set(label)) <= k:
            break
        a, b = sorted((label[i], label[j]))
        label = [a if v == b else v for v in label]
    return label


@pytest.mark.parametrize("pack", [2048, 4])
def test_linkage_like_brute_force(spark, monkeypatch, pack):
    monkeypatch.setattr(C, "PACK", pack)
    r = np.random.default_rng(8)
    x = np.vstack([r.normal(size=(40, 2)) * 0.3, r.normal(size=(30, 2)) * 0.2 + 4, [[20, 20], [20, 20], [9, -7]], np.mgrid[0:3, 0:3].reshape(2, -1).T + 30.0])
    for k in (3, 6):
        got = {r.entity: r.cluster for r in C.hierarchical(frame(spark, x).drop("cluster"), k).collect()}
        assert [got[i] for i in range(len(x))] == [str(v) for v in linkage(x, k)]


def test_linkage_of_few_and_equal_points(spark):
    same = frame(spark, np.ones((5, 2))).drop("cluster")
    assert len({r.cluster for r in C.hierarchical(same, 2).collect()}) == 2
    assert {r.cluster for r in C.hierarchical(frame(spark, np.eye(2)).drop("cluster"), 4).collect()} == {"0", "1"}
    assert C.hierarchical(same.limit(0), 2).count() == 0


def test_rounds_do_not_multiply_the_planned_size(spark):
    def planned(d):
        return int(d._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())

    line = spark.range(300).selectExpr("id AS a", "id + 1 AS b")
    hung = C.components(line)
    assert {(r.node, r.root) for r in hung.collect()} == {(i, 0) for i in range(1, 301)}
    assert planned(hung) < 1 << 30
    r = np.random.default_rng(8)
    forest = C.spanning_edges(frame(spark, r.normal(size=(60, 2))).drop("cluster"), 1)
    assert forest.count() == 59
    assert planned(forest) < 1 << 30


def test_moving_averages_like_numpy(spark):
    pdf, df = walk(spark, 120, tickers=("A",), seed=5)
    fit = M.arma_fit(df).head()
    y = pdf["close"].to_numpy()
    w = np.full(len(y), np.nan)
    w[13:] = (y[13:] - y[12:-1]) - (y[1:-12] - y[:-13])

    def lagged(v, lags):
        return np.column_stack([np.r_[np.full(k, np.nan), v[:-k]] for k in lags])

    def regress(x, v):
        ok = ~np.isnan(x).any(1) & ~np.isnan(v)
        return np.linalg.lstsq(x[ok], v[ok], rcond=None)[0], ok

    x = lagged(w, M.LONG_LAGS)
    e = w - x @ regress(x, w)[0]
    x = np.column_stack((lagged(w, M.SEASONAL_LAGS), lagged(e, M.MA_LAGS)))
    c, ok = regress(x, w)
    np.testing.assert_allclose(fit.coef, c, rtol=1e-6, atol=1e-9)
    assert fit.n == ok.sum()
    got = [r.forecast for r in M.arma_forecast(M.arma_fit(df), 3).orderBy("step").collect()]
    for _ in range(3):  # shocks to come are 0
        w = np.r_[w, sum(p * w[-k] for p, k in zip(c, M.SEASONAL_LAGS)) + sum(t * e[-k] for t, k in zip(c[3:], M.MA_LAGS))]
        e = np.r_[e, 0.0]
        y = np.r_[y, y[-1] + y[-12] - y[-13] + w[-1]]
    np.testing.assert_allclose(got, y[-3:], rtol=1e-6)
