"""Models, clusters and quantiles against plain NumPy on small tables."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tickloom.operators import cluster as C
from tickloom.operators import forecast as M
from tickloom.operators import stats as A


def walk(spark, n=80, tickers=("A", "B"), seed=2):
    rng = np.random.default_rng(seed)
    pdf = pd.concat([pd.DataFrame({"ticker": t, "ts": pd.date_range("2020-01-01", periods=n),
                                   "close": 100 + np.cumsum(rng.normal(size=n))}) for t in tickers])
    return pdf, spark.createDataFrame(pdf).withColumn("ts", F.col("ts").cast("timestamp"))


def design(y, lags):
    return np.column_stack([y[max(lags) - k:len(y) - k] for k in lags]), y[max(lags):]


def test_ar_fit_is_least_squares(spark):
    pdf, df = walk(spark)
    fits = {r.ticker: r for r in M.ar_fit(df).collect()}
    for t, g in pdf.groupby("ticker"):
        x, y = design(np.diff(g["close"].to_numpy()), M.AR_LAGS)
        phi, *_ = np.linalg.lstsq(x, y, rcond=None)
        np.testing.assert_allclose(fits[t].coef, phi, atol=1e-9)
        assert fits[t].n == len(y) and fits[t].sigma2 == pytest.approx(np.mean((y - x @ phi) ** 2))


def test_forecast_path_and_bounds(spark):
    pdf, df = walk(spark, tickers=("A",))
    fit = M.ar_fit(df)
    phi, s2 = fit.head().coef, fit.head().sigma2
    rows = M.ar_forecast(fit, df, 12).orderBy("step").collect()
    y = pdf["close"].tolist()
    psi = [1.0]
    for _ in range(12):
        z = np.diff(y[-6:])[::-1]
        y.append(y[-1] + float(np.dot(phi, z)))
    ar = [1.0]
    for j in range(1, 12):
        ar.append(sum(phi[i] * ar[j - 1 - i] for i in range(min(5, j))))
    psi = np.cumsum(ar)
    np.testing.assert_allclose([r.forecast for r in rows], y[-12:], rtol=1e-9)
    sd = np.sqrt(s2 * np.cumsum(psi ** 2))
    np.testing.assert_allclose([r.upper - r.forecast for r in rows], M.Z95 * sd, rtol=1e-8)
    assert rows[0].ts > pdf["ts"].max()


def test_seasonal_fit(spark):
    pdf, df = walk(spark, tickers=("A",))
    y = pdf["close"].to_numpy()
    s = y[12:] - y[:-12]
    x, t = design(np.diff(s), M.SEASONAL_LAGS)
    phi, *_ = np.linalg.lstsq(x, t, rcond=None)
    fit = M.seasonal_ar_fit(df)
    np.testing.assert_allclose(fit.head().coef, phi, atol=1e-9)
    got = M.ar_forecast(fit, df, 1, memory=26).head().forecast
    w = np.diff(s)
    assert got == pytest.approx(y[-1] + y[-12] - y[-13] + phi @ [w[-1], w[-12], w[-13]])


def test_one_step_predictions(spark):
    pdf, df = walk(spark, tickers=("A",))
    fit = M.ar_fit(df)
    phi, y = np.array(fit.head().coef), pdf["close"].to_numpy()
    rows = M.ar_onestep(fit, df, 6).orderBy("ts").collect()
    expected = [y[i - 1] + phi @ np.diff(y[i - 6:i])[::-1] for i in range(6, len(y))]
    np.testing.assert_allclose([r.predicted for r in rows], expected)


def test_trees_need_thirty_rows(spark):
    _, df = walk(spark, n=20)
    with pytest.raises(ValueError):
        M.tree_fit(M.lag_rows(df))


def test_a_failing_model_is_reported(spark):
    _, df = walk(spark, n=40, tickers=("A",))

    def broken(train, rows):
        raise RuntimeError("no")
    errors, failed = M.compare_models(df, {"broken": broken, "ar": M.ar_model()})
    assert "broken" in failed and errors.head().best is True


def test_recursive_forecast_uses_its_own_predictions(spark):
    _, df = walk(spark, n=60)
    model = M.tree_fit(M.lag_rows(df), trees=3, depth=3)
    rows = M.recursive_forecast(model, df, 12).collect()
    assert len(rows) == 24 and all(r.forecast is not None for r in rows)


@pytest.mark.parametrize("sketch", [10_000, 50])
def test_quantiles_are_exact(spark, monkeypatch, sketch):
    monkeypatch.setattr(A, "SKETCH", sketch)
    rng = np.random.default_rng(4)
    hot, cold = np.round(rng.lognormal(size=4000), 2), np.array([3.0])
    pdf = pd.DataFrame({"k": ["hot"] * len(hot) + ["cold"], "v": np.concatenate([hot, cold])})
    probs = [0.0, 0.25, 0.5, 0.9, 1.0]
    got = {r.k: list(r)[1:] for r in A.exact_quantiles(spark.createDataFrame(pdf).repartition(5), "k", "v", probs).collect()}
    np.testing.assert_allclose(got["hot"], np.quantile(hot, probs))
    assert got["cold"] == [3.0] * 5


def blobs(seed=0, n=160):
    rng = np.random.default_rng(seed)
    centres = np.array([[0, 0], [3, 0], [0, 4]])
    x = centres[rng.integers(0, 3, n)] + rng.normal(scale=0.45, size=(n, 2))
    return np.vstack([x, [[30.0, 30.0]]])


def frame(spark, x, labels=None):
    rows = [(int(i), [float(v) for v in p], None if labels is None else str(labels[i])) for i, p in enumerate(x)]
    return spark.createDataFrame(rows, "entity bigint, features array<double>, cluster string")


def brute_dbscan(x, eps, m):
    near = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1)) <= eps
    core = near.sum(1) >= m
    label = np.full(len(x), -1)
    for i in range(len(x)):
        if core[i] and label[i] < 0:
            stack = [i]
            while stack:
                j = stack.pop()
                if label[j] < 0:
                    label[j] = i
                    stack += [k for k in np.flatnonzero(near[j]) if core[k]] if core[j] else []
    return near, core, label


@pytest.mark.parametrize("width,m,eps", [(1, 3, 0.02), (3, 4, 0.7), (5, 3, 1.3)])
def test_dbscan_in_more_dimensions(spark, width, m, eps):
    rng = np.random.default_rng(width)
    x = np.concatenate([rng.normal(c, 0.5, (60, width)) for c in (-2, 0.5, 2.5)] + [rng.uniform(-5, 5, (30, width))])
    near, core, label = brute_dbscan(x, eps, m)
    got = {r.entity: r.cluster for r in C.dbscan(frame(spark, x).drop("cluster"), eps, m).collect()}
    assert len(got) == len(x) and 0 < core.sum() < len(x)
    for i in range(len(x)):
        reach = np.flatnonzero(near[i] & core)
        if core[i]:
            assert [got[i] == got[j] for j in np.flatnonzero(core)] == [label[i] == label[j] for j in np.flatnonzero(core)]
        elif len(reach):
            assert got[i] == got[reach[np.argmin(((x[reach] - x[i]) ** 2).sum(1))]]
        else:
            assert got[i] is None


@pytest.mark.parametrize("gap,clusters", [(0.3, 1), (0.55, 2)])
def test_dense_cells_link_without_all_pairs(spark, gap, clusters):
    """Two cells of 10^5 points each, one way within reach of each other and one way just beyond."""
    n = 100_000
    left, right = F.rand(3) * 0.1, F.rand(4) * 0.1 + 0.1 + gap
    pts = spark.range(2 * n).select(F.col("id").alias("entity"), F.array(F.when(F.col("id") < n, left).otherwise(right), F.rand(5) * 0.1).alias("features"))
    got = C.dbscan(pts, 0.5, 4).groupBy("cluster").count().collect()
    assert sorted(r["count"] for r in got) == [2 * n // clusters] * clusters


def test_dbscan_of_nothing(spark):
    assert C.dbscan(spark.createDataFrame([], "entity bigint, features array<double>")).count() == 0


@pytest.mark.parametrize("m,eps", [(2, 0.5), (4, 0.4), (9, 0.5)])
@pytest.mark.parametrize("pack", [2048, 3])
def test_dbscan_against_brute_force(spark, monkeypatch, m, eps, pack):
    monkeypatch.setattr(C, "PACK", pack)
    x = blobs()
    near, core, label = brute_dbscan(x, eps, m)
    got = {r.entity: r.cluster for r in C.dbscan(frame(spark, x).drop("cluster"), eps, m).collect()}
    assert len(got) == len(x)
    for i in range(len(x)):
        reach = near[i] & core
        assert (got[i] is None) == (not reach.any())  # noise is what no core reaches
        if core[i]:
            for j in np.flatnonzero(core):
                assert (got[i] == got[j]) == (label[i] == label[j])
        elif reach.any():  # a border point belongs to its nearest core
            d = np.where(core, np.sqrt(((x - x[i]) ** 2).sum(-1)), np.inf)
            assert got[i] == got[int(d.argmin())]


@pytest.mark.parametrize("block", [None, 1 << 20, 2])
def test_silhouette_against_brute_force(spark, block):
    x = blobs(3, 90)
    labels = np.array([*(np.arange(90) % 3), 9])  # the last cluster has one member
    d = ((x[:, None] - x[None]) ** 2).sum(-1)
    d = np.sqrt(d) if block is None else d
    scores = []
    for i, own in enumerate(labels):
        mine = labels == own
        if mine.sum() == 1:
            scores.append(0.0)
            continue
        a = d[i, mine].sum() / (mine.sum() - 1)
        b = min(d[i, labels == o].mean() for o in set(labels) if o != own)
        scores.append((b - a) / max(a, b))
    each = C.euclidean_silhouette_of(frame(spark, x, labels)) if block is None else C.silhouette_of(frame(spark, x, labels), block)
    np.testing.assert_allclose([r.silhouette for r in each.orderBy("entity").collect()], scores, atol=1e-9)
    assert C.silhouette(frame(spark, x, np.zeros(len(x)))).head()[0] == 0.0


def test_silhouette_distances_are_exact_and_taken_in_tiles(spark, monkeypatch):
    r = np.random.default_rng(4)
    x = np.vstack([r.normal(size=(300, 5)), r.normal(size=(200, 5)) * 1e-7 + 1e5])
    x = np.vstack([x, x[250:350]])  # near points far from the origin, and copies
    labels = r.integers(0, 4, len(x))
    np.testing.assert_allclose(C._apart(x - x.mean(0), x - x.mean(0)), C._distances(x, x), rtol=1e-6, atol=1e-10)

    def pair(i, j, tile):
        packs = [pd.DataFrame({"pack": [k], "block": [k], "ids": [np.arange(len(x))[k::2]], "x": [x[k::2].ravel()], "cluster": [[str(v) for v in labels[k::2]]]})
                 for k in sorted({i, j})]
        monkeypatch.setattr(C, "TILE", tile)
        return C._pair_sums(pd.concat(packs))

    for tile in (7, 256):
        for i, j in ((0, 0), (0, 1)):
            got = pair(i, j, tile)
            for row in got.itertuples():
                other = j if row.pack == i else i
                y, kept = x[other::2], labels[other::2] == int(row.cluster)
                assert row.n == kept.sum()
                np.testing.assert_allclose(row.total, C._distances(x[row.pack::2], y[kept]).sum(1), rtol=1e-7)
            assert set(got["pack"]) == {i, j}


def test_components_of_long_paths(spark):
    n = 200
    edges = [(f"{i:04d}", f"{i + 1:04d}") for i in range(n)] + [("x1", "x2"), ("x3", "x2"), ("x3", "x1")]
    roots = {r.node: r.root for r in C.components(spark.createDataFrame(edges, "a string, b string")).collect()}
    assert set(roots.values()) == {"0000", "x1"} and len(roots) == n + 2


def test_pca_is_the_svd_up_to_sign(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(30, 6)) * [5, 3, 1, 1, 1, 1]
    got = C.pca(frame(spark, x).drop("cluster")).orderBy("entity").toPandas()[["dim1", "dim2"]].to_numpy()
    c = x - x.mean(0)
    _, _, v = np.linalg.svd(c, full_matrices=False)
    np.testing.assert_allclose(np.abs(got), np.abs(c @ v[:2].T), atol=1e-6)


def test_few_entities_are_not_clustered(spark):
    best, report = C.pick_clustering(frame(spark, np.eye(2)).drop("cluster"))
    assert report["chosen"] is None and {r.cluster for r in best.collect()} == {"0"}
    assert C.pick_reduction(frame(spark, np.eye(2)).drop("cluster"))[0] is None
