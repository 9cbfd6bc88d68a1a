"""Wide correlations, filled matrices and quantiles of hot keys against NumPy."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tickloom.functions import docs
from tickloom.operators import cross as X
from tickloom.operators import quality as Q
from tickloom.operators import stats as A


@pytest.mark.parametrize("block", [256, 3])
def test_correlations_in_blocks(spark, block):
    r = np.random.default_rng(3)
    x = r.normal(size=(40, 8)).cumsum(0) + 1e6
    x[:, 5] = 7.0
    names = [f"t{i}" for i in range(8)]
    rows = [(n, t, float(x[t, i])) for i, n in enumerate(names) for t in range(40) if (i, t) != (2, 11)] + [("other", 1, 1.0), ("t1", 50, 2.0)]
    df = spark.createDataFrame(rows, "ticker string, ts long, close double")
    got = {(r.t1, r.t2): r.corr for r in X.correlations(df, names, block=block).collect()}
    full = np.delete(x, 11, axis=0)  # a ticker lacks this time
    with np.errstate(all="ignore"):
        want = np.corrcoef(full.T)
    assert len(got) == 36
    for (a, b), c in got.items():
        i, j = names.index(a), names.index(b)
        assert i <= j
        assert c is None if 5 in (i, j) else c == pytest.approx(want[i, j], abs=1e-4)
    assert X.correlations(df, []).count() == 0 and X.correlations(df.limit(0), names).count() == 0


@pytest.mark.parametrize("chunk", [4096, 2])
def test_filled_matrix(spark, chunk):
    r = np.random.default_rng(4)
    tickers = [f"k{i:02d}" for i in range(13)]
    cells = [(t, c, float(v)) for t in tickers for c, v in zip("abc", r.normal(size=3)) if r.random() < 0.4]
    cells += [("k03", "d", None), ("k07", "e", float("inf")), ("zz", "d", None)]
    df = spark.createDataFrame(cells, "ticker string, c string, value double").repartition(4)
    rows = sorted({t for t, _, _ in cells})
    wide = pd.DataFrame(cells, columns=["t", "c", "v"]).replace(np.inf, 0.0).pivot_table(index="t", columns="c", values="v", dropna=False)
    wide = wide.reindex(index=rows, columns=list("abcde")).ffill().bfill().fillna(0.0)
    ranks = Q.ranked(df, "ticker")
    assert {r["ticker"]: r["rank"] for r in ranks.collect()} == {t: i for i, t in enumerate(rows)}
    runs = Q.fill_runs(df, ranks, column=["c"], chunk=chunk).collect()
    assert len(runs) <= sum(v is not None for _, _, v in cells) + 1
    got = {(rows[i], r.c): r.value for r in runs for i in range(r["first"], r["last"] + 1)}
    assert got == {(t, c): wide.loc[t, c] for t in rows for c in "abcde"}
    assert {(r.ticker, r.c): r.value for r in Q.fill_sparse(df, column=["c"]).collect()} == got
    assert Q.fill_sparse(df.limit(0), column=["c"]).count() == 0


@pytest.mark.parametrize("sketch", [40, 200])
def test_quantiles_of_a_hot_key_in_passes(spark, monkeypatch, sketch):
    monkeypatch.setattr(A, "SKETCH", sketch)
    r = np.random.default_rng(5)
    hot = r.permutation(30_000) / 7.0
    lumpy = np.r_[np.zeros(9000), r.normal(size=6000).round(3)]
    pdf = pd.DataFrame({"k": ["hot"] * len(hot) + ["lumpy"] * len(lumpy) + ["one"], "v": np.r_[hot, lumpy, 5.0]})
    probs = [0.0, 0.1, 0.5, 0.75, 1.0]
    df = spark.createDataFrame(pdf).repartition(6)
    got = {r.k: list(r)[1:] for r in A.exact_quantiles(df, "k", "v", probs).collect()}
    np.testing.assert_allclose(got["hot"], np.quantile(hot, probs))
    np.testing.assert_allclose(got["lumpy"], np.quantile(lumpy, probs))
    assert got["one"] == [5.0] * 5


def test_brackets_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(A, "SKETCH", 50)
    df = spark.range(40_000).select(F.lit("a").alias("k"), F.col("id").cast("double").alias("_v"))
    sketch = df.groupBy("k").agg(F.count("*").alias("_n"), F.percentile_approx("_v", [0.4, 0.6], 50).alias("_cuts"))
    low, high = A._narrowed(df, sketch, ["k"], [0.5]).head()["_cuts"]
    assert low <= 19_999 and high >= 20_000 and high - low < 50


def test_pages_of_points(spark):
    pdf = pd.DataFrame({"ticker": "A", "ts": pd.date_range("2024-01-22", periods=20), "close": np.arange(20.0)})
    df = spark.createDataFrame(pdf)
    packs = docs.pack_points(df, "close", per_page=4)
    got = sorted((r["pack"].month, r["page"], [p["value"] for p in r["data_points"]]) for r in packs.collect())
    assert got == [(1, 0, [0, 1, 2, 3]), (1, 1, [4, 5, 6, 7]), (1, 2, [8, 9]),
                   (2, 0, [10, 11, 12, 13]), (2, 1, [14, 15, 16, 17]), (2, 2, [18, 19])]
    assert docs.unpack_points(packs).count() == 20
