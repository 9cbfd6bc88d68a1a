"""Operators across tickers: alignment, correlation, lookups and rankings."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.functions.numeric import finite
from tickloom.functions.tickers import variants
from tickloom.operators.core import Keys, key_list, newest_by, spread_lists
from tickloom.operators.series import pct_change
from tickloom.session import checkpointed

BLOCK = 256  # tickers of one side of a block of products


def common_range(df: DataFrame, tickers: Sequence[str], ts: str = "ts") -> DataFrame:
    """One row: the time from which and until which all the tickers have bars."""
    each = df.where(F.col("ticker").isin(*tickers)).groupBy("ticker").agg(
        F.min(ts).alias("_a"), F.max(ts).alias("_z"))
    return each.agg(F.max("_a").alias("start"), F.min("_z").alias("end"), F.count(F.lit(1)).alias("tickers"))


def _complete(df: DataFrame, tickers: Sequence[str], col: str, ts: str) -> DataFrame:
    """(ts, values): the values of the tickers, in order, at times at which every one has a value."""
    names = list(dict.fromkeys(tickers))
    place = df.sparkSession.createDataFrame([(t, i) for i, t in enumerate(names, 1)], "ticker string, _k int")  # as long as the request
    known = df.where(F.col(col).isNotNull()).join(F.broadcast(place), "ticker").select(ts, "_k", F.col(col).cast("double").alias("_v"))
    one = known.groupBy(ts, "_k").agg(F.first("_v").alias("_v"))
    rows = one.groupBy(ts).agg(F.array_sort(F.collect_list(F.struct("_k", "_v"))).alias("_r"))  # one entry per ticker at most
    return rows.where(F.size("_r") == len(names)).select(ts, F.transform("_r", lambda x: x["_v"]).alias("values"))


def align(df: DataFrame, tickers: Sequence[str], col: str = "close", ts: str = "ts") -> DataFrame:
    """One row per time at which every ticker has a value, one column per ticker."""
    names = list(dict.fromkeys(tickers))
    return _complete(df, names, col, ts).select(ts, *[F.col("values")[i].alias(t) for i, t in enumerate(names)])


def _products(block: int) -> Callable:
    """Sums of products of two blocks of tickers over the rows of a task, as (i, j, s) with i at most j."""
    def cells(held: dict) -> Iterator[pa.RecordBatch]:
        for (bi, bj), m in held.items():
            i, j = np.divmod(np.arange(m.size), m.shape[1])
            i, j = i + bi * block, j + bj * block
            once = i <= j
            yield pa.RecordBatch.from_arrays([pa.array(i[once], pa.int32()), pa.array(j[once], pa.int32()), pa.array(m.ravel()[once])],
                                             names=["i", "j", "s"])

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], np.ndarray] = {}
        for b in batches:
            bi, bj = b.column(0).to_numpy(), b.column(1).to_numpy()
            cut = np.flatnonzero(np.diff(bi) | np.diff(bj)) + 1
            for lo, hi in zip(np.r_[0, cut], np.r_[cut, b.num_rows]):
                if lo == hi:
                    continue
                key = int(bi[lo]), int(bj[lo])
                x, y = (b.column(c).slice(lo, hi - lo).flatten().to_numpy().reshape(hi - lo, -1) for c in (2, 3))
                if key not in held and len(held) > 3:  # blocks arrive in order, so few are open
                    yield from cells(held)
                    held = {}
                held[key] = held[key] + x.T @ y if key in held else x.T @ y
        yield from cells(held)
    return multiply


def correlations(df: DataFrame, tickers: Sequence[str], col: str = "close", ts: str = "ts", digits: int = 4,
                 block: int = BLOCK) -> DataFrame:
    """Pearson correlation of each pair once, t1 before t2 in the order given, and of each ticker with itself.

    Sums of products over complete rows, block by block: a task multiplies the vectors of two blocks of at most ``block``
    tickers over its share of the rows, so no row becomes a row for each pair. Values are taken relative to the ticker's
    mean, so large levels lose no digits. A flat series has no correlation, with itself neither; without complete rows
    there are no cells. The cells stay distributed.
    """
    names = list(dict.fromkeys(tickers))
    if not names:
        return df.sparkSession.createDataFrame([], "t1 string, t2 string, corr double")
    rows = checkpointed(_complete(df, names, col, ts))
    means = {r["k"]: r["m"] for r in rows.select(F.posexplode("values").alias("k", "v")).groupBy("k").agg(F.avg("v").alias("m")).collect()}
    centre = F.array(*[F.lit(means.get(i, 0.0)) for i in range(len(names))])  # one number per ticker asked for
    dev = rows.select(F.zip_with("values", centre, lambda v, m: v - m).alias("x"), F.hash(ts).alias("h"))
    blocks = range(-(-len(names) // block))
    both = [F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in blocks for j in blocks if i <= j]
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    shares = max(1, tasks // len(both))  # of the rows, for one pair of blocks
    dealt = dev.select("x", "h", F.explode(F.array(*both)).alias("p")).select(
        "p.i", "p.j", F.slice("x", F.col("p.i") * block + 1, block).alias("a"), F.slice("x", F.col("p.j") * block + 1, block).alias("b"),
        F.pmod("h", F.lit(shares)).alias("share"))
    dealt = dealt.repartition(max(tasks, len(both)), "i", "j", "share").sortWithinPartitions("i", "j").drop("share")
    sums = dealt.mapInArrow(_products(block), "i int, j int, s double").groupBy("i", "j").agg(F.sum("s").alias("s"))
    own = checkpointed(dev.select(F.posexplode("x").alias("k", "v")).groupBy("k").agg(F.sum(F.col("v") * F.col("v")).alias("s")))
    x, y = own.select(F.col("k").alias("i"), F.col("s").alias("si")), own.select(F.col("k").alias("j"), F.col("s").alias("sj"))
    place = df.sparkSession.createDataFrame(list(enumerate(names)), "k int, t string")  # as long as the request
    corr = F.when(F.col("i") == F.col("j"), F.when(F.col("si") > 0, 1.0)).otherwise(
        F.try_divide(F.col("s"), F.sqrt("si") * F.sqrt("sj")))
    for k in "ij":
        sums = sums.join(F.broadcast(place.select(F.col("k").alias(k), F.col("t").alias("t1" if k == "i" else "t2"))), k)
    return sums.join(F.broadcast(x), "i").join(F.broadcast(y), "j").select("t1", "t2", F.round(finite(corr), digits).alias("corr"))


def corr_matrix(df: DataFrame, tickers: Sequence[str], col: str = "close", ts: str = "ts",
                digits: int = 4) -> DataFrame:
    """Pearson correlation over complete rows as (t1, t2, corr), both directions and the diagonal."""
    half = correlations(df, tickers, col, ts, digits)
    both = F.when(F.col("t1") == F.col("t2"), F.array(F.struct("t1", "t2", "corr"))).otherwise(F.array(
        F.struct("t1", "t2", "corr"), F.struct(F.col("t2").alias("t1"), F.col("t1").alias("t2"), "corr")))
    return half.select(F.inline(both))


def pairs(matrix: DataFrame) -> DataFrame:
    """Each pair once, in name order, undefined correlations left out; a matrix or its half will do."""
    ordered = matrix.where((F.col("t1") != F.col("t2")) & F.col("corr").isNotNull()).select(
        F.least("t1", "t2").alias("t1"), F.greatest("t1", "t2").alias("t2"), "corr")
    return ordered.dropDuplicates(["t1", "t2"])


def corr_stats(matrix: DataFrame) -> DataFrame:
    p = pairs(matrix)
    return p.agg(*[F.round(f("corr"), 4).alias(n) for n, f in (
        ("avg_corr", F.avg), ("max_corr", F.max), ("min_corr", F.min), ("std_corr", F.stddev_pop))])


def top_pairs(matrix: DataFrame, n: int = 4, positive: bool = True) -> DataFrame:
    """The ``n`` strongest pairs of one direction, ties in name order."""
    order = F.col("corr").desc() if positive else F.col("corr").asc()
    return pairs(matrix).orderBy(order, "t1", "t2").limit(n)


def corr_heatmap(known: DataFrame, tickers: Sequence[str]) -> DataFrame:
    """Square table from known pairs: mirrored, 1 on the diagonal, 0 where unknown."""
    both = known.select("t1", "t2", "corr").unionByName(
        known.select(F.col("t2").alias("t1"), F.col("t1").alias("t2"), "corr"))
    names = list(tickers)
    own = known.sparkSession.range(1).select(F.explode(F.array(*[F.lit(t) for t in names])).alias("t1")).select(
        "t1", F.col("t1").alias("t2"), F.lit(1.0).alias("corr"))
    every = both.where(F.col("t1") != F.col("t2")).unionByName(own)
    return every.groupBy("t1").pivot("t2", names).agg(F.first("corr")).na.fill(0.0)


def resolve_tickers(requests: DataFrame, known: DataFrame, entity: str = "entity") -> DataFrame:
    """For each request the first of its spellings that is a known ticker; null if none is."""
    tries = requests.select(entity, F.posexplode(variants(F.col(entity))).alias("prio", "ticker"))
    hit = tries.join(known.select("ticker").distinct(), "ticker").groupBy(entity).agg(
        F.min_by("ticker", "prio").alias("ticker"))
    return requests.select(entity).distinct().join(hit, entity, "left")


def price_at(signals: DataFrame, bars: DataFrame, col: str = "close", by: Sequence[str] = ("ticker", "ts")) -> DataFrame:
    """Adds the price at the time of each signal, null where there is no bar."""
    return signals.join(bars.select(*by, F.col(col).alias("actual_price")), list(by), "left")


def keep_universe(df: DataFrame, universe: DataFrame) -> DataFrame:
    return df.join(universe.select("ticker").distinct(), "ticker", "left_semi")


def unknown_tickers(requests: DataFrame, universe: DataFrame) -> DataFrame:
    return requests.select("ticker").distinct().join(universe.select("ticker").distinct(), "ticker", "left_anti")


def find_mapping(requests: DataFrame, mapping: DataFrame, spelled: str = "spelled") -> DataFrame:
    """Mapping rows by base symbol or either source's ticker: one equi-join over all spellings."""
    spellings = mapping.unpivot(
        ["base_symbol"], ["yfinance_ticker", "binance_ticker"], "_kind", spelled
    ).select("base_symbol", spelled).unionByName(mapping.select("base_symbol", F.col("base_symbol").alias(spelled)))
    return requests.join(spellings.distinct(), spelled).join(mapping, "base_symbol")


def cluster_groups(assigned: DataFrame, entity: str = "ticker", per_list: int = 1000) -> DataFrame:
    """Members per cluster as sorted lists; a big cluster is spread over several pages."""
    return spread_lists(assigned, "cluster", entity, per_list).withColumnRenamed("items", "members")


def cluster_profile(assigned: DataFrame, bars: DataFrame, col: str = "close", every: str = "1d",
                    periods: int = 252) -> DataFrame:
    """Per cluster: members, members with data, mean annual return and volatility, risk level."""
    r = pct_change(bars, col, "_r", every=every).groupBy("ticker").agg(
        F.count("_r").alias("_k"), (F.avg("_r") * periods).alias("_ret"),
        (F.stddev_samp("_r") * math.sqrt(periods)).alias("_vol")).where(F.col("_k") > 1)
    r = r.withColumns({c: finite(F.col(c)) for c in ("_ret", "_vol")}).na.drop(subset=["_ret", "_vol"])
    d = assigned.join(r, "ticker", "left").groupBy("cluster").agg(
        F.count(F.lit(1)).alias("size"), F.count("_ret").alias("tickers_with_data"),
        F.coalesce(F.avg("_ret"), F.lit(0.0)).alias("avg_return"),
        F.coalesce(F.avg("_vol"), F.lit(0.0)).alias("avg_volatility"))
    v = F.col("avg_volatility")
    return d.withColumn("risk_level", F.when(F.col("tickers_with_data") == 0, "Unknown")
                        .when(v > 0.5, "High").when(v > 0.3, "Medium").otherwise("Low"))


def newest(df: DataFrame, n: int, ts: str, *ties: Column) -> DataFrame:
    """The newest ``n`` rows of a table (top-k, no full sort)."""
    return df.orderBy(F.col(ts).desc(), *ties).limit(n)


def latest_per(df: DataFrame, by: Keys, updated: str) -> DataFrame:
    """The most recently updated row per key."""
    return newest_by(df, key_list(by), [F.col(updated)])


def best_of(df: DataFrame, by: Keys, name: str, score: str, largest: bool = False,
            priority: str | None = None) -> DataFrame:
    """The name with the smallest (or largest) score per key; ties by priority, then by name."""
    tie = F.col(priority) if priority else F.col(name)
    rank = F.struct((-F.col(score) if largest else F.col(score)).alias("s"), tie.alias("p"), F.col(name).alias("n"))
    known = df.where(F.col(score).isNotNull())
    return known.groupBy(*key_list(by)).agg(
        F.min_by(F.struct(F.col(name).alias("best"), F.col(score).alias("best_score")), rank).alias("_b")
    ).select(*key_list(by), "_b.*")


def target_date(forecast: DataFrame, target: Column, by: Keys = "ticker", ts: str = "ts") -> DataFrame:
    """First forecast time at or above the target per key; null if it is never reached."""
    return forecast.groupBy(*key_list(by)).agg(
        F.min(F.when(F.col("forecast") >= target, F.col(ts))).alias("target_ts"))


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """Rows per table."""
    out = None
    for name, t in tables.items():
        part = t.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("table_name"), "rows")
        out = part if out is None else out.unionByName(part)
    return out
