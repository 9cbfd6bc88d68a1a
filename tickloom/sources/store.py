"""Keyed tables: scans, upserts, appends and lookups."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.functions.tickers import base_symbol
from tickloom.operators.core import Keys, key_list, newest_by
from tickloom.session import checkpointed


def scan_bars(df: DataFrame, tickers: Sequence[str] | None = None, source: str | None = None,
              start: str | None = None, end: str | None = None, interval: str | None = None) -> DataFrame:
    """Bars by ticker, source, interval and inclusive dates; the filters reach the Parquet scan."""
    d = df
    if tickers:
        d = d.where(F.col("ticker").isin(*tickers))
    if source:
        d = d.where(F.col("source") == source)
    if interval:
        d = d.where(F.col("interval") == interval)
    if start:
        d = d.where(F.col("ts") >= F.lit(start).cast("timestamp"))
    if end:
        d = d.where(F.col("ts") < F.date_add(F.lit(end).cast("date"), 1).cast("timestamp"))
    return d


def list_tickers(df: DataFrame, source: str | None = None) -> DataFrame:
    d = df if source is None else df.where(F.col("source") == source)
    return d.select("ticker").distinct().orderBy("ticker")


def upsert(old: DataFrame, new: DataFrame, keys: Keys, order: Sequence[str] = ()) -> DataFrame:
    """Rows of both; per key the new row wins, and among new rows the last in ``order``."""
    both = old.withColumn("_gen", F.lit(0)).unionByName(new.withColumn("_gen", F.lit(1)))
    return newest_by(both, keys, [F.col("_gen"), *[F.col(c) for c in order]]).drop("_gen")


def insert_ignore(old: DataFrame, new: DataFrame, keys: Keys, order: Sequence[str]) -> DataFrame:
    """Stored rows stay; of new keys the first row in ``order`` is added."""
    names = key_list(keys)
    fresh = new.join(old.select(*names), names, "left_anti")
    return old.unionByName(newest_by(fresh, names, [F.col(c) for c in order], first=True))


def append_result(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def remove(spark: SparkSession, path: str) -> None:
    """Removes a folder that this library has staged."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def _put(spark: SparkSession, staged: str, path: str, names: Sequence[str], partitions: Sequence[str], files: int) -> None:
    """The staged rows into the table, then the staged copy away."""
    merged = spark.read.parquet(staged)
    split = F.pmod(F.xxhash64(*names), F.lit(files))
    w = merged.repartition(*partitions, split).write if partitions else merged.write
    w = w.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    (w.partitionBy(*partitions) if partitions else w).parquet(path)
    remove(spark, staged)


def write_upsert(new: DataFrame, path: str, keys: Keys, order: Sequence[str] = (), partitions: Sequence[str] = (),
                 files: int | None = None, keep: Callable[[DataFrame], DataFrame] | None = None) -> None:
    """Upserts into a Parquet table; with ``partitions`` only those that receive rows are rewritten.

    The partition columns must follow from the keys, so that a key never changes its partition. ``keep`` picks the rows
    that stay in the rewritten partitions (of each partition, at least one).

    The merged rows go to a copy beside the table first (``<path>.staged``), since a table cannot be overwritten while it is
    read. A writer that dies before the copy is complete has changed nothing; one that dies later leaves the complete copy,
    and the next writer puts it into the table before its own rows. Running the same batch again gives the same table. A
    partition is written by up to ``files`` tasks, split by the key; by default as many as a shuffle has.
    """
    spark = new.sparkSession
    names, staged = key_list(keys), f"{path.rstrip('/')}.staged"
    files = files or int(spark.conf.get("spark.sql.shuffle.partitions"))
    if exists(spark, f"{staged}/_SUCCESS"):
        _put(spark, staged, path, names, partitions, files)
    remove(spark, staged)
    if partitions and exists(spark, path):
        new = checkpointed(new)  # read twice
        touched = new.select(*partitions).distinct()
        old = spark.read.schema(new.schema).parquet(path).join(touched, list(partitions), "left_semi")
        merged = upsert(old.select(*new.columns), new, names, order)
    elif exists(spark, path):
        merged = upsert(spark.read.schema(new.schema).parquet(path).select(*new.columns), new, names, order)
    else:
        merged = keep_last(new, keys=names, order=order)
    (keep(merged) if keep else merged).write.parquet(staged)
    _put(spark, staged, path, names, partitions, files)


def read_result(df: DataFrame, filters: Mapping[str, object] | None = None, newest: str | None = None,
                since: tuple[str, str] | None = None) -> DataFrame:
    """Stored rows that match every given value, newest first."""
    d = df
    for name, value in (filters or {}).items():
        if value is not None:
            d = d.where(F.col(name) == F.lit(value))
    if since:
        d = d.where(F.col(since[0]) >= F.lit(since[1]))
    return d.orderBy(F.col(newest).desc()) if newest else d


def migrate_add_base_symbol(df: DataFrame) -> DataFrame:
    """Adds ``base_symbol`` where it is missing, from the ticker."""
    from_ticker = base_symbol(F.col("ticker"))
    if "base_symbol" not in df.columns:
        return df.withColumn("base_symbol", from_ticker)
    return df.withColumn("base_symbol", F.coalesce("base_symbol", from_ticker))


def keep_last(*frames: DataFrame, keys: Keys, order: Sequence[str] = ()) -> DataFrame:
    """All rows of the frames in turn; of equal keys the one of the last frame stays."""
    union = None
    for n, f in enumerate(frames):
        f = f.withColumn("_gen", F.lit(n))
        union = f if union is None else union.unionByName(f)
    return newest_by(union, keys, [F.col("_gen"), *[F.col(c) for c in order]]).drop("_gen")


def union_sources(frames: Mapping[str, DataFrame]) -> DataFrame:
    """Rows of all sources with an ``entity`` of base symbol and source suffix."""
    out = None
    for suffix, f in frames.items():
        f = f.withColumn("entity", F.concat_ws("_", base_symbol(F.col("ticker")), F.lit(suffix)))
        out = f if out is None else out.unionByName(f)
    return out
