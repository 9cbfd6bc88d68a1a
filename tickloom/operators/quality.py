"""Repair, scaling and shape changes of bar tables."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.functions.numeric import to_number
from tickloom.operators.core import Keys, carry_last, key_list, known_around, latest_n, run_steps
from tickloom.operators.series import rolling_vol_step, sma_step
from tickloom.session import checkpointed

CHUNK = 4096  # ranks of a matrix column that one task fills
FEATURES = ["open", "high", "low", "close", "volume"]

# Column names that mean one of the five features.
FEATURE_ALIASES = {
    "open": ["Open", "open", "Open Price"],
    "high": ["High", "high", "High Price"],
    "low": ["Low", "low", "Low Price"],
    "close": ["Close", "close", "Close Price"],
    "volume": ["Volume", "volume"],
}


# --- filling -----------------------------------------------------------------------------------

def ffill(df: DataFrame, cols: Sequence[str], by: Keys = "ticker", ts: str = "ts",
          every: str = "1d") -> DataFrame:
    """Last known value of each column."""
    out = carry_last(df, {f"_f_{c}": F.col(c) for c in cols}, by, ts, every)
    return _put_back(out, cols, "_f_")


def bfill(df: DataFrame, cols: Sequence[str], by: Keys = "ticker", ts: str = "ts",
          every: str = "1d") -> DataFrame:
    """Next known value of each column."""
    out = carry_last(df, {f"_f_{c}": F.col(c) for c in cols}, by, ts, every, backward=True)
    return _put_back(out, cols, "_f_")


def _put_back(df: DataFrame, cols: Sequence[str], prefix: str) -> DataFrame:
    return df.withColumns({c: F.col(prefix + c) for c in cols}).drop(*[prefix + c for c in cols])


def interpolate(df: DataFrame, cols: Sequence[str], by: Keys = "ticker", ts: str = "ts",
                every: str = "1d") -> DataFrame:
    """Straight line over row positions between known neighbours; the ends take the nearest value."""
    d = known_around(df, cols, by, ts, every)
    fixed = {}
    for c in cols:
        a, z = F.col(f"_a_{c}"), F.col(f"_z_{c}")
        share = (F.col("_i") - a["i"]) / F.when(z["i"] > a["i"], z["i"] - a["i"])
        fixed[c] = F.coalesce(F.col(c), a["v"] + (z["v"] - a["v"]) * share, a["v"], z["v"])
    return d.withColumns(fixed).drop("_i", *[p + c for c in cols for p in ("_a_", "_z_")])


def to_cells(df: DataFrame, cols: Sequence[str] = FEATURES, keys: Sequence[str] = ("ticker", "ts")) -> DataFrame:
    """One row per key, time and feature: (keys, feature, value)."""
    return df.unpivot(list(keys), list(cols), "feature", "value")


def interpolate_flattened(df: DataFrame, cols: Sequence[str] = FEATURES, by: Keys = "ticker",
                          ts: str = "ts", every: str = "1d") -> DataFrame:
    """As ``interpolate``, but along the flattened row date1_open, date1_high, ..., date2_open, ...

    Neighbouring features count as neighbouring cells; returns cells (key, ts, feature, value).
    """
    order = F.array_position(F.array(*[F.lit(c) for c in cols]), F.col("feature"))
    cells = to_cells(df, cols, [*key_list(by), ts]).withColumn(
        "_cell", F.timestamp_micros(F.unix_micros(ts) + order))
    return interpolate(cells, ["value"], by, "_cell", every).drop("_cell")


def unify_schema(df: DataFrame, by: Keys = "ticker", ts: str = "ts", every: str = "1d") -> DataFrame:
    """Key, time and the five features as doubles, whatever the source calls them.

    Missing features are 0, text that is no number is null, rows without any value are dropped, and
    the remaining nulls take the last known value, or else the next one.
    """
    def feature(name: str) -> Column:
        found = [F.col(f"`{a}`") for a in FEATURE_ALIASES[name] if a in df.columns]
        return to_number(found[0].cast("string")) if found else F.lit(0.0)

    d = df.select(*key_list(by), ts, *[feature(f).alias(f) for f in FEATURES]).na.drop("all", subset=FEATURES)
    near = known_around(d, FEATURES, by, ts, every)
    filled = {f: F.coalesce(F.col(f"_a_{f}")["v"], F.col(f"_z_{f}")["v"]) for f in FEATURES}
    return near.withColumns(filled).drop("_i", *[p + f for f in FEATURES for p in ("_a_", "_z_")])


# --- dropping ----------------------------------------------------------------------------------

def drop_incomplete(df: DataFrame, cols: Sequence[str], by: Keys = "ticker") -> DataFrame:
    """Only the keys that have no null left in any of the columns."""
    keys = key_list(by)
    whole = df.groupBy(*keys).agg(F.max(_holes(cols)).alias("_holes")).where(F.col("_holes") == 0)
    return df.join(whole.select(*keys), keys, "left_semi")


def restrict_recent_days(df: DataFrame, n: int, ts: str = "ts") -> DataFrame:
    """Rows of the newest ``n`` distinct dates of the whole table."""
    newest = df.select(F.to_date(ts).alias("_d")).distinct().orderBy(F.col("_d").desc()).limit(n)
    d = df.withColumn("_d", F.to_date(ts))
    return d.join(F.broadcast(newest), "_d", "left_semi").drop("_d")  # at most n rows


def drop_sparse(cells: DataFrame, frac: float = 0.5, by: Keys = "ticker",
                column: Sequence[str] = ("d", "feature")) -> DataFrame:
    """Known cells of the matrix after dropping thin columns, then thin rows.

    A column stays with at least int(frac * rows) known cells, a row with int(frac * columns left).
    """
    keys, cols = key_list(by), list(column)
    known = cells.where(F.col("value").isNotNull())
    rows = cells.select(*keys).distinct().agg(F.count(F.lit(1))).scalar()
    full_columns = (known.groupBy(*cols).agg(F.count(F.lit(1)).alias("_k"))
                    .where(F.col("_k") >= F.floor(rows * frac)).drop("_k"))
    known = known.join(full_columns, cols, "left_semi")
    width = full_columns.agg(F.count(F.lit(1))).scalar()
    full_rows = (known.groupBy(*keys).agg(F.count(F.lit(1)).alias("_k"))
                 .where(F.col("_k") >= F.floor(width * frac)).drop("_k"))
    return known.join(full_rows, keys, "left_semi")


def ranked(df: DataFrame, by: str) -> DataFrame:
    """The distinct values of a column and their ``rank`` from 0, without gathering them: they are sorted by ranges, and the
    counts of the ranges give every range its first rank."""
    rows = checkpointed(df.select(by).where(F.col(by).isNotNull()).distinct().orderBy(by).withColumn("_id", F.monotonically_increasing_id()))
    part = F.shiftright("_id", 33)
    sizes = rows.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))  # one row for each range
    first = sizes.withColumn("_first", F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).drop("_n")
    return rows.withColumn("_part", part).join(F.broadcast(first), "_part").select(
        by, (F.col("_first") + F.col("_id").bitwiseAND((1 << 33) - 1)).alias("rank"))


def fill_runs(cells: DataFrame, ranks: DataFrame, by: str = "ticker", column: Sequence[str] = ("d", "feature"),
              chunk: int = CHUNK) -> DataFrame:
    """The filled matrix as runs: (column, ``first``, ``last``, ``value``), a value for the rows of these ranks.

    A known cell fills the rows down to the next known one of its column, the first one those above it, too; a column
    without a known cell is one run of 0. Only known cells are looked at: they meet their neighbours within chunks of
    ranks, and one edge for each chunk carries on.
    """
    cols = list(column)
    n = ranks.count()
    value = F.when(F.abs("value") == float("inf"), F.lit(0.0)).otherwise(F.col("value"))
    known = cells.select(by, *cols, value.alias("value")).where("value is not null").join(ranks, by)
    known = known.withColumn("_c", F.floor(F.col("rank") / chunk))
    inside = Window.partitionBy(*cols, "_c").orderBy("rank")
    edges = known.groupBy(*cols, "_c").agg(F.min("rank").alias("_edge"))
    along = Window.partitionBy(*cols).orderBy("_c")
    edges = edges.select(*cols, "_c", F.lead("_edge").over(along).alias("_after"),
                         F.when(F.row_number().over(along) == 1, F.col("_edge")).alias("_top"))
    runs = known.withColumn("_next", F.lead("rank").over(inside)).join(edges, [*cols, "_c"]).select(
        *cols, F.when(F.col("rank") == F.col("_top"), 0).otherwise(F.col("rank")).cast("long").alias("first"),
        (F.coalesce("_next", "_after", F.lit(n)) - 1).cast("long").alias("last"), "value")
    empty = cells.groupBy(*cols).agg(F.count(value).alias("_k")).where("_k = 0").select(
        *cols, F.lit(0).cast("long").alias("first"), F.lit(n - 1).cast("long").alias("last"), F.lit(0.0).alias("value"))
    return runs.unionByName(empty).where(F.col("last") >= F.col("first"))


def fill_sparse(cells: DataFrame, by: str = "ticker", column: Sequence[str] = ("d", "feature")) -> DataFrame:
    """The full matrix in cell form: gaps take the value of the row above, else below, else 0; rows are in key order.

    It is ``fill_runs`` written out; operators that can use runs need not write them out.
    """
    ranks = checkpointed(ranked(cells, by))
    runs = fill_runs(cells, ranks, by, column)
    return runs.select(*column, F.explode(F.sequence("first", "last")).alias("rank"), "value").join(ranks, "rank").select(
        by, *column, "value")


def valid_ticker(df: DataFrame, col: str = "ticker") -> DataFrame:
    """Trimmed tickers; empty ones and the text 'nan' are dropped."""
    return df.withColumn(col, F.trim(col)).where((F.col(col) != "") & (F.lower(col) != "nan"))


# --- scaling and reports -----------------------------------------------------------------------

def standard_scale(cells: DataFrame, column: Sequence[str] = ("d", "feature"), value: str = "value") -> DataFrame:
    """(value - mean) / population deviation of its column; a constant column divides by 1."""
    cols = list(column)
    stats = cells.groupBy(*cols).agg(F.avg(value).alias("_m"), F.stddev_pop(value).alias("_s"))
    scale = F.when(F.col("_s") == 0, F.lit(1.0)).otherwise(F.col("_s"))
    return cells.join(stats, cols).withColumn("scaled", (F.col(value) - F.col("_m")) / scale).drop("_m", "_s")


def _holes(cols: Sequence[str]) -> Column:
    """Null cells of one row."""
    total = F.lit(0).cast("long")
    for c in cols:
        total = total + F.col(c).isNull().cast("long")
    return total


def quality_report(df: DataFrame, max_days: int, cols: Sequence[str] = FEATURES, by: Keys = "ticker",
                   ts: str = "ts", every: str = "1d") -> DataFrame:
    """One row: sizes and missing cells before and after each repair.

    Columns are those of the flattened table, one per date and feature. Rows without key or time have no place in a
    series; series operators leave them out, and here they are counted.
    """
    keys = key_list(by)
    recent = restrict_recent_days(df, max_days, ts).withColumn("_was", _holes(cols))
    per_key = interpolate(recent, cols, by, ts, every).groupBy(*keys).agg(
        F.sum("_was").alias("_was"), F.sum(_holes(cols)).alias("_left"), (F.count(F.lit(1)) * len(cols)).alias("_cells"))
    empty = F.col("_was") == F.col("_cells")  # filling along the row helps wherever it holds one value
    lost = df.select(F.count_if(F.col(ts).isNull() | reduce(or_, [F.col(k).isNull() for k in keys]))).scalar()
    before = df.agg(F.struct(
        F.count_distinct(*keys).alias("tickers"), F.count_distinct(F.to_date(ts)).alias("dates"))).scalar()
    return per_key.agg(
        F.coalesce(F.sum("_was"), F.lit(0)).alias("missing_before"),
        F.coalesce(F.sum("_left"), F.lit(0)).alias("missing_after_interpolation"),
        F.count_if(F.col("_left") == 0).alias("tickers_after"),
        F.count_if(F.col("_left") > 0).alias("tickers_dropped"),
        F.coalesce(F.sum(F.when(empty, F.col("_cells"))), F.lit(0)).alias("missing_after_fill"),
        F.count_if(empty).alias("rows_dropped"),
    ).withColumn("_before", before).withColumn("rows_without_place", lost).select(
        F.col("_before.tickers").alias("tickers_before"), F.col("_before.dates").alias("dates_before"),
        F.least(F.col("_before.dates"), F.lit(max_days)).alias("dates_after"),
        "missing_before", "missing_after_interpolation", "tickers_after", "tickers_dropped", "missing_after_fill",
        "rows_dropped", "rows_without_place", (F.col("_before.dates") * len(cols)).alias("columns_found"),
        (F.least(F.col("_before.dates"), F.lit(max_days)) * len(cols)).alias("columns_after"))


def missing_pct(df: DataFrame, cols: Sequence[str] = FEATURES, by: Keys = "ticker") -> DataFrame:
    """Null cells in percent of all cells, per key."""
    cells = F.count(F.lit(1)) * len(cols)
    missing = F.sum(_holes(cols))
    return df.groupBy(*key_list(by)).agg(
        missing.alias("missing"), F.round(missing / cells * 100, 2).alias("missing_pct"))


def missing_ranges(df: DataFrame, start: str, end: str, by: Keys = "ticker", ts: str = "ts") -> DataFrame:
    """Gaps in the days of [start, end], per key: (keys, first_day, last_day), both inclusive.

    Each key gets the days just outside the range as fences; whatever lies between two neighbouring
    days is a gap. A group holds at most the days of the range.
    """
    keys = key_list(by)
    first, last = F.lit(start).cast("date"), F.lit(end).cast("date")
    days = df.select(*keys, F.to_date(ts).alias("_d")).where(F.col("_d").between(first, last))
    fences = df.select(*keys).distinct().select(
        *keys, F.explode(F.array(F.date_sub(first, 1), F.date_add(last, 1))).alias("_d"))
    w = Window.partitionBy(*keys).orderBy("_d")
    near = days.distinct().unionByName(fences).withColumn("_p", F.lag("_d").over(w))
    return near.where(F.datediff("_d", "_p") > 1).select(
        *keys, F.date_add("_p", 1).alias("first_day"), F.date_sub("_d", 1).alias("last_day"))


# --- shape -------------------------------------------------------------------------------------

def flatten(df: DataFrame, cols: Sequence[str] = FEATURES, by: str = "ticker", ts: str = "ts") -> DataFrame:
    """One row per key with columns ``YYYY-MM-DD_feature``; a bar that starts within a day has its time in the name.

    The columns of the result are the bar starts of the table, so their names pass the driver as any
    schema does; ``to_cells`` is the long form for tables that are too wide to be one.
    """
    label = _bar_label(F.col(ts))
    names = [r[0] for r in df.select(label.alias("_l")).distinct().collect()]
    cells = to_cells(df, cols, [by, ts]).select(by, F.concat_ws("_", label, "feature").alias("_col"), "value")
    return cells.groupBy(by).pivot("_col", [f"{n}_{c}" for n in sorted(names) for c in cols]).agg(F.first("value"))


def _bar_label(ts: Column) -> Column:
    whole_day = ts == F.date_trunc("day", ts)
    return F.when(whole_day, F.date_format(ts, "yyyy-MM-dd")).otherwise(F.date_format(ts, "yyyy-MM-dd HH:mm:ss"))


def unflatten(wide: DataFrame, by: str = "ticker") -> DataFrame:
    """Back to cells (key, d, ts, feature, value); the feature is what follows the last underscore."""
    cells = wide.unpivot([by], [c for c in wide.columns if c != by], "_col", "value")
    start = F.regexp_extract("_col", r"^(.*)_([^_]*)$", 1)
    return cells.select(
        by, F.to_date(start).alias("d"), F.to_timestamp(start).alias("ts"),
        F.regexp_extract("_col", r"^(.*)_([^_]*)$", 2).alias("feature"),
        "value",
    )


def chart_series(df: DataFrame, kind: str, limit: int = 200, by: Keys = "ticker", ts: str = "ts",
                 every: str = "1d") -> DataFrame:
    """Rows to draw, from the newest ``limit`` bars: (keys, ts, name, value), nulls dropped.

    ``candlestick`` gives the four prices, ``volume`` the volume, ``ma`` the 7, 20 and 50 bar means,
    ``volatility`` the annualised deviation of 20 returns in percent, ``temporal`` all five features.
    """
    d = latest_n(df, limit, by, ts).drop("age")
    if kind == "candlestick":
        cols = ["open", "high", "low", "close"]
    elif kind == "volume":
        cols = ["volume"]
    elif kind == "temporal":
        cols = FEATURES
    elif kind == "ma":
        cols = ["ma7", "ma20", "ma50"]
        d = run_steps(d, [sma_step("close", n, f"ma{n}") for n in (7, 20, 50)], by, ts, every)
    elif kind == "volatility":
        cols = ["volatility"]
        d = run_steps(d, [rolling_vol_step("close", 20, periods=252, percent=True, out="volatility")], by, ts, every)
    else:
        raise ValueError(f"unknown kind of chart: {kind}")
    return d.unpivot([*key_list(by), ts], cols, "name", "value").where(F.col("value").isNotNull())


def chart_points(series: DataFrame, by: Keys = "ticker") -> DataFrame:
    """The number of points to draw per key."""
    return series.groupBy(*key_list(by)).agg(F.count(F.lit(1)).alias("points"))
