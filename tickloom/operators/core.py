"""Ordered-series building blocks that stay parallel inside one key.

A window partitioned by ticker alone gives a hot ticker to one task. The helpers here cut every
series into pieces of bounded length instead:

* ``number_rows``: global row position per key. Rows are counted per (key, time chunk); the running
  total of those few counts is the offset of each chunk. A chunk spans ``CHUNK_BARS`` bar intervals
  and (key, ts) is unique, so a chunk never holds more rows than that. Where no interval is known (``every=None``, ticks),
  chunks are cut by measured counts instead (``measured_chunks``), at the price of one or more passes over the times.
* ``run_steps``: operators that look a fixed number of rows back. Rows are shuffled once by
  (key, block of positions), each block also receives the last ``halo`` rows of the block before,
  and all requested columns are computed over that one exchange.
* ``carry_last`` / ``running_sum``: operators that look back without limit. They are solved inside
  each chunk and completed with one carried value per chunk.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tickloom.functions.dates import interval_seconds
from tickloom.session import checkpointed

CHUNK_BARS = 4096
CUTS = 32        # parts into which a chunk with too many rows is cut at once
MIN_BLOCK = 4096

Keys = str | Sequence[str]


def key_list(by: Keys) -> list[str]:
    return [by] if isinstance(by, str) else list(by)


def chunk_of(ts: str, every: str) -> Column:
    """Number of the time chunk a row falls into."""
    width = interval_seconds(every) * CHUNK_BARS
    return F.floor(F.unix_seconds(F.col(ts).cast("timestamp")) / width)


def measured_chunks(df: DataFrame, keys: list[str], ts: str, most: int = CHUNK_BARS) -> DataFrame:
    """Adds ``_c``, the start of the row's time chunk: chunks of about equal counts, at most ``most`` rows each (or the
    rows of a single moment).

    A sketch of the times cuts a key into ``CUTS`` parts, parts that are still too full again, so a key of n rows takes
    about log(n / most) / log(CUTS) rounds over the rows still open. Only tables of cuts are kept.
    """
    d = df.where(F.col(ts).isNotNull()).withColumns({
        "_t": F.unix_micros(F.col(ts).cast("timestamp")), "_c": F.lit(-2 ** 63).cast("long")})
    for k in keys:
        d = d.where(F.col(k).isNotNull())
    left = d.select(*keys, "_t", "_c")
    inside = F.array_max(F.filter("_cuts", lambda c: c <= F.col("_t")))

    while True:
        found = left.groupBy(*keys, "_c").agg(
            F.count(F.lit(1)).alias("_k"), F.min("_t").alias("_lo"), F.max("_t").alias("_hi"),
            F.percentile_approx("_t", [k / CUTS for k in range(1, CUTS)], 100 * CUTS).alias("_cuts"))
        cuts = F.array_distinct(F.concat(F.array(F.col("_lo") + 1), F.filter("_cuts", lambda c: c > F.col("_lo"))))
        full = checkpointed(found.where((F.col("_k") > most) & (F.col("_lo") < F.col("_hi"))).select(*keys, "_c", cuts.alias("_cuts")))
        if full.isEmpty():
            return d.select(*df.columns, "_c")
        placed = F.coalesce(inside, F.col("_c"))
        left = left.join(full, [*keys, "_c"]).withColumn("_c", placed).drop("_cuts")
        d = d.join(full, [*keys, "_c"], "left").withColumn("_c", placed).drop("_cuts")


def _chunked(df: DataFrame, keys: list[str], ts: str, every: str | None) -> DataFrame:
    """Rows by (key, chunk). Without key or time a row has no place in a series and is left out;
    saying so here also keeps the two readers of this exchange on the same plan."""
    d = measured_chunks(df, keys, ts) if every is None else df.withColumn("_c", chunk_of(ts, every))
    for k in [*keys, ts, "_c"]:
        d = d.where(F.col(k).isNotNull())
    return d.repartition(*keys, "_c")


def _per_chunk(chunked: DataFrame, keys: list[str], *aggs: Column) -> DataFrame:
    """One row per (key, chunk).

    The hash over the columns keeps column pruning away, so this reader and the one of the rows need
    the same exchange and Spark computes what lies below it once. Maps cannot be hashed and are left out.
    """
    hashed = [f.name for f in chunked.schema.fields if "map<" not in f.dataType.simpleString()]
    out = chunked.groupBy(*keys, "_c").agg(*aggs, F.max(F.hash(*hashed)).alias("_h"))
    return out.where(F.col("_h").isNotNull()).drop("_h")


def number_rows(df: DataFrame, by: Keys = "ticker", ts: str = "ts", every: str | None = "1d") -> DataFrame:
    """Adds ``_i`` (0-based position by time) and ``_n`` (rows of the key)."""
    keys = key_list(by)
    chunked = _chunked(df, keys, ts, every)
    sizes = _per_chunk(chunked, keys, F.count(F.lit(1)).alias("_k"))
    earlier = Window.partitionBy(*keys).orderBy("_c").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(
        *keys, "_c",
        F.coalesce(F.sum("_k").over(earlier), F.lit(0)).alias("_o"),
        F.sum("_k").over(Window.partitionBy(*keys)).alias("_n"),
    )
    inside = Window.partitionBy(*keys, "_c").orderBy(ts)
    return (
        chunked.withColumn("_r", F.row_number().over(inside) - 1)
        .join(offsets, [*keys, "_c"])
        .withColumn("_i", F.col("_o") + F.col("_r"))
        .drop("_c", "_r", "_o")
    )


class Piece:
    """Windows over one piece of a series."""

    def __init__(self, keys: Sequence[str]):
        self.keys = [*keys, "_b"]
        self.order: WindowSpec = Window.partitionBy(*self.keys).orderBy("_i")

    def last_rows(self, n: int) -> WindowSpec:
        return self.order.rowsBetween(-(n - 1), 0)

    def before(self) -> WindowSpec:
        return self.order.rowsBetween(Window.unboundedPreceding, -1)

    def within(self, part: str) -> WindowSpec:
        """Rows of the same ``part`` up to the current one."""
        return (Window.partitionBy(*self.keys, part).orderBy("_i")
                .rowsBetween(Window.unboundedPreceding, Window.currentRow))


@dataclass(frozen=True)
class Step:
    """Columns computed over an ordered piece that must reach ``halo`` rows back."""

    halo: int
    apply: Callable[[DataFrame, Piece], DataFrame]


def run_steps(df: DataFrame, steps: Sequence[Step], by: Keys = "ticker", ts: str = "ts",
              every: str | None = "1d", positions: bool = False) -> DataFrame:
    """Applies all steps over one exchange; rows keep their columns and gain those of the steps."""
    keys = key_list(by)
    halo = max(s.halo for s in steps)
    block = max(MIN_BLOCK, 4 * halo)
    home = F.floor(F.col("_i") / block)
    last_rows = (F.col("_i") % block >= block - halo) & ((home + 1) * block < F.col("_n"))
    placed = (
        number_rows(df, keys, ts, every)
        .withColumn("_home", home)
        .withColumn("_b", F.explode(
            F.when(last_rows, F.array(home, home + 1)).otherwise(F.array(home))))
    )
    piece = Piece(keys)
    for s in steps:
        placed = s.apply(placed, piece)
    out = placed.where(F.col("_b") == F.col("_home")).drop("_b", "_home")
    return out if positions else out.drop("_i", "_n")


def carry_last(df: DataFrame, values: dict[str, Column], by: Keys = "ticker", ts: str = "ts",
               every: str | None = "1d", backward: bool = False, strict: bool = False) -> DataFrame:
    """Adds, per name, the latest non-null value at or before the row.

    ``backward`` looks at later rows instead, ``strict`` leaves the row itself out.
    """
    keys = key_list(by)
    order = (lambda c: F.col(c).desc()) if backward else (lambda c: F.col(c).asc())
    edge = F.min_by if backward else F.max_by
    d = _chunked(df.withColumns({f"_v_{n}": e for n, e in values.items()}), keys, ts, every)
    edges = _per_chunk(d, keys, *[
        edge(F.col(f"_v_{n}"), F.when(F.col(f"_v_{n}").isNotNull(), F.col(ts))).alias(f"_e_{n}")
        for n in values
    ])
    before = Window.partitionBy(*keys).orderBy(order("_c")).rowsBetween(Window.unboundedPreceding, -1)
    carried = edges.select(
        *keys, "_c", *[F.last(f"_e_{n}", ignorenulls=True).over(before).alias(f"_p_{n}") for n in values])
    here = (Window.partitionBy(*keys, "_c").orderBy(order(ts))
            .rowsBetween(Window.unboundedPreceding, -1 if strict else Window.currentRow))
    for n in values:
        d = d.withColumn(f"_l_{n}", F.last(f"_v_{n}", ignorenulls=True).over(here))
    d = d.join(carried, [*keys, "_c"])
    for n in values:
        d = d.withColumn(n, F.coalesce(f"_l_{n}", f"_p_{n}"))
    return d.drop("_c", *[f"_{t}_{n}" for n in values for t in "vlp"])


def known_around(df: DataFrame, cols: Sequence[str], by: Keys = "ticker", ts: str = "ts", every: str | None = "1d") -> DataFrame:
    """Adds ``_i`` (position by time) and, per column, the known values around a row as (i, v): ``_a_<col>`` the last one
    at or before it, ``_z_<col>`` the first one at or after it.

    One exchange of the rows: counts and both edges of a chunk come out of one aggregate over it.
    """
    keys = key_list(by)
    d = _chunked(df, keys, ts, every)
    inside = Window.partitionBy(*keys, "_c").orderBy(ts)
    upto = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    after = Window.partitionBy(*keys, "_c").orderBy(F.col("_r").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    d = d.withColumn("_r", F.row_number().over(inside) - 1)
    at = {c: F.when(F.col(c).isNotNull(), F.struct(F.col("_r").alias("i"), F.col(c).alias("v"))) for c in cols}
    edges = d.groupBy(*keys, "_c").agg(
        F.count(F.lit(1)).alias("_k"),
        *[F.max_by(at[c], F.when(F.col(c).isNotNull(), F.col("_r"))).alias(f"_b_{c}") for c in cols],
        *[F.min_by(at[c], F.when(F.col(c).isNotNull(), F.col("_r"))).alias(f"_y_{c}") for c in cols])
    chunks = Window.partitionBy(*keys).orderBy("_c")
    edges = edges.withColumn("_o", F.sum("_k").over(chunks) - F.col("_k"))

    def moved(p: str, offset: str = "_o") -> Column:
        return F.when(F.col(p).isNotNull(), F.struct((F.col(p)["i"] + F.col(offset)).alias("i"), F.col(p)["v"].alias("v")))

    before = chunks.rowsBetween(Window.unboundedPreceding, -1)
    later = Window.partitionBy(*keys).orderBy(F.col("_c").desc()).rowsBetween(Window.unboundedPreceding, -1)
    edges = edges.select(
        *keys, "_c", "_o", *[F.last(moved(f"_b_{c}"), ignorenulls=True).over(before).alias(f"_p_{c}") for c in cols],
        *[F.last(moved(f"_y_{c}"), ignorenulls=True).over(later).alias(f"_q_{c}") for c in cols])
    d = d.withColumns({f"_l_{c}": F.last(at[c], ignorenulls=True).over(upto) for c in cols})
    d = d.withColumns({f"_f_{c}": F.last(at[c], ignorenulls=True).over(after) for c in cols})
    d = d.join(edges, [*keys, "_c"])
    d = d.withColumns({
        "_i": F.col("_o") + F.col("_r"),
        **{f"_a_{c}": F.coalesce(moved(f"_l_{c}"), F.col(f"_p_{c}")) for c in cols},
        **{f"_z_{c}": F.coalesce(moved(f"_f_{c}"), F.col(f"_q_{c}")) for c in cols}})
    return d.drop("_c", "_r", "_o", *[f"_{x}_{c}" for c in cols for x in "lfpq"])


def running_sum(df: DataFrame, values: dict[str, Column], by: Keys = "ticker", ts: str = "ts",
                every: str | None = "1d") -> DataFrame:
    """Adds, per name, the sum of the expression over all rows up to and including this one."""
    keys = key_list(by)
    d = _chunked(df, keys, ts, every)
    totals = _per_chunk(d, keys, *[F.sum(e).alias(f"_t_{n}") for n, e in values.items()])
    before = Window.partitionBy(*keys).orderBy("_c").rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select(
        *keys, "_c", *[F.coalesce(F.sum(f"_t_{n}").over(before), F.lit(0)).alias(f"_p_{n}") for n in values])
    here = (Window.partitionBy(*keys, "_c").orderBy(ts)
            .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    for n, e in values.items():
        d = d.withColumn(f"_l_{n}", F.sum(e).over(here))
    d = d.join(carried, [*keys, "_c"])
    for n in values:
        d = d.withColumn(n, F.col(f"_l_{n}") + F.col(f"_p_{n}"))
    return d.drop("_c", *[f"_{t}_{n}" for n in values for t in "lp"])


def latest_n(df: DataFrame, n: int, by: Keys = "ticker", ts: str = "ts") -> DataFrame:
    """The newest ``n`` rows per key, with ``age`` 1 for the newest.

    Spark applies the rank limit before the exchange, so a hot key sends at most ``n`` rows per task.
    """
    w = Window.partitionBy(*key_list(by)).orderBy(F.col(ts).desc())
    return df.withColumn("age", F.row_number().over(w)).where(F.col("age") <= n)


def newest_by(df: DataFrame, keys: Keys, order: Sequence[Column], first: bool = False) -> DataFrame:
    """One row per key: the one greatest (or smallest) in ``order``, combined before the exchange."""
    names = key_list(keys)
    pick = F.min_by if first else F.max_by
    rest = [c for c in df.columns if c not in names]
    best = df.groupBy(*names).agg(pick(F.struct(*rest), F.struct(*order)).alias("_row"))
    return best.select(*names, "_row.*").select(*df.columns)


def spread_lists(df: DataFrame, by: Keys, item: str, per_list: int = 1000) -> DataFrame:
    """Items per key as sorted lists of about ``per_list`` items: (key, page, pages, items).

    A small group is one list; a big one is spread by hash over as many pages as it needs.
    """
    keys = key_list(by)
    sizes = df.groupBy(*keys).agg(
        F.ceil(F.count(F.lit(1)) / per_list).cast("int").alias("pages"))
    return (
        df.join(sizes, keys)
        .withColumn("page", F.pmod(F.xxhash64(item), F.col("pages")).cast("int"))
        .groupBy(*keys, "page", "pages")
        .agg(F.array_sort(F.collect_list(item)).alias("items"))
    )
