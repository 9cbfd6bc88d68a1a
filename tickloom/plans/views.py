"""The engine's inputs as views over the given tables, and the same views in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.sources.bars import bars_from_trades

def _digits(col, n: int):
    return col.cast(f"decimal({n},0)")


def trade_rank():
    """One number that orders trades by time, order, line, amount and quantity.

    (order, line) is not unique in the given table, so the amount in cents and the quantity follow;
    trades equal in all of these have the same price. Digits: 11, 12, 1, 9 and 3 of them.
    """
    rest = (F.col("l_linenumber") * F.lit(10 ** 12) + F.round(F.col("l_extendedprice") * 100).cast("long") * 1000
            + F.col("l_quantity").cast("long"))
    fits = (F.col("l_orderkey") < 10 ** 12) & (F.col("l_extendedprice") < 10 ** 7) & (F.col("l_quantity") < 1000) & (F.col("l_linenumber") < 10)
    rest = F.when(fits, rest).otherwise(F.raise_error(F.lit("a trade does not fit the rank: order by a struct")).cast("long"))
    head = _digits(F.unix_seconds("ts"), 11) * _digits(F.lit(10 ** 12), 13) + _digits(F.col("l_orderkey"), 12)
    return _digits(_digits(head, 24) * _digits(F.lit(10 ** 13), 14) + _digits(rest, 13), 38)


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """One given table; zone-free timestamps are read as UTC instants."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    df = spark.read.parquet(f"{sf.rstrip('/')}/{name}.parquet")
    return df.withColumns({
        f.name: F.col(f.name).cast("timestamp")
        for f in df.schema.fields if f.dataType.simpleString() == "timestamp_ntz"
    }) if any(f.dataType.simpleString() == "timestamp_ntz" for f in df.schema.fields) else df


def trades(spark: SparkSession, sf: str) -> DataFrame:
    part = table(spark, sf, "part").select("p_partkey", F.col("p_brand").alias("ticker"))
    line = table(spark, sf, "lineitem").select(
        F.col("l_shipdate").alias("ts"),
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"),
        F.col("l_quantity").alias("size"),
        F.when(F.col("l_linestatus") == "O", "yfinance").otherwise("binance").alias("source"),
        "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_quantity",
    )
    return line.join(part, line.l_partkey == part.p_partkey).drop("p_partkey")


def bars_day(spark: SparkSession, sf: str) -> DataFrame:
    return bars_from_trades(trades(spark, sf), "1d", order=trade_rank())


def bars_month(spark: SparkSession, sf: str) -> DataFrame:
    return bars_from_trades(trades(spark, sf), "1mo", order=trade_rank())


def bars_source(spark: SparkSession, sf: str) -> DataFrame:
    """Daily bars per ticker and source."""
    return bars_from_trades(trades(spark, sf), "1d", by=("ticker", "source"), order=trade_rank())


def gappy(spark: SparkSession, sf: str) -> DataFrame:
    """Daily bars with holes: values are missing by a rule on the day and the volume."""
    b = bars_day(spark, sf)
    return b.select(
        "ticker", "ts",
        *[F.when(_hole(k), F.lit(None)).otherwise(F.col(c)).alias(c)
          for k, c in enumerate(["open", "high", "low", "close", "volume"])],
    )


def _hole(k: int):
    return (F.datediff(F.col("ts"), F.lit("1970-01-01").cast("date")) + 3 * F.col("volume") + k) % 5 == 0


def ticks(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select(
        F.col("event_type").alias("ticker"), "ts", F.col("value").alias("price"),
        "event_id", "user_id", "props")


def bars_hour(spark: SparkSession, sf: str) -> DataFrame:
    t = ticks(spark, sf).withColumn("size", F.lit(1.0))
    return bars_from_trades(t, "1h", order=F.col("event_id"))  # numbered in time order


def news(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select(
        F.col("doc_id").alias("link"),
        F.concat(F.lit("Document "), F.col("doc_id").cast("string")).alias("title"),
        F.col("text").alias("description"),
        "source",
        F.timestamp_seconds(F.lit(1704067200) + F.col("doc_id") * 60).alias("published"),
    )


def runs(spark: SparkSession, sf: str) -> DataFrame:
    status = (F.when(F.col("o_orderstatus") == "F", "completed")
              .when(F.col("o_orderstatus") == "P", "failed").otherwise("running"))
    took = F.when(F.col("o_orderstatus") != "O", F.round(F.col("o_totalprice") / 100, 0))
    return table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("trace_id"), F.col("o_orderpriority").alias("run_type"),
        status.alias("status"), F.col("o_orderdate").alias("start_time"),
        took.alias("duration_seconds"),
    )


def steps(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("trace_id"), F.col("l_linenumber").alias("step_order"),
        F.when(F.col("l_returnflag") == "R", "failed").otherwise("completed").alias("status"),
        F.col("l_shipdate").alias("start_time"),
        F.col("l_quantity").alias("records"), F.col("l_partkey").alias("step_id"),
    )


def points(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("entity"), F.col("label").alias("cluster"), "embedding")


# --- the same views in SQL ---------------------------------------------------------------------

_MOMENT = "row(ts, l_orderkey, l_linenumber, l_extendedprice, l_quantity)"
_OHLC = f"""arg_min(price, {_MOMENT}) AS open, max(price) AS high, min(price) AS low,
  arg_max(price, {_MOMENT}) AS close, sum(size) AS volume, count(*) AS trades"""

_SQL = {
    "trades": ([], """SELECT p_brand AS ticker, l_shipdate AS ts, l_extendedprice / l_quantity AS price,
  l_quantity AS size, CASE WHEN l_linestatus = 'O' THEN 'yfinance' ELSE 'binance' END AS source,
  l_orderkey, l_linenumber, l_extendedprice, l_quantity
  FROM lineitem JOIN part ON l_partkey = p_partkey"""),
    "bars_day": (["trades"], f"""SELECT ticker, bar AS ts, * EXCLUDE (ticker, bar) FROM (
  SELECT ticker, date_trunc('day', ts) AS bar, {_OHLC} FROM trades GROUP BY ALL)"""),
    "bars_month": (["trades"], f"""SELECT ticker, bar AS ts, * EXCLUDE (ticker, bar) FROM (
  SELECT ticker, date_trunc('month', ts) AS bar, {_OHLC} FROM trades GROUP BY ALL)"""),
    "bars_source": (["trades"], f"""SELECT ticker, source, bar AS ts, * EXCLUDE (ticker, source, bar) FROM (
  SELECT ticker, source, date_trunc('day', ts) AS bar, {_OHLC} FROM trades GROUP BY ALL)"""),
    "gappy": (["bars_day"], "SELECT ticker, ts, " + ", ".join(
        f"CASE WHEN (date_diff('day', DATE '1970-01-01', CAST(ts AS DATE)) + 3 * CAST(volume AS BIGINT) + {k}) % 5 = 0 "
        f"THEN NULL ELSE {c} END AS {c}"
        for k, c in enumerate(["open", "high", "low", "close", "volume"])) + " FROM bars_day"),
    "ticks": ([], """SELECT event_type AS ticker, ts, value AS price, event_id, user_id, props FROM events"""),
    "bars_hour": (["ticks"], """SELECT ticker, bar AS ts, * EXCLUDE (ticker, bar) FROM (
  SELECT ticker, date_trunc('hour', ts) AS bar, arg_min(price, row(ts, event_id)) AS open,
  max(price) AS high, min(price) AS low, arg_max(price, row(ts, event_id)) AS close,
  CAST(count(*) AS DOUBLE) AS volume, count(*) AS trades FROM ticks GROUP BY ALL)"""),
    "news": ([], """SELECT doc_id AS link, 'Document ' || doc_id AS title, text AS description, source,
  TIMESTAMP '2024-01-01' + to_minutes(doc_id) AS published FROM documents"""),
    "runs": ([], """SELECT o_orderkey AS trace_id, o_orderpriority AS run_type,
  CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'P' THEN 'failed' ELSE 'running' END AS status,
  o_orderdate AS start_time,
  CASE WHEN o_orderstatus <> 'O' THEN round(o_totalprice / 100, 0) END AS duration_seconds FROM orders"""),
    "steps": ([], """SELECT l_orderkey AS trace_id, l_linenumber AS step_order,
  CASE WHEN l_returnflag = 'R' THEN 'failed' ELSE 'completed' END AS status, l_shipdate AS start_time,
  l_quantity AS records, l_partkey AS step_id FROM lineitem"""),
    "points": ([], "SELECT vec_id AS entity, label AS cluster, embedding FROM embeddings"),
}


def using(names: str, body: str, *more: str, recursive: bool = False) -> str:
    """``body`` with the named views (and what they need) in front, then any ``more`` CTEs."""
    seen: list[str] = []

    def need(n: str) -> None:
        for m in _SQL[n][0]:
            need(m)
        if n not in seen:
            seen.append(n)

    for n in names.split():
        need(n)
    parts = [f"{n} AS ({_SQL[n][1]})" for n in seen] + list(more)
    return f"WITH {'RECURSIVE ' if recursive else ''}{', '.join(parts)} {body}"
