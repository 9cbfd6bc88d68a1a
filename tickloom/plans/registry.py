"""Where the runnable queries are registered, with their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Registers a query; ``sql`` is the same question for a SQL engine over the same tables."""
    def register(fn):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql.strip()
        return fn
    return register


def rnd(col: Column | str, digits: int = 4) -> Column:
    """Half-up rounding by way of a decimal with four more digits.

    Sums of doubles taken in another order differ in their last bits; the detour keeps a value that
    is a tie in decimal a tie, so both engines round it the same way.
    """
    c = F.col(col) if isinstance(col, str) else col
    return F.round(c.try_cast(f"decimal(38,{digits + 4})"), digits).cast("double")


def r(expr: str, digits: int = 4) -> str:
    """The SQL spelling of ``rnd``."""
    return f"CAST(round(TRY_CAST(({expr}) AS DECIMAL(38,{digits + 4})), {digits}) AS DOUBLE)"


def day(col: str = "ts") -> Column:
    return F.date_format(F.col(col), "yyyy-MM-dd").alias("d")


DAY = "strftime(ts, '%Y-%m-%d') AS d"
