"""Bar intervals, periods, calendar helpers and relative ages."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Bar-interval labels and their length in seconds (a month counts 31 days,
# which sizes chunks and the time a live month stays open, but never places a bar).
INTERVAL_SECONDS = {
    "1m": 60, "5m": 300, "15m": 900, "30m": 1800,
    "1h": 3600, "1d": 86400, "1wk": 604800, "1mo": 2678400,
}

# How each source spells the labels that differ from ours.
SOURCE_INTERVALS = {
    "yfinance": {"1h": "60m"},
    "binance": {"1wk": "1w", "1mo": "1M"},
}

# Signal time frames in days.
TIMEFRAME_DAYS = {"week": 7, "2weeks": 14, "month": 30}

_TRUNC = {"1h": "hour", "1d": "day", "1wk": "week", "1mo": "month"}


def interval_seconds(every: str) -> int:
    return INTERVAL_SECONDS[every]


def bar_start(ts: Column, every: str) -> Column:
    """Start of the bar that holds ``ts``; calendar units truncate, minutes count from the epoch."""
    if every in _TRUNC:
        return F.date_trunc(_TRUNC[every], ts)
    step = INTERVAL_SECONDS[every]
    return F.timestamp_seconds(F.floor(F.unix_seconds(ts) / step) * step)


def source_interval(label: Column, source: Column) -> Column:
    """The label as the source spells it; null for labels outside the known set."""
    spelled = F.when(label.isin(*INTERVAL_SECONDS), label)
    for name, changes in SOURCE_INTERVALS.items():
        for ours, theirs in changes.items():
            spelled = F.when((source == name) & (label == ours), F.lit(theirs)).otherwise(spelled)
    return spelled


def period_days(period: Column, default: int = 90) -> Column:
    """``'90d'`` -> 90, ``'5y'`` -> 1825; anything else gives the default."""
    number = F.regexp_extract(period, r"^(\d+)([dy])$", 1)
    unit = F.regexp_extract(period, r"^(\d+)([dy])$", 2)
    return (
        F.when(unit == "d", number.cast("int"))
        .when(unit == "y", number.cast("int") * 365)
        .otherwise(F.lit(default))
    )


def timeframe_days(label: Column, default: int = 7) -> Column:
    known = F.create_map(*[F.lit(x) for pair in TIMEFRAME_DAYS.items() for x in pair])
    return F.coalesce(F.element_at(known, label), F.lit(default))


def relative_age(then: Column, now: Column) -> Column:
    """``"n minutes ago"`` below one hour, ``"n hours ago"`` below a day, else days."""
    minutes = F.floor((F.unix_seconds(now) - F.unix_seconds(then)) / 60)
    hours = F.floor(minutes / 60)
    return (
        F.when(hours < 1, F.concat(minutes.cast("string"), F.lit(" minutes ago")))
        .when(hours < 24, F.concat(hours.cast("string"), F.lit(" hours ago")))
        .otherwise(F.concat(F.floor(hours / 24).cast("string"), F.lit(" days ago")))
    )


def forecast_dates(last: Column, steps: Column) -> Column:
    """The ``steps`` dates that follow ``last``, one per day."""
    return F.sequence(F.date_add(last, 1), F.date_add(last, steps))


def bars_ahead(last: Column, bars: Column, every: str) -> Column:
    """The start of the bar ``bars`` after ``last``; months keep the calendar."""
    if every == "1mo":
        return F.add_months(last, bars).cast("timestamp")
    return F.timestamp_micros(F.unix_micros(last) + bars.cast("long") * (INTERVAL_SECONDS[every] * 1_000_000))


def from_epoch_millis(ms: Column) -> Column:
    return F.timestamp_millis(ms.cast("long"))


def day_text(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd")
