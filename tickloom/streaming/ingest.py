"""Incremental loads, the news stream and run progress."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tickloom.functions.text import NEGATIVE_WORDS, POSITIVE_WORDS, TICKER_KEYWORDS
from tickloom.operators.news import scored, tagged
from tickloom.sources.store import write_upsert

BUCKETS = 256            # groups of runs that share a state
NO_TOTAL = -(1 << 62)    # in the state of a run whose number of steps is not known
RUN = np.dtype([("run", "<i8"), ("nameless", "?"), ("done", "<i8"), ("total", "<i8"), ("first", "<i8"), ("last", "<i8"), ("until", "<i8")])


def upsert_into(path: str, keys: Sequence[str], order: Sequence[str] = (), partitions: Sequence[str] = ()) -> Callable:
    """A batch handler that upserts into a Parquet table, so repeats and replays change nothing."""
    def handle(batch: DataFrame, _: int) -> None:
        write_upsert(batch, path, keys, order, partitions)
    return handle


def first_seen(df: DataFrame, keys: Sequence[str], ts: str, delay: str = "1 day") -> DataFrame:
    """A stream without repeated keys, remembered for as long as the watermark allows."""
    return df.withWatermark(ts, delay).dropDuplicatesWithinWatermark(list(keys))


def news_stream(items: DataFrame, delay: str = "7 days", lexicon: Mapping[str, Sequence[str]] = TICKER_KEYWORDS,
                positive: Sequence[str] = POSITIVE_WORDS, negative: Sequence[str] = NEGATIVE_WORDS) -> DataFrame:
    """News once per link, with tags and score."""
    return scored(tagged(first_seen(items, ["link"], "published", delay), lexicon), positive, negative)


def _added(held: pd.DataFrame, events: pd.DataFrame) -> pd.DataFrame:
    """The runs of ``held`` with those of some events (run, nameless, total, micros); the latter are marked as new."""
    by = ["run", "nameless"]
    fresh = events.groupby(by, as_index=False).agg(
        done=("micros", "size"), total=("total", "max"), first=("micros", "min"), last=("micros", "max"))
    both = pd.concat([held, fresh.assign(until=0, new=True)], ignore_index=True) if len(held) else fresh.assign(until=0, new=True)
    return both.groupby(by, as_index=False).agg(
        {"done": "sum", "total": "max", "first": "min", "last": "max", "until": "max", "new": "any"})


def run_progress(events: DataFrame, delay: str = "1 hour", late: str = "0 seconds", buckets: int = BUCKETS) -> DataFrame:
    """Steps done and the times of the first and last event per run, again whenever it changed; use update mode.

    A run is closed with its last step, or when the watermark (the newest event less ``late``) has passed its last event by
    ``delay``, which also releases its state. A step that comes after that opens the run anew.

    Runs are dealt by hash to ``buckets`` groups, since a call of Python for every run takes longer than its steps do. The state
    of a group is one record a run it still holds (``RUN``), and its timer that of the run that ends first.
    """
    patience = events.sparkSession.sql(f"SELECT CAST(INTERVAL {delay} AS INTERVAL SECOND)").first()[0]
    wait = int(patience.total_seconds() * 1000)

    def update(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = pd.DataFrame(np.frombuffer(state.get[0], RUN)) if state.exists else pd.DataFrame(np.empty(0, RUN))
        held["new"] = False
        mark = state.getCurrentWatermarkMs()
        for f in [] if state.hasTimedOut else frames:
            held = _added(held, f)
        held.loc[held["new"], "until"] = np.maximum(held.loc[held["new"], "last"] // 1000 + wait, mark + 1)
        over = ~held["new"] & (held["until"] < mark)
        left = held[~over]
        if len(left):
            state.update((left[list(RUN.names)].to_records(index=False).astype(RUN).tobytes(),))
            state.setTimeoutTimestamp(max(int(left["until"].min()), mark))
        elif state.exists:
            state.remove()
        out = held[held["new"] | over]
        none = out["total"] == NO_TOTAL
        total = out["total"].mask(none, 0).astype("Int32").mask(none)
        yield pd.DataFrame({"trace_id": out["run"].astype("Int64").mask(out["nameless"]), "steps_done": out["done"], "total_steps": total, "first": out["first"],
                            "last": out["last"], "closed": over[out.index] | (~none & (out["done"] >= out["total"]))})

    rows = events.withWatermark("ts", late).where("ts is not null").select(
        F.pmod(F.xxhash64("trace_id"), F.lit(buckets)).alias("bucket"), F.coalesce("trace_id", F.lit(0)).cast("long").alias("run"),
        F.col("trace_id").isNull().alias("nameless"), F.coalesce(F.col("total_steps").cast("long"), F.lit(NO_TOTAL)).alias("total"),
        "ts", F.unix_micros("ts").alias("micros"))
    found = rows.groupBy("bucket").applyInPandasWithState(
        update, "trace_id bigint, steps_done bigint, total_steps int, first bigint, last bigint, closed boolean",
        "runs binary", "update", GroupStateTimeout.EventTimeTimeout)
    return found.select("trace_id", "steps_done", "total_steps", F.timestamp_micros("first").alias("started"),
                        F.timestamp_micros("last").alias("last_event"), "closed")


def progress_numbers(progress: DataFrame) -> DataFrame:
    """Percent done, steps per second and expected end from the counts of ``run_progress``."""
    elapsed = (F.unix_micros("last_event") - F.unix_micros("started")) / 1e6
    total, done = F.col("total_steps"), F.col("steps_done")
    d = progress.withColumns({
        "progress": F.coalesce(done / F.when(total > 0, total) * 100, F.lit(0.0)),
        "rate": F.coalesce(done / F.when(elapsed > 0, elapsed), F.lit(0.0))})
    left = (total - done) / F.when(F.col("rate") > 0, F.col("rate"))
    return d.withColumn("seconds_left", F.coalesce(left, F.lit(0.0)))


def keep_progress(path: str, parts: int = 8) -> Callable:
    """A batch handler for update mode: the newest row of every run, in a table of ``parts`` partitions of runs."""
    def handle(batch: DataFrame, _: int) -> None:
        rows = batch.withColumn("part", F.pmod(F.xxhash64("trace_id"), F.lit(parts)).cast("int"))
        write_upsert(rows, path, ["trace_id"], ["steps_done", "closed"], ["part"], files=1)
    return handle
