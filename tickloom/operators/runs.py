"""Run and step statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.operators.core import Keys, key_list


def run_with_steps(runs: DataFrame, steps: DataFrame) -> DataFrame:
    """Each run next to its steps, one row per step; runs without steps stay.

    The steps carry their order instead of being gathered into one list per run, so a run with very
    many steps is no single row.
    """
    s = steps.select("trace_id", "step_order", F.col("status").alias("step_status"),
                     F.col("start_time").alias("step_start"), "records", "step_id")
    return runs.join(s, "trace_id", "left")


def run_step_counts(runs: DataFrame, steps: DataFrame) -> DataFrame:
    """Total, completed and failed steps and the share of completed ones, per run."""
    counts = steps.groupBy("trace_id").agg(
        F.count(F.lit(1)).alias("total_steps"),
        F.count_if(F.col("status") == "completed").alias("completed_steps"),
        F.count_if(F.col("status") == "failed").alias("failed_steps"))
    d = runs.join(counts, "trace_id", "left").na.fill(0, ["total_steps", "completed_steps", "failed_steps"])
    share = F.col("completed_steps") / F.when(F.col("total_steps") > 0, F.col("total_steps"))
    return d.withColumn("success_rate", F.coalesce(share, F.lit(0.0)))


def run_statistics(runs: DataFrame) -> DataFrame:
    """Runs by status, mean duration and mean success rate (0 when there are none)."""
    by_status = [F.count_if(F.col("status") == s).alias(f"{s}_executions") for s in ("completed", "failed", "running")]
    return runs.agg(
        F.count(F.lit(1)).alias("total_executions"), *by_status,
        F.coalesce(F.avg("duration_seconds"), F.lit(0.0)).alias("avg_duration_seconds"),
        F.coalesce(F.avg("success_rate"), F.lit(0.0)).alias("avg_success_rate"))


def run_trends(runs: DataFrame, n: int = 10) -> DataFrame:
    """Success rate and duration of the newest ``n`` runs, those without duration left out."""
    recent = runs.orderBy(F.col("start_time").desc(), F.col("trace_id").desc()).limit(n)
    return recent.where(F.col("duration_seconds").isNotNull()).select(
        "trace_id", "start_time", "success_rate", "duration_seconds")


def recent_activity(log: DataFrame, ts: str, now: Column, hours: int = 24, by: Keys = ()) -> DataFrame:
    """Log rows of the last hours, per key."""
    recent = log.where(F.col(ts) > now - F.make_interval(hours=F.lit(hours)))
    return recent.groupBy(*key_list(by)).agg(F.count(F.lit(1)).alias("recent"))
